"""Each operator against brute force on small texts with nulls, empty texts, copies, clashing columns and empty tables."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from rankengine.llm import decontamination, language_id, mixing, near_dup, quality_rules, suffix_tree, token_counts, token_files, toxicity
from rankengine.llm.queries import tokenizer_path
from rankengine.llm.staging import new_path, remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the cat sat on the mat and the dog ran to the park with a ball while the sun was out all day long"
TEXTS = [None, "", "  \n ", BASE, BASE, BASE.upper(), BASE + " again", "one two", "a", "Ünïcödé wörds here 'tis <|endoftext|> ok", (BASE + "\n") * 300, "spam spam " * 40, "# $ % & | < > * " * 9]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, bucket string, count int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "en", [None, "a", "b"][i % 3], 0, 1, "k", "x", 2) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_measures(docs, nothing):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i * 3]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert quality_rules.apply_rules(nothing).count() == 0


def test_token_counts_and_files(spark, docs, nothing):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert [got[i * 3].n_tokens for i in range(len(TEXTS))] == [len(x) for x in ids]
    assert [got[i * 3].n_bytes for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    out = token_files.write_token_files(docs, new_path(spark, "test"), path)
    digests = {r.doc_id: r for r in token_files.read_digests(spark, out).collect()}
    start = 0
    for i, x in enumerate(ids):
        whole = np.array([*x, 2], "<u4")
        assert (digests[i * 3].start, digests[i * 3].n_tokens, digests[i * 3].ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    assert token_files.read_ids(spark, out, [9]).first().ids == [*ids[3], 2]
    wide = token_files.write_token_files(docs.limit(4), new_path(spark, "test"), path, width=4)
    assert token_files.read_ids(spark, wide, [9]).first().ids == [*ids[3], 2]
    with pytest.raises(ValueError, match="fit"):
        token_files.write_token_files(docs, new_path(spark, "test"), path, width=1)
    empty = token_files.write_token_files(nothing, new_path(spark, "test"), path)
    assert token_files.read_digests(spark, empty).count() == 0 and token_counts.token_counts(nothing, path).count() == 0


def test_near_duplicates(docs, nothing):
    sets = []
    for t in TEXTS:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    reach = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {i * 3: (len(s), reach[i] * 3, reach[i] == i) for i, s in enumerate(sets)}
    assert near_dup.near_duplicates(nothing, 3, 85).count() == 0


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "The mat, and the dog ran to the park with a ball!"), (2, "one two"), (3, None), (4, "nowhere to be found in any of these many texts here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.digest(decontamination.find_overlaps(docs, bench)).collect()}
    assert got[9].n_hit == 12 and got[21].n_hit == 2 and got[21].n_items == 1 and not got[0].contaminated and got[30].n_hit == 12 * 300
    none = spark.createDataFrame([], bench.schema)
    assert decontamination.find_overlaps(docs, none).where("n_hit > 0").count() == 0 and decontamination.find_overlaps(nothing, bench).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    total = sum(len(WORD.findall(t or "")) for t in TEXTS)
    assert abs(sum(v[0] for v in by.values()) - 1.5 * total) < 1e-6 and all(abs(t - n) < 1 and t <= 2 * s for t, n, s in by.values())
    assert mixing.mix(nothing).count() == 0


def test_suffix_tree_base(docs, nothing):
    train = docs.withColumn("train", remainder(5) != 1)
    flags = {r.doc_id: r.train for r in train.select("doc_id", "train").collect()}
    words = {i * 3: [*WORD.findall(lower(t)), None] for i, t in enumerate(TEXTS)}
    c = Counter(w for k, ws in words.items() if flags[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in suffix_tree.score_texts(train).collect():
        ws = words[r.doc_id]
        assert r.train_tokens == n and r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9) and r.score < 0
    assert suffix_tree.score_texts(nothing.withColumn("train", remainder(5) != 1)).count() == 0


def test_language_id_held_out(spark, docs, nothing):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(d, remainder(3) != 1)
    held = language_id.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where(remainder(3) == 1).selectExpr("avg(int(lang = lang_pred)) a").first().a
    assert held > 0.97
    small = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert small[0].lang_pred == small[3].lang_pred == small[6].lang_pred == "und" and small[9].lang_pred != "und"
    untaught = language_id.learn(nothing, remainder(3) != 1)
    assert language_id.identify(docs, untaught).where("lang_pred <> 'und'").count() == 0


def _maximal(weights):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    best = max(((sum(weights[i:j]), -i, -j) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[2]
    return _maximal(weights[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in _maximal(weights[j:])]


def test_segments_are_maximal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        weights = rng.choice([-3, -2, -1, 1, 2, 5], rng.integers(0, 25), p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.1]) + rng.normal(0, 0.01, 1)
        weights = weights + rng.normal(0, 0.01, len(weights))  # no ties
        total, places = np.cumsum(weights), np.flatnonzero(weights > 0)
        found = toxicity.segments(places, (total - weights)[places], total[places])
        want = _maximal(weights.tolist())
        assert [x[:2] for x in found] == [x[:2] for x in want] and np.allclose([x[2] for x in found], [x[2] for x in want])


def test_long_pieces_and_sparse_words_take_linear_time():
    began = time.time()
    n = 100_000
    falling = np.cumsum(np.full(n, -13.0))
    assert len(toxicity.segments(np.arange(n) * 100, falling - 2, falling)) == n
    text = "abcdefghij" * 100_000
    assert token_counts.count_tokens([text], tokenizer_path())[0] > 100_000
    assert time.time() - began < 30


def test_toxicity(spark, docs, nothing):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, labels, remainder(3) != 1)
    r = toxicity.score(d, model).join(labels, "doc_id").where(remainder(3) == 1).selectExpr("avg(if(toxic = 1, int(score >= 0.7), null)) hit", "avg(if(toxic = 0, int(score >= 0.7), null)) wrong").first()
    assert r.hit > 0.89 and r.wrong < 0.004
    assert toxicity.score(docs, model).count() == len(TEXTS)
    assert toxicity.score(docs, toxicity.fit(nothing, labels.limit(0), remainder(3) != 1)).where("score <> 0").count() == 0


def test_toxicity_scores_against_plain_python(spark):
    """Weights from counts, segments by trying all stretches, calibration and score, step by step."""
    rng = np.random.default_rng(5)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "vileness", "hateful", "rotten"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = list(rng.choice(common, rng.integers(3, 40))) + (list(rng.choice(bad, rng.integers(1, 6))) if toxic and i % 16 else [])
        rows.append((i, None if i == 7 else " ".join(rng.permutation(words)), int(toxic)))
    rows += [(1000, "", 0), (1001, rows[0][1], rows[0][2])]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, remainder(3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}

    sample = sorted({(t, y) for i, t, y in rows if t is not None and zlib.crc32(str(i).encode()) % 3 != 1})
    n = Counter(y for _, y in sample)
    features = lambda t: {*t.split(), *(w[: toxicity.STEM] + "*" for w in t.split() if len(w) > toxicity.STEM)}
    seen = {y: Counter(f for t, z in sample if z == y for f in features(t)) for y in (0, 1)}
    weight = {}
    for f in seen[0].keys() | seen[1].keys():
        prior = (seen[0][f] + seen[1][f]) * toxicity.PRIOR / len(sample)
        a, b = seen[1][f] + prior, seen[0][f] + prior
        odds = math.log(a / (n[1] + toxicity.PRIOR - a)) - math.log(b / (n[0] + toxicity.PRIOR - b))
        left = max(0.0, abs(odds) - toxicity.BOUND * math.sqrt(1 / a + 1 / b))
        if left:
            weight[f] = max(-toxicity.MAX_WEIGHT, min(toxicity.MAX_WEIGHT, math.copysign(left, odds)))

    def scores(text):
        words = text.split()
        w = [weight.get(x, weight.get(x[: toxicity.STEM] + "*", 0.0) if len(x) > toxicity.STEM else 0.0) - toxicity.GAP for x in words]
        def all_of(lo, hi):  # the best stretch, then those on both sides of it
            best = max(((sum(w[i:j]), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 1e-12:
                return []
            return [*all_of(lo, -best[1]), best[0], *all_of(best[2], hi)]
        return len(words), all_of(0, len(words))

    found = [(*scores(t), y) for t, y in sample]
    clean = [(max(s, default=0.0), z) for z, s, y in found if not y]
    rate = math.pi / (max(float(np.std([s for s, _ in clean])), 0.5) * math.sqrt(6))
    scale = math.exp(rate * np.mean([s for s, _ in clean]) - np.mean([math.log(max(z, 1)) for _, z in clean]) - 0.5772)
    evidence = lambda z, ss: sum(max(0.0, math.log(toxicity.E_VALUE) - math.log(max(scale * z * math.exp(-rate * s), 1e-300))) for s in ss)
    slope, shift = toxicity._logistic(np.log1p([evidence(z, s) for z, s, _ in found]), np.array([float(y) for *_, y in found]))
    for i, t, _ in rows:
        want = 1 / (1 + math.exp(-(slope * math.log1p(evidence(*scores(t or ""))) + shift)))
        assert abs(got[i] - want) < 1e-6, (i, t)
    assert got[1000] == got[7] < 0.5 and got[1001] == got[0] and sum(got[i] >= 0.7 for i, _, y in rows if y and i % 16) > 70


def test_quality_windows_whatever_their_number(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"a{i}" for i in rng.integers(0, 3, 3000))
    w = text.split()
    seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    hit = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    df = spark.createDataFrame([(1, text), (2, " ".join(f"b{i}" for i in range(20_000)))], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(df).collect()} == {1: len(hit), 2: 0}
