"""Null ids, repeated rows and inputs beyond one block: every row counts, against brute force."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rankengine.llm import decontamination, language_id, mixing, near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_gives_rows_without_id_their_share(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(30)]
    # the rows of source b have no id; one row is in both sources
    docs = spark.createDataFrame([(None if i % 2 else i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "b", 0)], SCHEMA)
    by = {}
    for r in mixing.mix(docs).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert set(by) == {"a", "b"} and all(abs(target - n) < 1 for target, n in by.values())
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.where("doc_id is null").select("text").distinct().count() >= 14


def _words(name, n=40):
    return " ".join(f"{name}{j}" for j in range(n))


def test_near_duplicates_without_ids_and_of_repeated_rows(spark):
    a, b, c, d, e = map(_words, "abcde")
    near = a.replace("a39", "other")
    rows = [(1, a), (1, a), (None, a), (None, near), (None, b), (None, b), (2, c), (2, d), (3, c), (None, d), (4, e), (None, e), (5, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 5, 80).collect())
    # 2 and 3 share c, and the row without id that has d is 2's too; b and an empty text have no id at all
    want = [(1, 1, True)] * 2 + [(None, 1, False)] * 2 + [(None, None, True), (None, None, False), (2, 2, True), (2, 2, True), (3, 2, False), (None, 2, False), (4, 4, True), (None, 4, False), (5, 5, True), (None, None, True)]
    assert got == Counter(want)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(1, a), (None, b), (2, c), (2, d), (4, e), (5, ""), (None, "")])


def test_near_duplicates_of_two_sets_of_equal_size_under_one_id(spark):
    # id 1 stands for both texts; each has a near copy under an id of its own
    texts = [(1, _words("a")), (1, _words("b")), (2, _words("a").replace("a39", "x")), (3, _words("b").replace("b39", "x"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs, 5, 80).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_language_is_learned_from_few_distinct_beginnings(spark):
    # 30,000 copies of one text: a cut by rows with copies keeps it with a probability of 0.016
    copies = spark.range(30_000).select(F.lit("xx").alias("lang"), F.lit("zeta eta theta").alias("text"))
    # 300,000 characters in short texts, of which the sample needs 24,000
    short = spark.range(30_000).select(F.lit("yy").alias("lang"), F.format_string("ab%08x", F.col("id")).alias("text"))
    picked = []
    learned = language_id.Languages
    try:
        language_id.Languages = lambda samples: picked.append(samples) or learned(samples)
        model = language_id.learn(copies.unionByName(short), F.lit(True))
    finally:
        language_id.Languages = learned
    assert model.names == ["xx", "yy"] and picked[0]["xx"] == ["zeta eta theta"]
    assert language_id.SAMPLE_CHARS <= sum(map(len, picked[0]["yy"])) < language_id.SAMPLE_CHARS + 10


def test_pipeline_keeps_texts_when_no_language_is_known(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(["clean words", "123", None, "", "ж"])], SCHEMA)
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.languages(spark, docs, "").collect()} == {(0, None), (4, None)}


def test_languages_with_many_letters_and_many_languages():
    rng = np.random.default_rng(1)
    # languages of 2,500 letters, of one alphabet each but for their words; more than tables are held of
    words = {f"l{k:03}": ["".join(map(chr, rng.integers(0xAC00 if k % 2 else 0x4E00, (0xAC00 if k % 2 else 0x4E00) + 2500, 2))) for _ in range(400)] for k in range(210)}
    texts = {k: [" ".join(rng.choice(w, 20)) for _ in range(10)] for k, w in words.items()}
    model = language_id.Languages(texts)
    held = [" ".join(rng.choice(w, 60)) for w in words.values()] + ["\u044f\u0436", "123 "]
    names, _, _, letters = model.judge(held)
    assert names[:210] == list(words) and names[-1] == "und" and letters[-1] == 0
    phrases = model.phrases(held)[0]
    # phrases by brute force: longest runs that occur in the sample (letters that it lacks only end one)
    for k in (0, 1, 83, 209):
        sample = " ".join(texts[f"l{k:03}"])
        for d in (0, 1, 35, 209, 210):
            n, run = 1, ""
            for c in held[d]:
                if run + c not in sample:
                    n, run = n + 1, ""
                run += c if c in sample else ""
            assert phrases[d, k] == n


def test_decontamination_of_rows_that_share_ids(spark, monkeypatch):
    items = [(i, _words(f"i{i}x", 12)) for i in range(6)] + [(6, f"i0x11 {_words('i1x', 12)}"), (7, "i0x5 i0x6 i0x7"), (8, None), (9, ""), (10, "solo"), (11, "two words"), (None, "without id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b, clean = f"x {items[0][1]} {items[1][1]} y", f"x y {items[2][1]} {items[5][1]}", _words("c", 26)
    # rows of one length under one id and under none, with different texts
    texts = [(1, a), (1, b), (1, clean), (None, a), (None, b), (None, clean), (None, clean), (2, f"i0x5 i0x6 i0x7 z {items[4][1]}"), (3, None), (4, ""), (5, "Solo, words two words; SOLO two"), (6, "without id")]
    texts += [(7, " ".join(a.split()[3:9])), (8, (a + " ") * 400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit, held = set(), set()
        for key, item in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
            for k in range(max(1, len(w) - 9) if w else 0):
                run = w[k : k + 10]
                for i in range(len(words) - len(run) + 1):
                    if words[i : i + len(run)] == run:
                        hit |= set(range(i, i + len(run)))
                        held |= {str(key)} if key is not None else set()
        return len(words), len(hit), tuple(sorted(held)), hit

    def found():
        out = decontamination.find_overlaps(docs, bench).collect()
        assert all(r.n_hit == sum(b - a for a, b in r.spans) for r in out)
        return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), frozenset(k for a, b in r.spans for k in range(a, b))) for r in out)

    want = Counter((i, *brute(t)[:3], frozenset(brute(t)[3])) for i, t in texts)
    assert found() == want
    # a filter that lets nearly everything pass
    monkeypatch.setattr(decontamination, "BITS_EACH", 0)
    monkeypatch.setattr(decontamination, "LEAST_BITS", 3)
    assert found() == want


def test_mixed_blocks_follow_the_schedule(spark):
    sizes = {"a": 5000, "b": 3000, "c": 2000, None: 1500}
    texts = [(i, " ".join(f"w{j % 7}" for j in range(20 + i % 13)), src) for k, (src, n) in enumerate(sizes.items()) for i in range(k * 1000, k * 1000 + n // 25)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in texts] + [(None, "same words here", "en", "a", 0)] * 3, SCHEMA)
    blocks = mixing.mix_blocks(docs).collect()
    by = {(r.doc_id, r.source): [r.target, r.size, r.taken, r.first_slot, r.last_slot] for r in mixing.mix(docs).collect() if r.doc_id is not None}
    given, seen = Counter(), {}
    for b in blocks:
        given[b.doc_id, b.source] += b.end - b.first
        if b.slot is not None:
            seen.setdefault((b.doc_id, b.source), []).append(b.slot)
    for k, (_, size, taken, first, last) in by.items():
        assert given[k] == taken <= 2 * size and (first, last) == ((min(seen[k]), max(seen[k])) if k in seen else (None, None))
    targets = {k[1]: v[0] for k, v in by.items()}
    whole = sum(targets.values())
    owner = {b.slot: b.source for b in blocks if b.slot is not None}
    assert len(owner) > 900 and set(owner) == set(range(len(owner)))
    # the slots of a source up to any time are near its share: van der Corput points have a discrepancy of log2(n) + 1 at most
    for source, target in targets.items():
        n = 0
        for slot in range(len(owner)):
            n += owner[slot] == source
            assert abs(n - (slot + 1) * target / whole) <= 2 * (np.log2(slot + 1) + 1)
        ranks = [b.rank for b in sorted((b for b in blocks if b.source == source and b.slot is not None), key=lambda b: (b.slot, b.rank))]
        assert ranks == sorted(ranks)
    # three equal rows share what the mix takes of them, none loses a remainder
    total = sum(r.taken for r in mixing.mix(docs).where("source = 'a'").collect())
    assert total == int(targets["a"])
