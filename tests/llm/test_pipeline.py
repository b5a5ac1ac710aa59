"""Every stage of the pipeline, and all of them in a row, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rankengine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, times int, component_id long"
BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


ITEM = _text(900, 12)
COPY = _text(1)
ROWS = [
    (1, COPY, "en", "a"), (1, COPY, "en", "a"), (2, COPY.replace(COPY.split()[30], "other"), None, "b"), (None, COPY, "en", None), (3, _text(3), "en", "a"), (3, _text(4), "xx", "b"),
    (None, _text(5), None, "c"), (None, _text(6), "en", None), (4, None, "en", "a"), (5, "", None, "b"), (None, " \n ", "en", "c"), (6, "123 $ 456", "en", "a"), (7, f"{_text(7)} {ITEM.upper()} {_text(8)}", "en", "b"),
    (8, f"{_text(9)} {' '.join(ITEM.split()[:9])}", "en", "c"), (9, (_text(10) + "\n") * 300, "en", "c"), (10, "\u0436\u044f", "ru", "a"), (11, "one", "en", "b"), *[(20 + i, _text(50 + i, 20 + 7 * (i % 9)), "en", "abc"[i % 3]) for i in range(40)],
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _first(r):
    return (r[0] is None, r[0] or 0)


def brute_languages(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def brute_near(rows):
    sets = []
    for r in rows:
        w = re.findall(BLANK, lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    return [min((r for r, h in zip(rows, group, strict=True) if h == g), key=_first) for g in dict.fromkeys(group)]


def brute_clean(rows):
    w = re.findall(ALNUM, lower(ITEM))
    windows = [w[i : i + 10] for i in range(len(w) - 9)]
    out = []
    for r in rows:
        x = re.findall(ALNUM, lower(r[1]))
        if not any(x[i : i + 10] in windows for i in range(len(x) - 9)):
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    _frame(spark, ROWS).write.parquet(f"{at}/documents.parquet")
    return at


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)


def _rows(df, columns=("doc_id", "text", "source")):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def _short(rows):
    return Counter((r[0], r[1], r[3]) for r in rows)


@pytest.mark.parametrize(("stage", "brute"), [("languages", brute_languages), ("near_duplicates", brute_near), ("decontaminate", brute_clean)])
def test_filtering_stages(spark, folder, stage, brute):
    f = getattr(corpus_pipeline, stage)
    out = f(spark, _frame(spark, ROWS), folder)
    assert out.columns == corpus_pipeline.COLUMNS and _rows(out, ("doc_id", "text")) == Counter((r[0], r[1]) for r in brute(ROWS))
    assert f(spark, _frame(spark, ROWS).limit(0), folder).count() == 0


def _near_targets(counts, rows):
    """Copies of whole documents hold about the words that each source is to give: weights 3, 1, 2, at most twice its size."""
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(BLANK, r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        level = left / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in names}
    given, longest = Counter(), {s: max(len(re.findall(BLANK, r[1] or "")) for r in rows if r[3] == s) for s in names}
    for (_, text, source), n in counts.items():
        given[source] += n * len(re.findall(BLANK, text or ""))
    assert all(abs(given[s] - target[s]) <= longest[s] for s in names), (given, target)


def test_mixing_stage(spark, folder):
    rows = [r for r in ROWS if r[0] != 9]
    counts = _rows(corpus_pipeline.mix_sources(spark, _frame(spark, rows), folder))
    _near_targets(counts, rows)
    have = _short(rows)
    assert all(n <= 2 * have[k] for k, n in counts.items())
    assert corpus_pipeline.mix_sources(spark, _frame(spark, rows).limit(0), folder).count() == 0


def _check_index(rows, found):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in {t for _, t, _ in rows}}
    want = Counter((k, len(ids[t]), zlib.crc32(ids[t].tobytes())) for k, t, _ in rows.elements())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    keys = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_token_stage(spark, folder):
    _check_index(_short(ROWS), corpus_pipeline.write_tokens(spark, _frame(spark, ROWS), folder).collect())
    assert corpus_pipeline.write_tokens(spark, _frame(spark, ROWS).limit(0), folder).count() == 0


def test_whole_pipeline(spark, folder):
    kept = brute_clean(brute_near(brute_languages(ROWS)))
    mixed = []
    real = corpus_pipeline.STAGES[-1]
    corpus_pipeline.STAGES[-1] = (real[0], lambda s, docs, d: mixed.append(_rows(docs)) or real[1](s, docs, d))
    try:
        found = corpus_pipeline.run(spark, folder).collect()
    finally:
        corpus_pipeline.STAGES[-1] = real
    have = _short(kept)
    assert all(n <= 2 * have[k] for k, n in mixed[0].items())
    _near_targets(mixed[0], kept)
    _check_index(mixed[0], found)
