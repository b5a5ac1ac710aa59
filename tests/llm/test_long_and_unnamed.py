"""Rows without a doc_id, and texts longer than a slice of a batch, in the operators that score or count each text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankengine.llm import edit_prints, language_id, period_runs, quality_rules, token_counts, token_files, toxicity
from rankengine.llm.queries import tokenizer_path
from rankengine.llm.staging import new_path, remainder

WORDS = "the river ran past old mills while children sang about boats and the long summer of their lives"
LONG = " ".join(f"{w}{i % 977}" for i in range(60_000) for w in WORDS.split()[i % 7 : i % 7 + 9])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, WORDS, "en"), (None, None, None), (None, WORDS, "en"), (1, LONG, "en"), (2, "ein kurzer Satz über Flüsse und Mühlen", "de"), (3, "", "de")]
    assert len(LONG) > 4 << 20
    return spark.createDataFrame([(*r[:2], r[2], "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {None: 3, 1: 1, 2: 1, 3: 1}
    return out


def test_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = by_id(token_counts.token_counts(docs, tokenizer_path()))
    assert sorted(r.n_tokens for r in got[None]) == [0, n(WORDS), n(WORDS)] and got[1][0].n_tokens == n(LONG) and got[1][0].n_bytes == len(LONG)
    rules = by_id(quality_rules.apply_rules(docs))
    assert rules[1][0].n_words == len(LONG.split()) and sorted(r.n_words for r in rules[None]) == [0, 18, 18]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    out = token_files.write_token_files(docs, new_path(spark, "test"), tokenizer_path())
    got = by_id(token_files.read_digests(spark, out))
    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    assert (got[1][0].n_tokens, got[1][0].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and sorted(r.n_tokens for r in got[None])[0] == 1


def test_scores(docs):
    labels = docs.select("doc_id", F.lit(0).alias("toxic")).where("doc_id is not null").limit(0)
    assert {r.score for rows in by_id(toxicity.score(docs, toxicity.fit(docs, labels, remainder(3) != 1))).values() for r in rows} == {0.0}
    found = by_id(language_id.identify(docs, language_id.learn(docs, F.lit(True))))
    assert found[1][0].lang_pred == "en" and found[2][0].lang_pred == "de" and found[3][0].lang_pred == "und"
    assert sorted(r.lang_pred for r in found[None]) == ["en", "en", "und"]


def test_runs_and_fingerprints(docs):
    runs = by_id(period_runs.collapse_runs(docs, plant=True))
    assert sorted(r.n_runs for r in runs[None]) == [0, 0, 0] and runs[1][0].collapsed is not None
    prints = by_id(edit_prints.fingerprints(docs))
    assert prints[1][0].n_chars == len(LONG) and sorted(r.n_chars for r in prints[None]) == [0, len(WORDS), len(WORDS)] and len({r.fingerprint for r in prints[None]}) == 2
