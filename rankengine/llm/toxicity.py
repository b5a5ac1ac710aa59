"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Each word has a weight: its log-odds of standing in a toxic rather than another labelled text, counted by documents, with
a Dirichlet prior in proportion to the word's share of all labelled documents. What BOUND standard deviations leave of
the log-odds counts, towards toxic or away from it; the rest may be chance. A word that the sample lacks, or for which
nothing is left, takes the weight of its beginning (STEM letters and more follow). Every word costs GAP, so random text
has a negative drift. A linear scan finds all maximal scoring segments of a text; those whose expected number in random
text of that length (K m exp(-lambda S)) is below E_VALUE are its significant passages. Lambda and K are fitted to the
best segments of clean labelled texts (Gumbel, by moments). The evidence of all significant passages (sum of -ln E,
positive parts) goes through a logistic curve fitted to the labelled sample.

The sample is bounded in rows (about SAMPLE_ROWS, documented bound of the fit); their texts, like those that are scored,
are read whole. Null and empty texts have no passage and get the curve's value at no evidence. Ties: repeated rows are
judged alike; labels of one doc_id count as toxic if one of them is. An empty table gives an empty result; extra columns
are dropped. Without labels of both kinds every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import staging
from .words import ALNUM_LOWER, encode_words, pieces, split_words

#: About as many labelled rows as the model is fitted on: those whose text hashes lowest.
SAMPLE_ROWS = 20_000
#: Weight of the prior, in documents; standard deviations that may be chance; letters of a stem.
PRIOR = 20.0
BOUND = 3.0
STEM = 4
GAP = 0.3
E_VALUE = 1.0
MAX_WEIGHT = 4.0


def segments(places: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a text, given the `places` of its words with a
    positive weight and the total weight of the text before and after each.

    One pass: each candidate knows the nearest earlier one that begins lower, so no candidate is passed over twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    for p, x, y in zip(places.tolist(), before.tolist(), after.tolist(), strict=True):
        a, k = p, len(first) - 1
        while True:
            while k >= 0 and low[k] >= x:
                k = back[k]
            if k < 0 or high[k] >= y:
                break
            # the candidate reaches over everything from candidate k on
            a, x, further = first[k], low[k], back[k]
            for held in (first, last, low, high, back):
                del held[k:]
            k = further
        first.append(a)
        last.append(p)
        low.append(x)
        high.append(y)
        back.append(k)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 0.0
    shift: float = 0.0
    share: float = 0.0

    def passages(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
        """Words per text, and its significant passages (first word, end, score, E-value)."""
        words, first = split_words(texts, ALNUM_LOWER)
        codes, distinct = encode_words(words)
        size = np.diff(first)
        out: list[list[tuple[int, int, float, float]]] = [[] for _ in range(len(texts))]
        if not len(codes) or not self.words:
            return size, out
        values = pa.array(self.words)
        at = pc.coalesce(pc.index_in(distinct, value_set=values), pc.index_in(_stems(distinct), value_set=values), pa.scalar(-1, pa.int32()))
        weight = np.append(self.weights, 0.0)[at.to_numpy(zero_copy_only=False)][codes] - GAP
        total = np.cumsum(weight)
        place = np.flatnonzero(weight > 0)
        doc = np.searchsorted(first, place, "right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(doc)]]).tolist(), strict=True):
            if a < b:
                d, p = int(doc[a]), place[a:b]
                for i, j, s in segments(p - first[d], total[p] - weight[p], total[p]):
                    s = round(s, 9)  # noqa: PLW2901  sums over the batch differ in the last digits
                    e = self.scale * size[d] * np.exp(-self.rate * s)
                    out[d].append((i, j + 1, s, float(e)))
        return size, out

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        return float(sum(-np.log(max(e, 1e-300)) - np.log(1 / E_VALUE) for *_, e in found if e < E_VALUE))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.full(len(evidence), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -30, 30)))


def _stems(words: pa.StringArray) -> pa.StringArray:
    """The beginning of each word with a sign that no word has after it, null for words that end there."""
    longer = pc.greater(pc.utf8_length(words), STEM)
    return pc.if_else(longer, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, STEM), "*", ""), pa.scalar(None, pa.string()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or stem, toxic, documents) of each batch."""
    for batch in batches:
        for piece in pieces(batch):
            words, first = split_words(piece.column("text"), ALNUM_LOWER)
            codes, distinct = encode_words(words)
            if not len(codes):
                continue
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(toxic)), np.diff(first))
            stem_codes, stems = encode_words(_stems(distinct).fill_null(""))
            for features, of in ((distinct, codes), (stems, stem_codes[codes])):
                pairs = np.unique(doc * len(features) + of)
                kind, feature = toxic[pairs // len(features)], pairs % len(features)
                for k in (0, 1):
                    n = np.bincount(feature[kind == k], minlength=len(features))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([features.take(pa.array(some)), pa.array(np.full(len(some), k)), pa.array(n[some])], ["word", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame, where: Column) -> Model:
    """Fits on labelled rows of `docs` that meet `where`, copies of a text with one label counted once."""
    spark = docs.sparkSession
    labelled = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(where & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("h")).join(labelled, "doc_id")
    there = labelled.count()
    share = min(1.0, SAMPLE_ROWS * 1.5 / max(there, 1))
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(share * (1 << 30))).groupBy("h", "toxic").agg(F.min("text").alias("text"))
    sample = staging.staged(sample, "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(share=n1 / max(n1 + n0, 1))
    if not n1 or not n0:
        return model
    counts = sample.select("text", "toxic").mapInArrow(_counts, "word string, toxic bigint, n bigint").where("word <> ''").groupBy("word").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"))
    prior = (F.col("a") + F.col("b")) * F.lit(PRIOR / (n1 + n0))
    a, b = F.col("a") + prior, F.col("b") + prior
    odds = F.log(a / (F.lit(n1 + PRIOR) - a)) - F.log(b / (F.lit(n0 + PRIOR) - b))
    spread = F.sqrt(1 / a + 1 / b)
    left = F.signum(odds) * F.greatest(F.abs(odds) - BOUND * spread, F.lit(0.0))
    rows = counts.select("word", left.alias("w")).where("w <> 0").orderBy("word").collect()  # bounded by the sample
    model.words, model.weights = [r["word"] for r in rows], np.clip([r["w"] for r in rows], -MAX_WEIGHT, MAX_WEIGHT)
    if not rows:
        return model
    found = _measured(sample, spark.sparkContext.broadcast(model)).collect()  # a few numbers for each row of the sample
    clean = np.array([r["best"] for r in found if not r["toxic"]])
    size = np.array([r["size"] for r in found if not r["toxic"]], float)
    # Gumbel of the best score: lambda from the spread, K from the mean
    spread = max(float(clean.std()), 0.5)
    model.rate = float(np.pi / (spread * np.sqrt(6)))
    model.scale = float(np.exp(model.rate * clean.mean() - np.mean(np.log(np.maximum(size, 1))) - 0.5772))
    found = _measured(sample, spark.sparkContext.broadcast(model)).collect()
    x = np.log1p(np.array([r["evidence"] for r in found]))
    y = np.array([float(r["toxic"]) for r in found])
    model.slope, model.shift = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic curve, by Newton steps."""
    z = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _measured(sample: DataFrame, sent) -> DataFrame:
    """toxic, size, best segment and evidence of each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in pieces(batch):
                size, found = model.passages(piece.column("text"))
                best, evidence = [max((s for _, _, s, _ in f), default=0.0) for f in found], [model.evidence(f) for f in found]
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(size), pa.array(best, pa.float64()), pa.array(evidence, pa.float64())], ["toxic", "size", "best", "evidence"])

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, size bigint, best double, evidence double")


def _judge(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for piece in pieces(batch):
                _, found = model.passages(piece.column("text"))
                score = model.score(np.array([model.evidence(f) for f in found]))
                shown = [[{"first": a, "end": b, "score": s, "e_value": e} for a, b, s, e in f if e < E_VALUE] for f in found]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.array(shown, kind)], ["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (word ranges with score and E-value), one row for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_judge(sent), f"doc_id {kind}, score double, passages array<struct<first: bigint, end: bigint, score: double, e_value: double>>")
