"""Hard negatives by exact integer inner products: tiles of anchors against all rows, Strassen products, mergeable heaps.

Anchors are dealt to blocks of at most BLOCK_BYTES, so what is sent to the executors at once is bounded whatever their
number. For each block all rows are read twice, in tiles:

1. a tile's products with the anchors of its own labels feed a heap of the best positives of each anchor;
2. with these known, the products with all anchors feed a heap for each anchor and positive, which takes rows of other
   labels whose score lies in the window below the positive's.

A task hands on its heaps only; heaps of several tasks are merged in a ranked window over (anchor, positive), which holds
a few rows of each task. Products are Strassen's: seven products of half the size in place of eight, tiles padded with
zeros to even sides; on 64-bit integers every sum is exact.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Rows count each
by itself: a repeated row, under whatever vec_id, is another row; equal anchors have equal results each. A null vec_id
is no anchor, and the last among ties. Vectors of different lengths are padded with zeros, an empty one has the score 0
with any. Scores are exact while they fit in 64 bits. Other columns aren't looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from . import staging

#: Bytes of anchor vectors in a block, rows of a tile, anchors that meet a tile at a time.
BLOCK_BYTES = 64 << 20
TILE_ROWS, TILE_ANCHORS = 4096, 512
#: Products with a side up to the first, or of so many terms, are made plainly.
LEAF, SMALL = 8, 1 << 18
#: Products of components that a task makes about.
WORK = 1 << 34
_NONE = -(2**63 - 1)
_LAST = 2**63 - 1


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and q, the components floor(scale * x); rows that take no part are left out."""
    odd = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd))
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf or m * k * n <= SMALL:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, o = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :o], b[:j, o:], b[j:, :o], b[j:, o:]
    out = np.empty((2 * i, 2 * o), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :o], out[i:, o:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    out[i:, :o] = p
    out[i:, o:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:i, o:] = p
    out[i:, o:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:i, :o] += p
    out[i:, :o] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:i, :o] -= p
    out[:i, o:] += p
    out[i:, o:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :o] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps:
    """The first `size` (score, id) of each of `n` lists: greater scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.scores = np.full((n, size), _NONE, np.int64)
        self.ids = np.full((n, size), _LAST, np.int64)

    def floor(self, lists: np.ndarray) -> np.ndarray:
        """The least score that may still enter each of `lists`."""
        return self.scores[lists, -1]

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A row of `scores` for each of `lists`, a column for each of `ids`, which ascend; _NONE where nothing is offered.
        `scores` is used up."""
        size = self.scores.shape[1]
        best, who, each = [self.scores[lists]], [self.ids[lists]], np.arange(len(lists))
        for _ in range(min(size, scores.shape[1])):
            at = scores.argmax(axis=1)  # of equal scores the first, which has the smallest id
            best.append(scores[each, at][:, None])
            who.append(ids[at][:, None])
            scores[each, at] = _NONE
            if not (best[-1] > _NONE).any():
                break
        best, who = np.concatenate(best, axis=1), np.concatenate(who, axis=1)
        order = np.lexsort((who, -best), axis=1)[:, :size]
        self.scores[lists] = np.take_along_axis(best, order, 1)
        self.ids[lists] = np.take_along_axis(who, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list, score and id of each entry."""
        at, nth = np.nonzero(self.scores > _NONE)
        return at, self.scores[at, nth], self.ids[at, nth]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    values = np.asarray(column.flatten(), dtype=np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids (ascending), row keys, labels and vectors, TILE_ROWS rows at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            ids = np.asarray(part.column("id"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], np.asarray(part.column("row"))[order], np.asarray(part.column("label"))[order], _matrix(part.column("q"), width)[order]


def _positives(block, width: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, vectors = (block.value[k] for k in ("row", "label", "q"))
        heaps = Heaps(len(rows), size)
        for ids, keys, kinds, tile in _tiles(batches, width):
            for kind in np.intersect1d(labels, kinds):
                mine = np.flatnonzero(kinds == kind)
                for who in np.array_split(of := np.flatnonzero(labels == kind), len(of) // TILE_ANCHORS + 1):
                    scores = strassen(vectors[who], tile[mine].T)
                    scores[(rows[who, None] == keys[mine]) | (scores < heaps.floor(who)[:, None])] = _NONE
                    some = (scores > _NONE).any(axis=1)
                    if some.any():
                        heaps.offer(who[some], scores[some], ids[mine])
        at, scores, found = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(block.value["n"][at]), pa.array(scores), pa.array(found)], ["n", "score", "id"])

    return run


def _window(block, width: int, size: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors, tops = (block.value[k] for k in ("label", "q", "tops"))
        places = tops.shape[1]
        heaps = Heaps(len(labels) * places, size)
        known = tops > _NONE
        least = np.where(known, -(-low * np.where(known, tops, 0) // 100), _LAST)
        most = np.where(known, high * np.where(known, tops, 0) // 100, _NONE)
        for ids, _, kinds, tile in _tiles(batches, width):
            for who in np.array_split(np.arange(len(labels)), len(labels) // TILE_ANCHORS + 1):
                scores = strassen(vectors[who], tile.T)
                scores[labels[who, None] == kinds] = _NONE
                near = (scores >= least[who].min(axis=1)[:, None]).any(axis=1)
                who, scores = who[near], scores[near]
                for k in range(places):
                    lists = who * places + k
                    bottom = np.maximum(least[who, k], heaps.floor(lists))
                    fits = (scores >= bottom[:, None]) & (scores <= most[who, k][:, None])
                    some = fits.any(axis=1)
                    if some.any():
                        heaps.offer(lists[some], np.where(fits[some], scores[some], _NONE), ids)
        at, scores, found = heaps.rows()
        who, k = at // places, at % places
        yield pa.RecordBatch.from_arrays([pa.array(block.value["n"][who]), pa.array((k + 1).astype(np.int32)), pa.array(scores), pa.array(found)], ["n", "k", "score", "id"])

    return run


def _merged(heaps: DataFrame, keys: list[str], size: int, out: str) -> DataFrame:
    """The heaps of all tasks as one of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc())
    return heaps.withColumn(out, F.row_number().over(w)).where(F.col(out) <= size)


def _vec_id(c: str, name: str) -> Column:
    return F.nullif(F.col(c), F.lit(_LAST)).alias(name)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, q).

    An anchor's positives are its first `positives` other rows of its label. For each of them come the first `negatives`
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. See the module for
    nulls, ties and repeated rows.
    """
    spark = rows.sparkSession
    chosen = F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    kept = rows.select(F.coalesce("vec_id", F.lit(_LAST)).cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q", chosen.alias("anchor"))
    kept = staging.staged(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, anchors, width = kept.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("q"))).first()
    width = max(width or 0, 1)
    whole = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not anchors:
        return spark.createDataFrame([], whole)
    per_block = max(1, BLOCK_BYTES // (8 * width))
    numbered = global_row_number(kept.where("anchor"), [F.col(c).asc() for c in ("id", "row")], "n", rows=anchors)
    numbered = staging.staged(numbered.withColumn("block", F.expr(f"(n - 1) div {per_block}")), "anchors")
    out = staging.new_path(spark, "hard-negatives")
    for number in range((anchors - 1) // per_block + 1):
        _mine_block(kept, numbered.where(F.col("block") == number), total, width, positives, negatives, low, high).write.parquet(f"{out}/block={number}")
    found = spark.read.parquet(out)
    return found.select(_vec_id("anchor", "anchor_id"), _vec_id("positive", "positive_id"), "rank", _vec_id("id", "negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _mine_block(kept: DataFrame, anchors: DataFrame, total: int, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The rows of a block of anchors, which is small enough to be sent to every executor."""
    context = kept.sparkSession.sparkContext
    table = anchors.select("n", "id", "row", "label", "q").orderBy("n").toArrow().combine_chunks()
    block = {k: table[k].to_numpy() for k in ("n", "id", "row", "label")} | {"q": _matrix(table["q"].combine_chunks(), width)}
    work = total * len(block["n"]) * width
    parts = max(work // WORK, min(context.defaultParallelism, work >> 26)) + 1
    dealt = kept.select("id", "row", "label", "q").repartition(parts)
    first = _merged(dealt.mapInArrow(_positives(context.broadcast(block), width, positives), "n bigint, score bigint, id bigint"), ["n"], positives, "k")
    first = staging.staged(first, "positives")
    top = first.toArrow()  # `positives` rows an anchor at most
    at = top["n"].to_numpy() - block["n"][0], top["k"].to_numpy() - 1
    block["tops"] = np.full((len(block["n"]), positives), _NONE, np.int64)
    block["tops"][at] = top["score"].to_numpy()
    heaps = dealt.mapInArrow(_window(context.broadcast(block), width, negatives, low, high), "n bigint, k int, score bigint, id bigint")
    named = first.select("n", "k", F.col("id").alias("positive"), F.col("score").alias("positive_score")).join(anchors.select("n", F.col("id").alias("anchor")), "n")
    return _merged(heaps, ["n", "k"], negatives, "rank").join(named, ["n", "k"])
