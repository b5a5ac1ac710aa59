"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of a benchmark item (an item of fewer words, but not none, is one window). Its
shingles of SHINGLE words are ordered by how often documents hold them; containment needs all of them, so the rarest
one is a sufficient prefix. Places where a document holds a prefix shingle are joined with the windows that have it;
positional and length bounds drop those that would reach over an end of the document; the rest is verified word by word.

The benchmark is a table like any other: windows, shingles and their counts stay distributed. Documents are filtered by
a Bloom filter of the shingles, whose size is bounded by MOST_BITS (16 MB) whatever the benchmark's size; beyond about
20 million shingles it lets more places pass, which the join drops, so results don't depend on it.

Null or empty texts have no words and hold nothing; empty items make no window; the windows of an item without an id
count as hits, but there is no id to list. Repeated rows are judged alike, each for itself, whatever their doc_id; of
tied shingles the one with the least hash is the prefix. Texts of any length are read whole. An empty benchmark hits
nothing, and an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import staging
from .words import ALNUM_LOWER, encode_words, hash_words, mix, pieces, split_words

SHINGLE = 3
#: Bits of the filter for each shingle, and at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 20, 27
_SHIFTS = (0, 12, 24, 36)


class Words:
    """The words of some texts, their hashes, and the shingle that begins at each."""

    def __init__(self, texts: pa.Array):
        self.words, self.first = split_words(texts, ALNUM_LOWER)
        codes, distinct = encode_words(self.words)
        self.hashes = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.left = self.first[1:][self.doc] - np.arange(len(self.doc))  # words from here to the text's end

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places that have `size` words before the text's end, and the hash of these words."""
        at = np.flatnonzero(self.left >= size)
        acc = np.full(len(at), np.uint64(size))
        for k in range(size):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + self.hashes[at + k])
        return at, acc.view(np.int64)


class ShingleFilter:
    """A Bloom filter; `sizes`: lengths of the shingles in it (those of items that are shorter than SHINGLE, too)."""

    def __init__(self, shingles: DataFrame):
        """`shingles`: shingle, size; distinct."""
        counts = {r["size"]: r["n"] for r in shingles.groupBy("size").agg(F.count("*").alias("n")).collect()}
        self.sizes = sorted(counts)
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(sum(counts.values()) * BITS_EACH).bit_length()))
        place = [F.shiftrightunsigned("shingle", s).bitwiseAND(F.lit((1 << self.bits) - 1)) + 1 for s in _SHIFTS]
        each = shingles.select(F.explode(F.array(*place)).alias("bit"))
        # at most 2 ** MOST_BITS bits in all
        rows = each.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        self.data = np.zeros(1 << self.bits - 3, np.uint8)
        for r in rows:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            at = (r["bucket"] - 1) * len(part)
            self.data[at : at + len(part)] = part[: len(self.data) - at]

    def has(self, shingle: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingle), bool)
        for s in _SHIFTS:
            bit = (shingle.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << self.bits) - 1)
            out &= (self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, size of its shingles, words, shingle at each place; items without words are left out."""
    for batch in batches:
        for piece in pieces(batch):
            w = Words(piece.column("text"))
            for i, (a, b) in enumerate(zip(w.first, w.first[1:], strict=False)):
                if a < b:
                    size = min(SHINGLE, b - a)
                    one = Words(piece.column("text").slice(i, 1))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("item").slice(i, 1), pa.array([size], pa.int32()), pa.array([one.words.to_pylist()]), pa.array([one.shingles(size)[1].tolist()], pa.list_(pa.int64()))],
                        ["item", "size", "words", "shingles"],
                    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (text of the id), size, words, shingles; a row for each item with words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_words, "item string, size int, words array<string>, shingles array<bigint>")
    return staging.staged(rows, "overlap-items")


def _counter(sent) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in pieces(batch):
                w = Words(piece.column("text"))
                for size in known.sizes:
                    _, shingle = w.shingles(size)
                    found, n = np.unique(shingle[known.has(shingle)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    return count


def prefixed_windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, shingle (the rarest of the window), offset of it, n words, run (the words, joined by spaces)."""
    keyed = items.select(F.monotonically_increasing_id().alias("key"), "item", "size", "words", "shingles")
    keyed = staging.staged(keyed, "overlap-keyed")
    places = keyed.select("key", F.posexplode("shingles").alias("pos", "shingle")).join(counts, "shingle", "left")
    inside = Window.partitionBy("key").orderBy("pos").rowsBetween(0, max(window - SHINGLE, 0))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "pos")).over(inside)
    starts = places.select("key", "pos", rarest.alias("x")).join(keyed.select("key", "item", "words"), "key")
    # the window that begins at the last places would reach over the item's end
    starts = starts.where((F.col("pos") == 0) | (F.col("pos") + window <= F.size("words")))
    run = F.slice("words", F.col("pos") + 1, F.lit(window))
    return starts.select("item", F.col("x.shingle").alias("shingle"), (F.col("x.pos") - F.col("pos")).alias("offset"), F.size(run).alias("n"), F.array_join(run, " ").alias("run"))


def _matcher(sent, window: int) -> Callable:
    """A row for each document (n_words), and one for each place with a prefix shingle (its words, `at` from the first)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = ["row", "doc_id", "n_words", "shingle", "pos", "at", "around"]
        for batch in batches:
            for piece in pieces(batch):
                w = Words(piece.column("text"))
                n, row = piece.num_rows, piece.column("row")
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([row, piece.column("doc_id"), pa.array(np.diff(w.first)), *none], names)
                for size in known.sizes:
                    at, shingle = w.shingles(size)
                    some = known.has(shingle)
                    at, shingle = at[some], shingle[some]
                    doc = w.doc[at]
                    low, high = np.maximum(at - window + 1, w.first[doc]), np.minimum(at + window, w.first[doc + 1])
                    around = [" ".join(w.words.slice(a, b - a).to_pylist()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [row.take(pa.array(doc)), pa.nulls(len(at), piece.column("doc_id").type), pa.nulls(len(at), pa.int64()), pa.array(shingle), pa.array(at - w.first[doc]), pa.array((at - low).astype(np.int32)), pa.array(around, pa.string())], names
                    )

    return match


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (texts of the item_ids, sorted), spans
    (word ranges of the union of occurrences), for each row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark_items(benchmark)
    every = items.select(F.explode("shingles").alias("shingle"), "size").distinct()
    sent = spark.sparkContext.broadcast(ShingleFilter(every))
    counts = docs.select("text").mapInArrow(_counter(sent), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    windows = staging.staged(prefixed_windows(items, staging.staged(counts, "overlap-counts"), window), "overlap-windows")
    runs = windows.select("shingle", "offset", "n", "run").distinct()
    prefixes = windows.select("shingle", F.least("n", F.lit(SHINGLE)).alias("size")).distinct()
    sent = spark.sparkContext.broadcast(ShingleFilter(prefixes))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = staging.staged(rows.mapInArrow(_matcher(sent, window), f"row bigint, doc_id {kind}, n_words bigint, shingle bigint, pos bigint, at int, around string"), "overlap-rows")

    begin = F.col("at") - F.col("offset")
    found = rows.where("around is not null").join(runs, "shingle").where(begin >= 0)
    same = F.array_join(F.slice(F.split("around", " "), begin + 1, F.col("n")), " ") == F.col("run")
    hits = found.where(same).select("row", (F.col("pos") - F.col("offset")).alias("start"), (F.col("pos") - F.col("offset") + F.col("n")).alias("end"), "run")
    hits = staging.staged(hits, "overlap-hits")
    ids = hits.select("row", "run").distinct().join(windows.select("run", "item").distinct(), "run")
    ids = ids.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.where("around is null").select("row", "doc_id", "n_words").join(_spans(hits), "row", "left").join(ids, "row", "left")
    none = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), none("items", "array<string>"), none("spans", "array<array<bigint>>"))


def _spans(hits: DataFrame) -> DataFrame:
    """row, n_hit, spans: the union of the ranges of each row."""
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = hits.select("row", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    parts = parts.withColumn("part", F.sum("new").over(order)).groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed: Column = F.array_sort(F.collect_list(F.array("start", "end")))
    return parts.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), listed.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
