"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and connected components.

A document's set holds its distinct shingles of `width` words (fewer words: the whole sequence as one; none: an empty
set, linked with nothing). Documents with percent * |union| <= 100 * |intersection| are linked.

1. Every document gets its set's size, a 128-bit key of the set, and the band hashes of its SuperMinHash signature. Equal
   sets form a class that the smallest doc_id represents, so copies are never compared.
2. Representatives that share a band hash form a bucket. Each is compared with the bucket's pivot, the member with the
   least hash, which near copies have in common over many buckets. Confirmed links give components.
3. In buckets that still hold several components, documents outside the commonest one are compared with all others by an
   index of shingles; buckets with the same members are searched once. A document that lacks the rarest shingles of
   another one (one more than a linked document may lack) isn't compared with it. So no pair of different components
   that shares a bucket is left out, and no pair is listed that isn't a link.
4. Links are confirmed on full sets, recomputed from the texts. Groups are bounded in rows and bytes: members of a large
   bucket meet in pairs of chunks, which is quadratic only in near copies of one bucket that are not linked.
5. Components come from union-find inside bounded partitions of the links; what is left between partitions is joined by
   alternating steps to the smallest neighbour.

With the parameters that `Banding.at` picks, two linked documents share no bucket with probability under `miss` (1e-6)
at the threshold and less above it; banding with one row a band and more bands lowers that further. Where no banding of
MOST_SLOTS slots reaches `miss` (thresholds under 7 percent), it raises ValueError.

Null texts are empty. Ties: of equal sets and in a component the least doc_id stands for the others. Rows that repeat a
doc_id are one document, whose sets all count. A row with a null doc_id is a document of its own: its component_id is the
least doc_id of its component (null if no row there has one), and it is kept only if none has one and it is the
component's first such row, by the hash of its text. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import staging
from .words import BLANK_LOWER, encode_words, hash_words, mix, pieces, split_words

_GOLDEN = 0x9E3779B97F4A7C15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Levels walked with short histories before the rest gets whole permutations, and elements of those at a time.
_WALK = 10
_ROWS = 20_000
#: Slots of a signature at most (places of a permutation are single bytes).
MOST_SLOTS = 192
#: Text and rows that a group of comparisons gets about, and that a chunk of a bucket holds about.
GROUP_BYTES, GROUP_ROWS = 8 << 20, 2000
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 500
#: Links that a task of union-find takes at most.
EDGES = 1_000_000


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    @classmethod
    def at(cls, percent: int, miss: float = 1e-6) -> Banding:
        """Longest bands, then fewest, with a miss probability under `miss` at the threshold and at most MOST_SLOTS slots."""
        for rows in range(12, 0, -1):
            same = (percent / 100) ** rows
            bands = 1 if same >= 1 else int(np.ceil(np.log(miss) / np.log1p(-same)))
            if bands * rows <= MOST_SLOTS:
                return cls(bands, rows)
        raise ValueError(f"no banding of {MOST_SLOTS} slots finds pairs of {percent} % with a miss probability under {miss}")


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in one array, and where each text's begin."""
    words, first = split_words(texts, BLANK_LOWER)
    codes, distinct = encode_words(words)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = hash_words(distinct)[codes]
    n = np.diff(first)
    acc = np.full(len(h), np.uint64(width))
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        acc = mix(acc * np.uint64(_GOLDEN) + part)
    keep = np.zeros(len(h), bool)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if n[d] >= width:
            keep[a : b - width + 1] = True
        elif n[d]:
            whole = np.full(1, n[d], np.uint64)
            for i in range(a, b):
                whole = mix(whole * np.uint64(_GOLDEN) + h[i : i + 1])
            acc[a], keep[a] = whole[0], True
    doc = np.repeat(np.arange(len(n)), n)[keep]
    flat = acc[keep]
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signature of each set: slot s holds the least (level, random) over elements whose permutation puts s at that level.

    Level j of an element draws a random number and the next place of its Fisher-Yates permutation. Levels run for all
    sets at once; a set stops when all its slots are filled below the level, as later ones can't be less.
    """
    n_sets = len(bounds) - 1
    held = np.full(n_sets * slots, _ALL)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        random = mix(x + np.uint64(j * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        place = j + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        return (random >> np.uint64(32)) | np.uint64(j << 32), place

    def open_sets(level: int, sets: np.ndarray) -> np.ndarray:
        out = np.zeros(n_sets, bool)
        out[sets] = (held.reshape(n_sets, slots)[sets] >= np.uint64(level << 32)).any(axis=1)
        return out

    past: list[np.ndarray] = []
    live = np.unique(owner)
    for j in range(min(slots, _WALK)):
        value, place = draw(elements, j)
        slot = place.copy()
        for i in range(j - 1, -1, -1):
            slot = np.where(slot == past[i], i, slot)
        np.minimum.at(held, owner * slots + slot, value)
        still = open_sets(j + 1, live)
        live = np.flatnonzero(still)
        if not len(live):
            return held.reshape(n_sets, slots)
        on = still[owner]
        elements, owner = elements[on], owner[on]
        past = [x[on] for x in [*past, place]]
    at = 0
    while at < len(elements) and slots > _WALK:
        # whole sets, about _ROWS elements
        to = int(np.searchsorted(owner, owner[min(at + _ROWS, len(owner)) - 1], "right"))
        x, own, rows = elements[at:to], owner[at:to], np.arange(to - at)
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
        for i, p in enumerate(past):
            p = p[at:to]
            perm[rows, p], perm[:, i] = perm[:, i].copy(), perm[rows, p]
        live = np.unique(own)
        for j in range(_WALK, slots):
            value, place = draw(x, j)
            slot = perm[rows, place].astype(np.int64)
            perm[rows, place] = perm[:, j]
            perm[:, j] = slot
            np.minimum.at(held, own * slots + slot, value)
            still = open_sets(j + 1, live)
            live = np.flatnonzero(still)
            if not len(live):
                break
            on = still[own]
            if on.sum() < 0.7 * len(on):
                x, own, perm = x[on], own[on], perm[on]
                rows = np.arange(len(x))
        at = to
    return held.reshape(n_sets, slots)


def band_hashes(signatures: np.ndarray, banding: Banding) -> np.ndarray:
    out = np.empty((len(signatures), banding.bands), np.uint64)
    for b in range(banding.bands):
        acc = np.full(len(signatures), np.uint64(b + 1))
        for r in range(banding.rows):
            acc = mix(acc * np.uint64(_GOLDEN) + signatures[:, b * banding.rows + r])
        out[:, b] = acc
    return out


def _signer(width: int, banding: Banding) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                flat, bounds = shingle_sets(piece.column("text"), width)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                one, two = mix(flat), mix(flat ^ np.uint64(_GOLDEN))
                sums = np.zeros((2, len(size)), np.uint64)
                if len(flat):
                    sums[0, some], sums[1, some] = np.add.reduceat(one, bounds[some]), np.add.reduceat(two, bounds[some])
                tight = np.concatenate([[0], np.cumsum(size[some])])
                hashes = band_hashes(super_minhash(flat, tight, banding.bands * banding.rows), banding).view(np.int64)
                lengths = np.zeros(len(size), np.int64)
                lengths[some] = banding.bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(hashes.ravel()))
                volume = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), volume, lists], ["doc_id", "n", "k1", "k2", "bytes", "bands"])

    return sign


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links (u, v) of one partition: each node but the smallest of its component, with the smallest."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = at[: len(table)], at[len(table) :]
    root = np.arange(len(names))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(names)))
    kind = table.schema.field("u").type
    for i in range(0, len(low), 1 << 16):
        part = low[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(names[part], kind), pa.array(names[root[part]], kind)], ["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) that isn't the smallest of its component: the smallest.

    Each partition of at most about EDGES links is contracted to a forest. While there are several partitions, two steps
    that join nodes to smaller neighbours follow, until no link changes; every round is written out.
    """
    edges = staging.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    kind = edges.schema["u"].dataType.simpleString()
    before = None
    while True:
        tasks = edges.count() // EDGES + 1
        edges = staging.staged(edges.coalesce(tasks).mapInArrow(_forest, f"u {kind}, v {kind}"), name)
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = staging.staged(edges.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = staging.staged(small.where("u <> v").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _searcher(width: int, percent: int) -> Callable:
    """Links between queries (`out`) and members of other components, group by group (`g`): one for each query and
    component."""

    def search(table: pa.Table) -> pa.Table:
        kind = table.schema.field("doc_id").type
        a: list = []
        b: list = []
        # a document that stands in several groups is split into shingles once
        names, first, which = np.unique(table["doc_id"].to_numpy(), return_index=True, return_inverse=True)
        sets, sizes = [], []
        for batch in table.select(["text"]).take(pa.array(first)).combine_chunks().to_batches():
            for piece in pieces(batch):
                flat, bounds = shingle_sets(piece.column("text"), width)
                sets += np.split(flat, bounds[1:-1])
                sizes += np.diff(bounds).tolist()
        component, out, g = (table[c].to_numpy() for c in ("c", "out", "g"))
        order = np.argsort(g, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            asked, held = rows[out[rows]], rows[~out[rows]]
            if not len(asked) or not len(held):
                continue
            size = np.array([sizes[i] for i in which[held]])
            flat = np.concatenate([sets[i] for i in which[held]])
            owner = np.repeat(np.arange(len(held)), size)
            if len(asked) > 1:
                by = np.argsort(flat, kind="stable")
                flat, owner = flat[by], owner[by]
            for q in asked.tolist():
                x = sets[which[q]]
                near = (component[held] != component[q]) & (100 * np.minimum(size, len(x)) >= percent * np.maximum(size, len(x)))
                if not len(x) or not near.any():
                    continue
                if len(asked) == 1:
                    both = np.bincount(owner[x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat], minlength=len(held))
                else:
                    low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                    # a linked set lacks at most len(x) - need of the query's shingles, so it has one of the rarest here
                    need = -(-percent * len(x) // 100)
                    rare = np.argsort(high - low, kind="stable")[: len(x) - need + 1].tolist()
                    some = np.zeros(len(held), bool)
                    some[np.concatenate([owner[low[i] : high[i]] for i in rare])] = True
                    if not (some & near).any():
                        continue
                    both = np.bincount(np.concatenate([owner[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]), minlength=len(held))
                hit = np.flatnonzero(near & (both > 0) & (100 * both >= percent * (size + len(x) - both)))
                for m in hit[np.unique(component[held[hit]], return_index=True)[1]].tolist():
                    pair = names[which[q]], names[which[held[m]]]
                    a.append(min(pair))
                    b.append(max(pair))
        return pa.table([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return search


def _found(sides: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Links among `sides` (g, doc_id, c, out, bytes): rows of one g meet, about GROUP_BYTES and GROUP_ROWS in a task."""
    total = sides.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    groups = max(32, total["n"] // GROUP_ROWS + (total["bytes"] or 0) // GROUP_BYTES + 1)
    kind = sides.schema["doc_id"].dataType.simpleString()
    rows = sides.drop("bytes").withColumn("key", F.pmod("g", F.lit(groups))).join(texts, "doc_id")
    return staging.staged(rows.groupBy("key").applyInArrow(_searcher(width, percent), f"a {kind}, b {kind}"), name)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs`, written, with `row`: a key of each row."""
    return staging.staged(docs.withColumn("row", F.monotonically_increasing_id()), name)


def first_row() -> Column:
    """Order of the rows of a group: by doc_id, null last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("row"))


def _by_rows(docs: DataFrame, width: int, percent: int, banding: Banding) -> DataFrame:
    """near_duplicates of each row by itself; then rows of one doc_id are made one document."""
    rows = numbered(docs, "near-rows")
    found = row_groups(rows.select(F.col("row").alias("doc_id"), "text"), width, percent, banding)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("c"))
    found = staging.staged(rows.select("row", "doc_id", F.xxhash64("text").alias("h")).join(found, "row"), "near-found")
    least = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("b"))
    of = components(found.join(least, "doc_id").select(F.col("c").alias("a"), "b"), "near-ids")
    found = found.join(of.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("c", F.coalesce("component", "c"))
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.struct("h", "row")))
    groups = found.groupBy("c").agg(F.min("doc_id").alias("component_id"), nameless.alias("first"))
    kept = F.when(F.col("component_id").isNull(), F.col("row") == F.col("first.row")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.join(groups, "c").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, banding: Banding | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the first of its component), one row for each row of `docs`."""
    banding = banding or Banding.at(percent)
    docs = docs.select("doc_id", "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    return _by_rows(docs, width, percent, banding) if odd else row_groups(docs, width, percent, banding)


def row_groups(docs: DataFrame, width: int, percent: int, banding: Banding) -> DataFrame:
    """near_duplicates of `docs` whose doc_id is a key."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = staging.staged(docs.mapInArrow(_signer(width, banding), f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, bytes bigint, bands array<bigint>"), "near-signed")
    same = ["k1", "k2", "n"]
    first = F.min(F.struct("doc_id", "bytes", "bands")).alias("x")
    classes = staging.staged(signed.where("n > 0").groupBy(*same).agg(first).select(*same, F.col("x.doc_id").alias("rep"), "x.bytes", "x.bands"), "near-classes")

    each = classes.select("rep", "bytes", F.xxhash64("rep").alias("h"), F.explode("bands").alias("bucket"))
    buckets = each.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("bytes").alias("volume"), F.min_by("rep", "h").alias("pivot")).where("m > 1")
    cells = staging.staged(each.join(staging.staged(buckets, "near-buckets"), "bucket"), "near-cells")
    wanted = cells.select(F.col("rep").alias("doc_id")).distinct()
    texts = staging.staged(docs.join(wanted, "doc_id", "left_semi"), "near-texts")

    def chunks(rows: str, volume: str) -> Column:
        return F.greatest(F.expr(f"{rows} div {CHUNK_ROWS}"), F.expr(f"{volume} div {CHUNK_BYTES}")) + 1

    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks"))
    tried = cells.where("rep <> pivot").groupBy("pivot", "rep").agg(F.max("bytes").alias("bytes"), F.max(chunks("m", "volume")).alias("chunks"))
    tried = staging.staged(tried.select(F.xxhash64("pivot", own).alias("g"), "pivot", F.col("rep").alias("doc_id"), "bytes"), "near-tried")
    pivots = tried.select("g", F.col("pivot").alias("doc_id")).distinct()
    sides = tried.select("g", "doc_id", F.col("doc_id").alias("c"), F.lit(False).alias("out"), "bytes")
    sides = sides.unionByName(pivots.select("g", "doc_id", F.col("doc_id").alias("c"), F.lit(True).alias("out"), F.lit(0).cast("long").alias("bytes")))
    links = _found(sides, texts, width, percent, "near-links")
    of = components(links, "near-components")

    # what the pivots left open
    labelled = cells.select("bucket", "rep", "h", "bytes").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = staging.staged(labelled.select("bucket", "rep", "h", "bytes", F.coalesce("component", "rep").alias("c")), "near-labelled")
    parts = labelled.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.sum("bytes").alias("volume"), F.bit_xor("h").alias("s1"), F.bit_xor(F.xxhash64("h")).alias("s2"))
    parts = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("c", "m").alias("main"), F.sum("m").alias("m"), F.sum("volume").alias("volume"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"))
    still = parts.where("parts > 1").groupBy("s1", "s2", "m").agg(F.min("bucket").alias("bucket"), F.min_by("main", "bucket").alias("main"), F.max("volume").alias("volume"))
    still = staging.staged(still.select("bucket", "main", chunks("m", "volume").alias("chunks")), "near-open")
    rows = labelled.join(still, "bucket").withColumns({"out": F.col("c") != F.col("main"), "own": own})
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    member = rows.select("bucket", "rep", "c", F.lit(False).alias("out"), "bytes", "own", every)
    query = rows.where("out").select("bucket", "rep", "c", "out", "bytes", "own", every)
    asked = F.when(F.col("out"), F.xxhash64("bucket", "own", "other")).otherwise(F.xxhash64("bucket", "other", "own"))
    sides = staging.staged(member.unionByName(query).select(asked.alias("g"), F.col("rep").alias("doc_id"), "c", "out", "bytes"), "near-sides")
    more = _found(sides, texts, width, percent, "near-more")
    of = components(links.unionByName(more), "near-groups")

    ends = classes.select(*same, "rep").join(of.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *same).join(ends, same, "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
