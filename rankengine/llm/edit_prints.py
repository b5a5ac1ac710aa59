"""Fingerprints for edit distance: a shared random walk embeds a text so that edits become Hamming distance.

The walk writes the character it stands on again and again; at each place of its output a random function of place and
character, the same for all texts, says whether it steps to the next character. Two texts that differ by a few edits fall
into step again soon behind each of them, so most places of their outputs hold the same characters.

Of the output only a sample of places is kept, a bit of each: stratum s has the places from 2^s up to 2^(s+1) - 1, and
SAMPLES bits of them. So a fingerprint grows with the logarithm of the length, and texts of any two lengths can be compared:
the bits agree everywhere, or in half of the places, where characters differ. Behind its end a text counts as one more
character. The likeness of two fingerprints is the share of places, up to the longer one's end, that hold the same.

Near texts are all pairs of different fingerprints that are alike enough. Behind its end a text holds one and the same
character, so a fingerprint alone says how short a near one can be at least: lengths fall into cells, and each fingerprint
is compared with all those of its own cell and of the cells down to that. Cells of many are cut into tiles of pairs, so a
task holds a bounded number, and copies count once. Nothing is left out; the comparisons grow with the square of the
different texts of like length, and most of them look at one stratum only. Links are joined by union-find.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import staging
from .near_dup import components
from .words import mix, pieces, plain

#: Bits of a stratum, strata at most (texts of up to 2^46 places), places after which the steps come again, classes of
#: characters that step alike.
SAMPLES, STRATA, CYCLE, CLASSES = 64, 46, 251, 32
#: Ratio of the lengths of a cell; fingerprints of a chunk of a cell at least and at most, chunks of a cell between these.
CELL, CHUNK_LEAST, CHUNK_MOST, CHUNKS = 1.5, 1 << 16, 1 << 18, 12
#: Texts that walk together at least.
SIDE_BY_SIDE = 40
#: Text that a range of documents holds about.
RANGE_BYTES = 32 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)


def _random(*keys) -> np.ndarray:
    """A 64-bit value for each combination of keys."""
    out = np.array([_SEED])
    for k in keys:
        out = mix(np.asarray(out ^ np.asarray(k, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


@functools.cache
def _samples() -> tuple[np.ndarray, np.ndarray]:
    """A row for each stratum: its sampled places, ascending, and a random value for each of them. Of a stratum with fewer
    places than samples every place is taken several times, each time for another bit."""
    s, nth = np.arange(STRATA, dtype=np.uint64)[:, None], np.arange(SAMPLES, dtype=np.uint64)[None, :]
    size = np.uint64(1) << s
    width = np.maximum(size // np.uint64(SAMPLES), np.uint64(1))
    places = size + nth * size // np.uint64(SAMPLES) + _random(s, nth) % width
    return places.astype(np.int64), _random(places, nth)


@functools.cache
def _steps() -> list[list]:
    """A state for each place of a cycle: the state behind it for each class of characters, and the place at the end."""
    moves = (_random(1 << 20, np.arange(CLASSES)[:, None], np.arange(CYCLE)[None, :]) >> np.uint64(63)).astype(bool)
    moves[:, 0] |= ~moves.any(axis=1)
    states: list[list] = [[] for _ in range(CYCLE)]
    for c in range(CLASSES):
        stops = np.flatnonzero(moves[c])
        after = (stops[np.searchsorted(stops, np.arange(CYCLE)) % len(stops)] + 1) % CYCLE
        for state, to in zip(states, after.tolist(), strict=True):
            state.append(states[to])
    for place, state in enumerate(states):
        state.append(place)
    return states


_place = itemgetter(CLASSES)


@functools.cache
def _next_places() -> np.ndarray:
    """The same as a table: the place behind a class of characters met at a place."""
    return np.array([[state[c][CLASSES] for state in _steps()] for c in range(CLASSES)], np.int32).ravel()


def _walks(texts: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text (code points), the first place behind each character, when the first one comes to place `start`.

    All texts take a step together, while there are SIDE_BY_SIDE of them; what longer ones have left they walk alone."""
    sizes = np.array([len(x) for x in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    classes = (mix(np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.uint64) + _SEED) >> np.uint64(59)).astype(np.int32)
    rows, table = classes * CYCLE, _next_places()
    order = np.argsort(-sizes, kind="stable")
    going = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))))  # texts longer than so many characters
    together = int(np.searchsorted(-going, -SIDE_BY_SIDE, side="right"))
    at, place = bounds[:-1][order], np.array(starts, np.int32)[order] % CYCLE
    places = np.empty(len(rows), np.int32)
    for n in going[:together].tolist():
        here = at[:n]
        places[here] = place[:n] = table[rows[here] + place[:n]]
        at[:n] += 1
    for k in range(int(going[together]) if together < len(going) else 0):
        rest = slice(int(at[k]), int(bounds[order[k] + 1]))
        states = accumulate(classes[rest].astype(np.uint8).tobytes(), getitem, initial=_steps()[int(place[k])])
        places[rest] = np.fromiter(map(_place, states), np.int32, rest.stop - rest.start + 1)[1:]
    moved = (np.diff(places, prepend=0) - 1) % CYCLE + 1
    firsts = bounds[:-1][sizes > 0]
    moved[firsts] = (places[firsts] - np.array(starts, np.int32)[sizes > 0] - 1) % CYCLE + 1
    ends = np.cumsum(moved.astype(np.int64))
    return [ends[a:b] - (ends[a - 1] if a else 0) + start for a, b, start in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts, strict=True)]


def _packed(seeds: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A bit of each sampled place and what it holds, a row of them as a 64-bit value."""
    bits = mix((seeds ^ held.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(63)
    return np.bitwise_or.reduce(bits << np.arange(SAMPLES, dtype=np.uint64), axis=1)


def _bits(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sampled bits of each stratum up to the end."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    places, seeds = (x[: int(ends[-1] - 1).bit_length()] for x in _samples())  # places from 1 to ends[-1] - 1
    at = np.searchsorted(ends, places, side="right")
    return _packed(seeds, np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)] + 1, 0))  # 0: behind the end


@functools.cache
def _behind() -> np.ndarray:
    """The bits of strata that a text doesn't reach."""
    return _packed(_samples()[1], np.zeros((STRATA, SAMPLES), np.int64))


def likeness(ends: tuple[np.ndarray, np.ndarray], prints: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """The share of places that hold the same, for pairs of fingerprints given by their last places and strata: 0 to 1."""
    n, far = len(ends[0]), np.maximum(*ends)
    deepest = max([1, *(len(x) for side in prints for x in side)])
    sides = []
    for side in prints:
        whole = np.tile(_behind()[:deepest], (n, 1))
        sizes = np.array([len(x) for x in side], np.int64)
        whole[np.arange(deepest) < sizes[:, None]] = np.concatenate([*side, np.zeros(0, np.uint64)])
        sides.append(whole)
    low = np.int64(1) << np.arange(deepest)
    covered = np.clip(far[:, None] + 1 - low, 0, low)
    seen = np.stack([np.searchsorted(x, far, side="right") for x in _samples()[0][:deepest]], axis=1)
    mask = np.where(seen >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(seen, 63).astype(np.uint64)) - np.uint64(1))
    apart = np.bitwise_count((sides[0] ^ sides[1]) & mask)
    same = np.where(seen > 0, 1 - 2 * apart / np.maximum(seen, 1), 0)
    weight = np.where(seen > 0, covered, 0)
    total = weight.sum(axis=1)
    return np.where(total > 0, np.clip((same * weight).sum(axis=1) / np.maximum(total, 1), 0, 1), 1.0)


@dataclass
class _Print:
    """A text's characters, the places behind each, the last place and the bits."""

    text: str
    codes: np.ndarray
    ends: np.ndarray
    last: int
    strata: np.ndarray


def _print(text: str, codes: np.ndarray, ends: np.ndarray) -> _Print:
    return _Print(text, codes, ends, int(ends[-1]) - 1 if len(ends) else 0, _bits(codes, ends))


def _prints(texts: list[str]) -> list[_Print]:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    return [_print(*x) for x in zip(texts, codes, _walks(codes, [1] * len(codes)), strict=True)]


def _edits(prints: list[_Print], after: list[_Print]) -> list[_Print]:
    """Each text with its second half replaced by as much of the next one's beginning. The walk over the first half is the
    text's own."""
    halves = [len(p.codes) // 2 for p in prints]
    news = [b.codes[:h] for b, h in zip(after, halves, strict=True)]
    starts = [int(p.ends[len(p.codes) - h - 1]) if h else 1 for p, h in zip(prints, halves, strict=True)]
    out = []
    for p, b, h, new, walked in zip(prints, after, halves, news, _walks(news, starts), strict=True):
        kept = len(p.codes) - h
        out.append(_print(p.text[:kept] + b.text[:h], np.concatenate([p.codes[:kept], new]), np.concatenate([p.ends[:kept], walked])) if h else p)
    return out


def _text(p: _Print) -> str:
    return f"{p.last:x}." + "".join(f"{x:016x}" for x in p.strata.tolist())


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "last_place", "strata", "part", "role", "text"]


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, last_place bigint, strata array<bigint>, part int, role int, text string"


def _rows(ids: pa.Array, prints: list[_Print], after: list[_Print]) -> list[pa.Array]:
    """The columns of documents whose next documents are known, but for part, role and text."""
    edits = _edits(prints, after)
    ends, strata = np.array([p.last for p in prints], np.int64), [p.strata for p in prints]
    one, two = (likeness((ends, np.array([p.last for p in other], np.int64)), (strata, [p.strata for p in other])) for other in (edits, after))
    sha = [hashlib.sha256(e.text.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    return [
        ids, pa.array([len(p.codes) for p in prints], pa.int64()), pa.array(sha, pa.string()), pa.array([_text(p) for p in prints], pa.string()), pa.array([_text(e) for e in edits], pa.string()),
        pa.array(one), pa.array(two), pa.array(ends), pa.array([x.view(np.int64) for x in strata], pa.list_(pa.int64())),
    ]


def _in_order(kind: pa.DataType) -> Callable:
    """Over a sorted range: rows with their next row as role 0; the first row's text as role 1, the last row's as role 2."""
    def loose(ids: pa.Array, text: str, part: int, role: int) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, *none, pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([text])], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, part = pa.array([], kind), [], 0
        for batch in batches:
            for piece in pieces(batch):
                texts = plain(piece.column("text")).to_pylist()
                if texts and not prints:
                    part = piece.column("part")[0].as_py()
                    yield loose(piece.column("doc_id").slice(0, 1), texts[0], part, 1)
                ids = pa.concat_arrays([ids, piece.column("doc_id")])
                prints += _prints(texts)
                if (n := len(prints) - 1) > 0:
                    yield pa.RecordBatch.from_arrays([*_rows(ids.slice(0, n), prints[:n], prints[1:]), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string())], _COLUMNS)
                    ids, prints = ids.slice(n), prints[n:]
        if prints:
            yield loose(ids, prints[0].text, part, 2)

    return run


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges with the first text of the next one, `next`."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            mine, other = _prints([row.column(c)[0].as_py() for c in ("text", "next")])
            yield pa.RecordBatch.from_arrays([*_rows(row.column("doc_id"), [mine], [other]), row.column("part"), pa.array([0], pa.int32()), pa.nulls(1, pa.string())], _COLUMNS)


def _key_type(docs: DataFrame) -> tuple[str, pa.DataType]:
    kind = docs.schema["doc_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, last_place and strata (its parts) of each text, and the same for the text with its
    second half replaced by as much of the next document's beginning: edited_sha256, edited_fingerprint, near_edited; and
    near_next, the likeness to the next document. One row for each row of `docs`.

    Documents come in the order of doc_id, null first, those of one doc_id in the order of the texts' hashes; behind the
    last comes the first. Null and empty texts have the fingerprint of no places; two of them have likeness 1, one and a
    longer text about 0. A text of one character is its own edited text. Texts of any length are read whole; an empty
    table gives an empty one; other columns aren't looked at.
    """
    name, kind = _key_type(docs)
    order = ["doc_id", "hash", "nth"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    ranges = staging.text_bytes(docs) // RANGE_BYTES + docs.sparkSession.sparkContext.defaultParallelism
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = staging.staged(ranged.mapInArrow(_in_order(kind), _schema(name)), "fingerprints")
    heads = made.where("role = 1").select(F.col("part").alias("head"), F.col("text").alias("next"))
    # a row for each range: which one comes next
    parts = heads.select("head").withColumn("part", F.coalesce(F.lag("head").over(Window.orderBy("head")), F.max("head").over(Window.partitionBy())))
    tails = made.where("role = 2").select("doc_id", "text", "part").join(parts, "part").join(heads, "head").select("doc_id", "text", "part", "next")
    return made.where("role = 0").unionByName(tails.mapInArrow(_at_ends, _schema(name))).drop("part", "role", "text")


def _shares(ends: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs whose longer text ends at `ends`: what a differing bit of each stratum counts for, and which bits count."""
    low = np.int64(1) << np.arange(deepest)
    seen = np.stack([np.searchsorted(x, ends, side="right") for x in _samples()[0][:deepest]], axis=1)
    weight = np.where(seen > 0, np.clip(ends[:, None] + 1 - low, 0, low), 0)
    mask = np.where(seen >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(seen, 63).astype(np.uint64)) - np.uint64(1))
    return weight / np.maximum(weight.sum(axis=1), 1)[:, None] / np.maximum(seen, 1), mask


def _matrix(strata: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each stratum, with what is behind the end where a text doesn't reach."""
    column = strata.combine_chunks() if isinstance(strata, pa.ChunkedArray) else strata
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.repeat(_behind()[: max([1, *sizes.tolist()]), None], len(sizes), axis=1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = column.flatten().to_numpy().view(np.uint64)
    return out


def _cell(places: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(places, 1)) / np.log(CELL)).astype(np.int32)


def shortest(ends: np.ndarray, strata: pa.Array, threshold: float) -> np.ndarray:
    """The last place that a text at least as near as `threshold` and no longer has at least: from there on the fingerprint
    differs too often from what is behind an end."""
    whole = _matrix(strata)
    deepest = len(whole)
    share, mask = _shares(ends, deepest)
    apart = ((whole.T ^ _behind()[:deepest]) & mask)[:, :, None] >> np.arange(SAMPLES, dtype=np.uint64) & np.uint64(1)
    from_here = np.cumsum((apart * share[:, :, None]).reshape(len(ends), -1)[:, ::-1], axis=1)[:, ::-1]
    n = (from_here > (1 - threshold) / 2 + 1e-9).sum(axis=1)
    return np.where(n > 0, _samples()[0][:deepest].ravel()[np.maximum(n, 1) - 1], 0)


def _celled(threshold: float) -> Callable:
    """Adds `shortest` and the cells in which a fingerprint is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                ends = batch.column("last_place").to_numpy()
                least = shortest(ends, batch.column("strata"), threshold)
                cells = [np.arange(x, y + 1) for x, y in zip(_cell(least).tolist(), _cell(ends).tolist(), strict=True)]
                yield batch.append_column("shortest", pa.array(least)).append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return run


def _linked(threshold: float, kind: pa.DataType) -> Callable:
    """Of a tile: links that join all fingerprints which are near each other. Tiles of two chunks compare across only."""
    most = (1 - threshold) / 2 + 1e-12

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("last_place")
        ends, least, side = (tile[c].to_numpy() for c in ("last_place", "shortest", "side"))
        bits = _matrix(tile["strata"])
        share, mask = _shares(ends, len(bits))
        order = np.argsort(-share * np.bitwise_count(mask), axis=1, kind="stable")  # the heaviest stratum first
        component, alone = np.arange(len(ends)), np.ones(len(ends), bool)
        links: list[tuple[int, int]] = []

        def near(i: int, others: np.ndarray) -> np.ndarray:
            """Those of `others`, no longer texts, that are alike enough."""
            apart = np.zeros(len(others))
            for s in order[i].tolist():
                if not share[i, s]:
                    break
                apart += share[i, s] * np.bitwise_count((bits[s, others] ^ bits[s, i]) & mask[i, s])
                on = apart <= most
                others, apart = others[on], apart[on]
            return others

        def compare(rows: np.ndarray, pool: np.ndarray) -> None:
            held, lengths = np.ascontiguousarray(bits[:, pool]), ends[pool]
            first, last = np.searchsorted(lengths, least[rows], "left"), np.searchsorted(pool, rows, "left")
            for i, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
                if a >= b:
                    continue
                s = order[i, 0]
                differ = np.bitwise_count((held[s, a:b] ^ bits[s, i]) & mask[i, s])
                others = pool[a + np.flatnonzero(differ <= int(most / share[i, s] + 1e-9))]
                step = 64
                while len(others):
                    found, others = near(i, others[:step]), others[step:]
                    for c, j in zip(*np.unique(component[found], return_index=True), strict=True):
                        if component[i] != c:
                            links.append((i, int(found[j])))
                            if alone[i]:
                                component[i] = c
                            else:
                                component[component == component[i]] = c
                            alone[[i, found[j]]] = False
                    others = others[component[others] != component[i]]
                    step *= 8

        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(two):
            compare(one, two)
            compare(two, one)
        else:
            compare(one, one)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        ids = tile["a"].combine_chunks()
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b))], pa.schema([("a", kind), ("b", kind)]))

    return run


def near_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all rows of `classes` (a, last_place, strata) which are near each other, in bounded tiles."""
    kind, arrow = classes.schema["a"].dataType.simpleString(), to_arrow_type(classes.schema["a"].dataType)
    rows = classes.select("a", "last_place", "strata")
    rows = rows.mapInArrow(_celled(threshold), f"a {kind}, last_place bigint, strata array<bigint>, shortest bigint, cells array<int>")
    rows = staging.staged(rows, "print-cells").withColumn("cell", F.explode("cells")).drop("cells")
    # a few dozen cells: their numbers go by the logarithm of the length
    sizes = [(r["cell"], -(-r["n"] // min(CHUNK_MOST, max(CHUNK_LEAST, -(-r["n"] // CHUNKS))))) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    chunks = F.broadcast(rows.sparkSession.createDataFrame(sizes, "cell int, chunks bigint"))
    rows = rows.join(chunks, "cell").withColumn("mine", F.pmod(F.xxhash64("a"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    tiles = rows.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "a", "last_place", "strata", "shortest")
    return tiles.groupBy("cell", "i", "j").applyInArrow(_linked(threshold, arrow), f"a {kind}, b {kind}")


def near_groups(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """fingerprint and group_id, the smallest doc_id of the texts that links of at least `threshold` join, for each distinct
    fingerprint of `prints`, as `fingerprints` makes them. Texts without places, and rows without a doc_id, are in no group
    (null)."""
    known = prints.where("doc_id is not null and last_place > 0")
    classes = staging.staged(known.groupBy("fingerprint").agg(F.min("doc_id").alias("a"), F.first("last_place").alias("last_place"), F.first("strata").alias("strata")), "print-classes")
    groups = components(near_links(classes, threshold), "print-links")
    return classes.select("fingerprint", F.col("a").alias("node")).join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("group_id"))
