"""Periodic runs of words, found online by catchers over completed blocks of 2^k words.

A run with smallest period q is a stretch of words, q apart identical, that no neighbouring word extends. Words are
appended in stretches of any length; level k looks after the periods from B = 2^k up to 2 B - 1:

1. When a block of B words, at a multiple of B, is complete and 3 B words more have come, its catcher looks for the block
   again B to 2 B - 1 words later. A hit at distance q is a square in the making; it is kept if the B words before or
   behind the block agree at that distance, too. In a run of at least 4 q words one of both holds for any of its blocks.
2. Hits inside a run of a period below B, which are multiples of that period, are left out: each level ends before the
   next one begins, so such runs are known. What is left are a few hits a block, so that all levels together take
   O(n log n) whatever the words.
3. Hits of neighbouring blocks at one distance merge; their ends are moved by comparing words until they differ or the
   text ends. Those at the end stay open, and the words appended next move them on.

Blocks are compared by 64-bit hashes, which are named by their halves; what is reported has been compared word by word.
A level keeps the hashes of its last 8 B places only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLANK, encode_words, mix, pieces, split_words

#: Words appended at a time.
STRETCH = 1 << 20
#: Runs hold their period this often at least. The catchers rely on 4.
LEAST_EXPONENT = 4


class _Level:
    """Hashes of the places from `base` on, and the number of blocks whose catchers are through."""

    def __init__(self) -> None:
        self.base, self.hashes, self.judged = 0, np.zeros(0, np.uint64), 0

    def upto(self) -> int:
        return self.base + len(self.hashes)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Hashes of places; of those outside what is known, values that nothing else has."""
        i = places - self.base
        inside = (i >= 0) & (i < len(self.hashes))
        out = places.astype(np.uint64) * np.uint64(2) + np.uint64(1)
        out[inside] = self.hashes[i[inside]]
        return out


class Catchers:
    """Runs of an online word sequence. `longest`: no run is longer (documents parted by words of their own, say)."""

    def __init__(self, longest: int | None = None, seed: int = 1):
        self.words, self.longest, self.seed = np.zeros(0, np.int64), longest, np.uint64(seed)
        self.levels: list[_Level] = []
        #: (period, begin, end) of stretches where words `period` apart agree: those that ended, by level, and open ones.
        self.closed: list[np.ndarray] = []
        self.open: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray, last: bool = False) -> None:
        self.words = np.concatenate([self.words, words])
        going, self.open = self.open, []
        self._keep(*(np.array(x, np.int64) for x in zip(*going, strict=True))) if going else None
        k = 0
        while LEAST_EXPONENT << k <= (n := min(len(self.words), self.longest or len(self.words))) and n:
            if k == len(self.levels):
                self.levels.append(_Level())
                self.closed.append(np.zeros((0, 3), np.int64))
            self._advance(k)
            self._judge(k, last)
            k += 1
        for k, level in enumerate(self.levels):
            keep = max(0, len(level.hashes) - (8 << k))
            level.base, level.hashes = level.base + keep, level.hashes[keep:]

    def runs(self) -> np.ndarray:
        """start, length and period of all runs of at least 4 periods so far, by start, then period."""
        found = np.concatenate([*self.closed, np.array(self.open, np.int64).reshape(-1, 3)]) if self.levels else np.zeros((0, 3), np.int64)
        period, begin, end = found.T
        whole = end - begin >= (LEAST_EXPONENT - 1) * period
        out = np.unique(np.stack([begin, period, end - begin + period], axis=1)[whole], axis=0)
        return out[:, [0, 2, 1]]

    def sound(self) -> bool:
        """Whether words agree in all runs, as hashes said."""
        start, length, period = self.runs().T
        at = _ragged(start, length - period)
        return bool((self.words[at] == self.words[at + np.repeat(period, length - period)]).all())

    def _advance(self, k: int) -> None:
        """Hashes of the places whose words have come: a word's own, else named by both halves."""
        level, upto = self.levels[k], len(self.words) - (1 << k) + 1
        if upto <= level.upto():
            return
        if k == 0:
            new = mix(self.words[level.upto() :].astype(np.uint64) + self.seed)
        else:
            below, at = self.levels[k - 1], np.arange(level.upto(), upto)
            first = below.hashes[at - below.base]
            new = mix(first * np.uint64(0x9E3779B97F4A7C15) + below.hashes[at + (1 << k - 1) - below.base] + self.seed)
        level.hashes = np.concatenate([level.hashes, new])

    def _judge(self, k: int, last: bool) -> None:
        """Lets the catchers of level k that have seen enough words report."""
        level, size = self.levels[k], 1 << k
        n = len(self.words)
        blocks = max(level.judged, (n - 2 * size) // size + 1 if last else (n - 4 * size) // size + 1)
        if blocks == level.judged:
            return
        starts = np.arange(level.judged, blocks) * size
        level.judged = blocks
        own = level.at(starts)
        i, j = np.nonzero(level.at(np.arange(starts[0] + size, starts[-1] + 2 * size)).reshape(-1, size) == own[:, None])
        s, q = starts[i], size + j
        s, q = self._uncovered(k, s, q)
        behind, before = level.at(s + size) == level.at(s + size + q), (s >= size) & (level.at(s - size) == level.at(s - size + q))
        s, q = s[behind | before], q[behind | before]
        if not len(s):
            return
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        joins = (q[1:] == q[:-1]) & (s[1:] == s[:-1] + size)
        begin, end = s[np.concatenate([[True], ~joins])], s[np.concatenate([~joins, [True]])] + size
        q = q[np.concatenate([[True], ~joins])]
        new = self._unknown(k, q, begin)
        q, begin, end = q[new], begin[new], end[new]
        self._keep(q, begin - self._agree(begin - 1, q, -1), end)

    def _known(self, k: int) -> np.ndarray:
        """Stretches of level k so far."""
        size = 1 << k
        return np.concatenate([self.closed[k], np.array([x for x in self.open if size <= x[0] < 2 * size], np.int64).reshape(-1, 3)])

    def _uncovered(self, k: int, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits whose block and repetition don't lie in one stretch of a lower level."""
        if not k or not len(s):
            return s, q
        period, begin, end = np.concatenate([self._known(i) for i in range(k)]).T
        if not len(begin):
            return s, q
        order = np.argsort(begin, kind="stable")
        begin, reach = begin[order], np.maximum.accumulate((end + period)[order])
        at = np.searchsorted(begin, s, side="right") - 1
        free = (at < 0) | (reach[np.maximum(at, 0)] < s + q + (1 << k))
        return s[free], q[free]

    def _unknown(self, k: int, q: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which hits aren't in a stretch that is known from earlier words."""
        known = self._known(k)
        if not len(known):
            return np.ones(len(q), bool)
        known = known[np.lexsort((known[:, 1], known[:, 0]))]
        width = len(self.words) + 1
        at = np.searchsorted(known[:, 0] * width + known[:, 1], q * width + begin, side="right") - 1
        near = known[np.maximum(at, 0)]
        return (at < 0) | (near[:, 0] != q) | (near[:, 2] <= begin)

    def _keep(self, q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Moves the ends on, keeps stretches that are long enough or still open."""
        end = end + self._agree(end, q, 1)
        found = np.unique(np.stack([q, begin, end], axis=1), axis=0)
        at_end = found[:, 2] + found[:, 0] == len(self.words)
        self.open += [tuple(map(int, x)) for x in found[at_end]]
        done = found[~at_end & (found[:, 2] - found[:, 1] >= (LEAST_EXPONENT - 1) * found[:, 0])]
        for k in np.unique(level := np.frexp(done[:, 0].astype(np.float64))[1] - 1):
            self.closed[k] = np.concatenate([self.closed[k], done[level == k]])

    def _agree(self, at: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """How many words from each place on, in direction `step`, agree with those `q` later."""
        count, live, chunk = np.zeros(len(at), np.int64), np.arange(len(at)), 8
        while len(live):
            i = (at[live] + step * count[live])[:, None] + step * np.arange(chunk)
            inside = (i >= 0) & (i + q[live, None] < len(self.words))
            i = np.where(inside, i, 0)
            same = inside & (self.words[i] == self.words[np.where(inside, i + q[live, None], 0)])
            whole = same.all(axis=1)
            count[live] += np.where(whole, chunk, same.argmin(axis=1))
            live, chunk = live[whole], min(2 * chunk, max(8, (1 << 22) // max(1, int(whole.sum()))))
        return count


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def find_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """start, length, period of all runs of at least 4 periods, by start, then period."""
    seed = 1
    while True:
        catchers = Catchers(longest, seed)
        for at in range(0, max(len(words), 1), STRETCH):
            catchers.append(words[at : at + STRETCH], last=at + STRETCH >= len(words))
        if catchers.sound():
            return catchers.runs()
        seed += 1  # two blocks with one hash: never seen


def _rewritten(keys: list[int | None], bounds: np.ndarray) -> np.ndarray | None:
    """The place that each word's new word comes from, if any of the documents is rewritten."""
    at = None
    for d, key in enumerate(keys):
        lo, n = int(bounds[d]), int(bounds[d + 1] - bounds[d])
        if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.arange(bounds[-1]) if at is None else at
        at[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return at


_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _digests(plant: bool, least: int, whole: bool) -> Callable:
    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        flat, bounds = split_words(piece.column("text"), BLANK)
        at = _rewritten(piece.column("doc_id").to_pylist(), bounds) if plant else None
        if at is not None:
            flat = flat.take(pa.array(at))
        codes, _ = encode_words(flat)
        n_docs, sizes = piece.num_rows, np.diff(bounds)
        # documents one behind the other, a word of its own behind each
        shift = np.repeat(np.arange(n_docs), sizes)
        words = np.empty(len(codes) + n_docs, np.int64)
        words[np.arange(len(codes)) + shift] = codes
        words[bounds[1:] + np.arange(n_docs)] = -1 - np.arange(n_docs)
        start, length, period = find_runs(words, int(sizes.max(initial=0))).T
        fits = length >= least
        start, length, period = start[fits], length[fits], period[fits]
        starts = bounds[:-1] + np.arange(n_docs)
        doc = np.searchsorted(starts, start, side="right") - 1
        start = start - starts[doc]
        gone = np.zeros(len(codes) + 1, np.int64)
        np.add.at(gone, bounds[doc] + start + period, 1)
        np.add.at(gone, bounds[doc] + start + length, -1)
        kept = np.cumsum(gone)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(kept)])[bounds]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(kept))), " ")
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        best = np.full(n_docs, -1, np.int64)
        order = np.lexsort((period, start, -length, doc))
        best[doc[order][::-1]] = order[::-1]
        lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        none = best < 0
        pick = lambda x: pa.array(np.append(x, 0)[best].astype(np.int64), mask=none)
        columns = [piece.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pick(start), pick(length), pick(period), pick(1000 * length // np.maximum(period, 1))]
        columns.append(pa.array([sha("".join(lines[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string()))
        columns.append(pa.array([sha(t) for t in texts.to_pylist()], pa.string()))
        return pa.RecordBatch.from_arrays([*columns, texts], [*_COLUMNS, "collapsed"]) if whole else pa.RecordBatch.from_arrays(columns, _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield one(piece)

    return run


def collapse_runs(docs: DataFrame, least: int = 6, plant: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period),
    runs_sha256, collapsed_sha256 and, with `texts`, collapsed: the words that no run repeats, parted by one space. One row
    for each row of `docs`.

    A run has at least `least` words and four periods. With `plant`, a tenth of the documents, drawn by doc_id, first get
    a periodic ending, for tests of the finder; rows with a null doc_id get none. Null and empty texts, and texts without
    words, have no runs and collapse to an empty text. Rows count each by itself, repeated ones and those of one doc_id,
    too. Texts of any length are read whole; an empty table gives an empty one; other columns aren't looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * texts
    return docs.select("doc_id", F.col("text")).mapInArrow(_digests(plant, least, texts), schema)
