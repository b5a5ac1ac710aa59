"""LM scoring with a probabilistic suffix tree of variable-length contexts.

Texts are words (A-Z lower-cased) and one end token. Counts cover every training text. The tree has two parts.

* Frequent symbols: words with a share of at least SYMBOL_SHARE stand for themselves; other words fall into classes by
  their last two letters, or into one rest class. A word's probability is that of its symbol times its share (plus 0.5) of
  its class, in which one unknown word is provided for. Contexts are runs of up to `depth` symbols with a share of at
  least CONTEXT_SHARE; next symbols with a share of at least EVENT_SHARE are kept and smoothed with the next shorter
  context: counts plus the probability there, times the context's other events and PRIOR. The shares bound this part,
  which is sent to all tasks.
* Exact contexts: all runs of up to `reach` words, but those that the frequent part holds as they are (their share is at
  least CONTEXT_SHARE and each word stands for itself). Next words seen at least twice are kept and smoothed with the
  next shorter context in the same way, the shortest with the frequent part. Their number grows with the corpus: they are
  a shuffled table and never gathered. A place goes to where the shortest of its exact contexts is, and the longer ones
  with it; such a context has less than CONTEXT_SHARE of all places, so none is hot.
* A context is retained if its distribution diverges from the shorter one's (log-likelihood gain of at least LEAST_GAIN
  and one for each kept event); contexts that a retained one ends with are retained, too.
* Scoring: each token is predicted from the longest retained context that ends before it.

With a number for `rare` there is one exact context a place instead: the words from the nearest one seen 2 to `rare` times
in training on. That is cheaper, and leaves out all contexts that begin with a more frequent word.

Neighbouring documents make blocks of about BLOCK_BYTES, and each block asks for the counts of its own words. There the
frequent part scores each place; a place with an exact context sends that, its next word and probability to where the context's other places
are, and the difference that the context makes comes back by document, in whole units of 1e-9, so reruns agree.

Null and empty texts have the end token alone. Without training texts every token has base probability 1/1 and the score
equals the base. Repeated rows, and rows of one or no doc_id, are scored each by itself; extra columns are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import staging
from .words import BLANK_LOWER, encode_words, hash_words, mix, pieces, split_words

BLOCK_BYTES = 8 << 20
COUNT_BYTES = 8 << 20
SYMBOL_SHARE = 1e-4
CONTEXT_SHARE = 1e-4
EVENT_SHARE = 1e-6
PRIOR = 2.0
LEAST_GAIN = 8.0
PIECE_BYTES = 2 << 20  # of text scored at once
LINK_BYTES = 4 << 20  # of text for each task that weighs exact contexts
_BITS = 15  # of a symbol: SYMBOL_SHARE leaves at most 2 / SYMBOL_SHARE + 2; a context of 3 and its event fit a long
END = 0
REST = 1
_SHORT_UNIT = float(1 << 18)  # a place sends its log10 probability from the shorter context in units of this part
_UNIT = 1e9  # log10 differences are added as whole numbers of this part
_END_HASH = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Tree:
    total: int  # training tokens, ends included
    distinct: int
    ends: int
    words: list[str]  # symbol 2 + i
    word_counts: np.ndarray
    classes: list[str]  # symbol 2 + len(words) + i
    class_counts: np.ndarray
    class_words: np.ndarray
    rest: tuple[int, int]  # count and distinct words of the rest class
    root: np.ndarray = field(default_factory=lambda: np.zeros(0))  # probability of each symbol
    contexts: list[np.ndarray] = field(default_factory=list)  # by length - 1: sorted packed contexts
    mass: list[np.ndarray] = field(default_factory=list)  # their weight of the shorter context's probability
    weight: list[np.ndarray] = field(default_factory=list)  # their counts plus PRIOR
    events: list[np.ndarray] = field(default_factory=list)  # sorted packed (context, next)
    counts: list[np.ndarray] = field(default_factory=list)
    hot: list[np.ndarray] = field(default_factory=list)  # by length - 1: contexts that are frequent, retained or not

    def finish(self) -> None:
        counts = np.concatenate([[self.ends, self.rest[0]], self.word_counts, self.class_counts]).astype(float)
        self.root = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "found"}

    def symbols(self, distinct: pa.StringArray) -> np.ndarray:
        """Symbol of each distinct word."""
        word = pc.index_in(distinct, value_set=pa.array(self.words, pa.string()))
        kind = pc.index_in(endings(distinct), value_set=pa.array(self.classes, pa.string()))
        return pc.coalesce(pc.add(word, 2), pc.add(kind, 2 + len(self.words)), pa.scalar(REST, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64)

    def within(self, symbol: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of a word in its symbol."""
        first = 2 + len(self.words)
        n = np.concatenate([[0, self.rest[0]], np.zeros(len(self.words)), self.class_counts])[symbol]
        v = np.concatenate([[0, self.rest[1]], np.zeros(len(self.words)), self.class_words])[symbol]
        return np.where((symbol >= first) | (symbol == REST), (counts + 0.5) / (n + 0.5 * (v + 1)), 1.0)

    def predict(self, symbol: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Probability of each symbol after its context; before[k]: the symbol k + 1 places earlier (END before a text)."""
        p = self.root[symbol]
        packed = np.zeros(len(symbol), np.int64)
        live = np.ones(len(symbol), bool)
        for k in range(len(self.contexts)):
            packed = packed | (before[k] << (_BITS * k))
            if not len(self.contexts[k]):
                break
            at = np.minimum(np.searchsorted(self.contexts[k], packed), len(self.contexts[k]) - 1)
            live &= self.contexts[k][at] == packed
            if not live.any():
                break
            i = np.flatnonzero(live)
            event = packed[i] << _BITS | symbol[i]
            count = np.zeros(len(i))
            if len(self.events[k]):
                e = np.minimum(np.searchsorted(self.events[k], event), len(self.events[k]) - 1)
                count = np.where(self.events[k][e] == event, self.counts[k][e], 0)
            p[i] = (count + self.mass[k][at[i]] * p[i]) / self.weight[k][at[i]]
        return p


def endings(words: pa.StringArray) -> pa.StringArray:
    return pc.utf8_slice_codeunits(words, -2)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block of each row: neighbours of about BLOCK_BYTES, named by the number of their first row."""
    block, held = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = batch.column("row").to_numpy()
        if held is None:
            block, held = row[0], 0
        before = held + np.cumsum(size) - size
        group = before // BLOCK_BYTES
        first = np.flatnonzero(np.diff(group, prepend=0))
        mine = np.concatenate([[block], row[first]])[np.searchsorted(first, np.arange(len(row)), "right")]
        block, held = mine[-1], before[-1] + size[-1] - group[-1] * BLOCK_BYTES
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine)], [*batch.schema.names, "block"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, training occurrences; 0 for words that held-out texts alone have), about COUNT_BYTES at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}

    def counted(block: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held.pop(block))
        size.pop(block)
        words, first = split_words(rows.column("text"), BLANK_LOWER)
        codes, distinct = encode_words(words)
        if len(codes):
            train = np.repeat(rows.column("train").to_numpy(), np.diff(first))
            n = np.bincount(codes[train], minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), block)), distinct, pa.array(n)], ["block", "word", "n"])

    for batch in batches:
        for piece in pieces(batch, size=2 << 20):
            of = piece.column("block").to_numpy()
            for block in [b for b in held if b not in of]:  # blocks lie one after the other
                yield from counted(block)
            for block in np.unique(of).tolist():
                mine = piece.filter(pa.array(of == block))
                held.setdefault(block, []).append(mine)
                size[block] = size.get(block, 0) + (pc.sum(pc.binary_length(mine.column("text"))).as_py() or 0)
                if size[block] >= COUNT_BYTES:
                    yield from counted(block)
    for block in list(held):
        yield from counted(block)


def _sequences(tree: Tree, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray, np.ndarray]:
    """Symbols with ends, begin of each text in them, word code of each place (-1: end), distinct words, their symbols."""
    words, first = split_words(piece.column("text"), BLANK_LOWER)
    codes, distinct = encode_words(words)
    of = tree.symbols(distinct) if len(codes) else np.zeros(0, np.int64)
    n = np.diff(first)
    begin = first + np.arange(len(first))
    place = np.full(begin[-1], -1, np.int64)
    place[np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)] = codes
    symbol = np.where(place >= 0, of[place] if len(of) else END, END).astype(np.int64)
    return symbol, begin, place, distinct, of


def _before(symbol: np.ndarray, depth: int) -> list[np.ndarray]:
    """Symbols 1..depth places earlier; before a text's first words there are ends only."""
    out = []
    inside = np.ones(len(symbol), bool)
    for k in range(1, depth + 1):
        shifted = np.full(len(symbol), END, np.int64)
        shifted[k:] = symbol[:-k]
        inside = inside & (out[-1] != END if k > 1 else np.ones(len(symbol), bool))
        out.append(np.where(inside, shifted, END))
    return out


def _event_counts(sent, length: int) -> Callable:
    """(packed context and next, n) for contexts of `length` symbols whose shorter part is in the tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, size=3 << 20):
                symbol = _sequences(tree, piece)[0]
                packed = np.zeros(len(symbol), np.int64)
                for k, x in enumerate(_before(symbol, length)):
                    packed |= x << (_BITS * k)
                if length > 1:
                    # the context of one symbol less must have been frequent, else this one isn't
                    shorter = packed & ((1 << _BITS * (length - 1)) - 1)
                    known = tree.frequent
                    at = np.minimum(np.searchsorted(known, shorter), len(known) - 1) if len(known) else np.zeros(len(shorter), int)
                    on = known[at] == shorter if len(known) else np.zeros(len(shorter), bool)
                    packed, symbol = packed[on], symbol[on]
                new, n = np.unique(packed << _BITS | symbol, return_counts=True)
                keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([sums, n]), len(keys)).astype(np.int64)
                if len(keys) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["event", "n"])
                    keys, sums = keys[:0], sums[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["event", "n"])

    return count


def _grow(tree: Tree, blocked: DataFrame, depth: int) -> None:
    """Adds contexts of 1 to `depth` symbols, a pass over the training texts for each length, then prunes."""
    spark = blocked.sparkSession
    train = blocked.where("train").select("text")
    tree.frequent = np.zeros(0, np.int64)
    for length in range(1, depth + 1):
        sent = spark.sparkContext.broadcast(tree)
        counts = train.mapInArrow(_event_counts(sent, length), "event bigint, n bigint").groupBy("event").agg(F.sum("n").alias("n"))
        counts = staging.staged(counts, "tree-events")
        context = counts.groupBy(F.shiftright("event", _BITS).alias("context")).agg(F.sum("n").alias("total")).where(F.col("total") >= CONTEXT_SHARE * tree.total)
        known = sorted((r["context"], r["total"]) for r in context.collect())
        contexts, totals = (np.array([x[i] for x in known], np.int64) for i in (0, 1))
        rows = counts.where(F.col("n") >= max(2.0, EVENT_SHARE * tree.total)).toArrow()
        event, n = rows.column("event").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
        order = np.argsort(event)
        event, n = event[order], n[order]
        at = np.minimum(np.searchsorted(contexts, event >> _BITS), max(len(contexts) - 1, 0))
        on = contexts[at] == event >> _BITS if len(contexts) else np.zeros(len(event), bool)
        event, n, at = event[on], n[on], at[on]
        held = np.bincount(at, n, len(contexts))
        tree.frequent = contexts
        tree.hot.append(contexts)
        tree.contexts.append(contexts)
        tree.weight.append(totals + PRIOR)
        tree.mass.append(totals - held + PRIOR)
        tree.events.append(event)
        tree.counts.append(n)
    del tree.frequent
    keep: list[np.ndarray] = []
    for k in range(depth):
        event, at = tree.events[k], np.searchsorted(tree.contexts[k], tree.events[k] >> _BITS)
        symbol = event & ((1 << _BITS) - 1)
        context = event >> _BITS
        longer, shorter = Tree.__new__(Tree), Tree.__new__(Tree)
        for part, upto in ((longer, k + 1), (shorter, k)):
            part.__dict__.update(tree.__dict__, contexts=tree.contexts[:upto])
        before = [context >> (_BITS * i) & ((1 << _BITS) - 1) for i in range(k + 1)]
        gain = tree.counts[k] * np.log(longer.predict(symbol, before) / shorter.predict(symbol, before))
        total = np.bincount(at, gain, len(tree.contexts[k]))
        keep.append(total >= LEAST_GAIN + np.bincount(at, minlength=len(total)))
    for k in range(depth - 1, 0, -1):  # a retained context keeps those that it ends with
        shorter = tree.contexts[k][keep[k]] & ((1 << _BITS * k) - 1)
        keep[k - 1] |= np.isin(tree.contexts[k - 1], shorter)
    for k in range(depth):
        kept = tree.contexts[k][keep[k]]
        on = np.isin(tree.events[k] >> _BITS, kept)
        tree.contexts[k], tree.weight[k], tree.mass[k] = kept, tree.weight[k][keep[k]], tree.mass[k][keep[k]]
        tree.events[k], tree.counts[k] = tree.events[k][on], tree.counts[k][on]


def _exact_contexts(hashes: np.ndarray, rare: np.ndarray, begin: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with a rare word among the last `reach` words of their text, and the hash of the words from it on."""
    start = np.repeat(begin[:-1], np.diff(begin))
    at = np.arange(len(hashes))
    context, rolled = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    found = np.zeros(len(hashes), bool)
    for k in range(1, reach + 1):
        inside = at - k >= start
        j = np.where(inside, at - k, 0)
        rolled = mix(rolled ^ hashes[j])
        new = inside & rare[j] & ~found
        context[new] = rolled[new]
        found |= new
    places = np.flatnonzero(found)
    return places, context[places]


def _longer_contexts(tree: Tree, symbol: np.ndarray, hashes: np.ndarray, seen: np.ndarray, begin: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with an exact context, the hash of the shortest one, and the words before it, nearest first (0: none that is
    seen twice or within `reach`)."""
    size = len(hashes)
    start = np.repeat(begin[:-1], np.diff(begin))
    at = np.arange(size)
    own = (symbol >= 2) & (symbol < 2 + len(tree.words))
    short = _short(tree, symbol, hashes)
    group, rolled, packed = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int64)
    farther = np.zeros((max(reach - 1, 1), size), np.uint32)
    width = np.full(size, -1)  # words before the shortest exact context so far; -1: no such context yet
    live, frequent = np.ones(size, bool), np.ones(size, bool)
    for k in range(1, reach + 1 if tree.total else 1):
        j = np.where(at - k >= start, at - k, 0)
        live = live & (at - k >= start) & seen[j]
        rolled = mix(rolled ^ hashes[j])
        packed |= symbol[j] << (_BITS * (k - 1))
        further = live & (width >= 0)
        farther[width[further], np.flatnonzero(further)] = short[j[further]]
        width[further] += 1
        known = tree.hot[k - 1]
        frequent = frequent & own[j] & (known[np.minimum(np.searchsorted(known, packed), len(known) - 1)] == packed if len(known) else False)
        new = live & (width < 0) & ~frequent
        group[new], width[new] = rolled[new], 0
    places = np.flatnonzero(width >= 0)
    return places, group[places], farther[:, places]


def _short(tree: Tree, symbol: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A word in 32 bits: frequent ones by their symbols, which compress, others by their hashes."""
    own = (symbol >= 2) & (symbol < 2 + len(tree.words))
    return np.where(own, symbol, hashes >> np.uint64(33) | np.uint64(1 << 31)).astype(np.uint32)


def _bundle(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of whole numbers, so many low bytes of each, as a compressed string: byte by byte, so that like bytes meet."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T) for x, n in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unbundle(data: bytes, size: int, widths: list[int]) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, size * sum(widths), codec="zstd", asbytes=True), np.uint8).reshape(sum(widths), size)
    out, first = [], 0
    for n in widths:
        whole = np.zeros((size, 8), np.uint8)
        whole[:, :n] = planes[first : first + n].T
        out.append(whole.view("<u8").ravel() if n > 4 else np.ascontiguousarray(whole[:, :4]).view("<u4").ravel())
        first += n
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, its neighbouring rows as a compressed Arrow stream): texts cross the network in this form."""
    for batch in batches:
        for piece in pieces(batch):
            of = piece.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(piece.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array(of[i : i + 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])


def _scorer(sent, kind: pa.DataType, reach: int, rare: int | None, parts: int) -> Callable:
    """Of a block: a row with `head` for each document, and one for each place with an exact context; for all contexts one
    for the places that go to the same of `parts`."""
    head_type = pa.struct([("doc_id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def bundles(key: np.ndarray, group: np.ndarray, *rest: np.ndarray) -> pa.Table:
        part = (group >> np.uint64(40)) % np.uint64(parts)
        group = group & np.uint64((1 << 40) - 1)
        order = np.argsort(part << np.uint64(40) | group)
        part, columns = part[order].astype(np.int64), [x[order] for x in (key, group, *rest)]
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(order)]
        data = [_bundle([(x[i:j], w) for x, w in zip(columns, _widths(len(rest) - 2), strict=True)]) for i, j in zip(cuts, cuts[1:], strict=False)]
        m = len(data)
        return pa.table([pa.nulls(m, pa.int64()), pa.array(part[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.nulls(m, head_type), pa.array(data, pa.binary())], _SENT)

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        tree = sent.value
        vocabulary, known = counts.column("word").combine_chunks(), counts.column("c").to_numpy()
        words = pa.array(tree.words, pa.string())
        out = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), head_type, pa.binary())], _SENT)]
        for stream in texts.column("rows"):
            for piece in (x for batch in pa.ipc.open_stream(stream.as_buffer()) for x in pieces(batch, size=PIECE_BYTES)):
                symbol, begin, place, distinct, of = _sequences(tree, piece)
                c = np.zeros(len(distinct) + 1, np.int64)
                hashes = np.full(len(distinct) + 1, _END_HASH, np.uint64)
                if len(of):
                    at = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                    c[:-1] = np.where(at >= 0, known[at] if len(known) else 0, 0)
                    own = pc.fill_null(pc.index_in(distinct, value_set=words), -1).to_numpy(zero_copy_only=False)
                    c[:-1] = np.where(own >= 0, tree.word_counts[own] if len(words) else 0, c[:-1])
                    hashes[:-1] = hash_words(distinct)
                rare_word = (c >= 2) & (c <= (rare or 0))
                rare_word[-1] = False
                c[-1] = tree.ends
                count = c[place]
                base = np.log10((count + 0.5) / (tree.total + 0.5 * (tree.distinct + 1)))
                full = np.log10(tree.predict(symbol, _before(symbol, len(tree.contexts))) * tree.within(symbol, count)) if tree.total else base
                n = np.diff(begin)
                sums = [np.add.reduceat(x, begin[:-1]) for x in (count > 0, base, full)]
                key = piece.column("row").to_numpy() << 1 | piece.column("train").to_numpy(zero_copy_only=False)
                head = pa.StructArray.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], fields=list(head_type))
                spread = mix(key).view(np.int64)
                if rare is None:
                    spread = (spread.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                out.append(pa.table([pa.array(key), pa.array(spread), pa.array(np.zeros(len(n), np.int64)), head, pa.nulls(len(n), pa.binary())], _SENT))
                if rare is None:
                    seen = (c >= 2)[place] & (place >= 0)
                    places, group, farther = _longer_contexts(tree, symbol, hashes[place], seen, begin, reach)
                    following = np.where((c >= 2)[place] | (place < 0), _short(tree, symbol, hashes[place]), 0)[places]
                    units = np.rint(np.minimum(-full[places], 60.0) * _SHORT_UNIT).astype(np.int64)
                    out.append(bundles(np.repeat(key, n)[places], group, *farther, following, units.astype(np.uint32)))
                    continue
                places, context = _exact_contexts(hashes[place], rare_word[place], begin, reach)
                if len(places):
                    following = hashes[place[places]] >> np.uint64(32) << np.uint64(32)
                    packed = (following | full[places].astype(np.float32).view(np.uint32).astype(np.uint64)).view(np.int64)
                    out.append(pa.table([pa.array(np.repeat(key, n)[places]), pa.array(context.view(np.int64)), pa.array(packed), pa.nulls(len(places), head_type), pa.nulls(len(places), pa.binary())], _SENT))
        return pa.concat_tables(out)

    return score


def weigh(context: np.ndarray, following: np.ndarray, shorter: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What exact contexts change in the log10 probability of each place; 0 where the context isn't retained.

    `shorter`: log10 probability from the shorter context. All places of a context must be given together.
    """
    order = np.lexsort((following, context))
    a, b, short, learnt = context[order], following[order], shorter[order] * np.log(10), train[order]
    new_context = np.concatenate([[True], a[1:] != a[:-1]])
    new_event = new_context | np.concatenate([[True], b[1:] != b[:-1]])
    of, event = np.cumsum(new_context) - 1, np.cumsum(new_event) - 1
    parent = of[new_event]
    n = np.bincount(event, learnt, len(parent))
    n[n < 2] = 0
    total = np.bincount(of, learnt, of[-1] + 1)
    mass = total - np.bincount(parent, n, len(total)) + PRIOR
    gain = np.log((n[event] + mass[of] * np.exp(short)) / (total + PRIOR)[of]) - short
    retained = np.bincount(of, gain * learnt, len(total)) >= LEAST_GAIN + np.bincount(parent, n > 0, len(total))
    out = np.empty(len(order))
    out[order] = np.where(retained[of], gain / np.log(10), 0.0)
    return out


def weigh_all(group: np.ndarray, farther: list[np.ndarray], following: np.ndarray, shorter: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The same as `weigh` for all contexts that begin with `group` and go on with `farther` words (0: none)."""
    first = shorter * np.log(10)
    at, p = np.arange(len(group)), first
    levels = []
    context = np.unique(group, return_inverse=True)[1]
    for k in range(len(farther) + 1):
        if k:
            on = np.flatnonzero((farther[k - 1][at] != 0) & (levels[-1][1][levels[-1][2]] >= 2))
            at, p = at[on], p[on]
            context = np.unique(levels[-1][2][on].astype(np.uint64) << np.uint64(32) | farther[k - 1][at], return_inverse=True)[1]
        if not len(at):
            break
        learnt = train[at]
        events, event = np.unique(context.astype(np.uint64) << np.uint64(32) | following[at], return_inverse=True)
        parent = (events >> np.uint64(32)).astype(np.int64)
        n = np.bincount(event, learnt, len(events))
        n[(n < 2) | (events & np.uint64(0xFFFFFFFF) == 0)] = 0
        total = np.bincount(context, learnt)
        mass = total - np.bincount(parent, n, len(total)) + PRIOR
        longer = np.log((n[event] + mass[context] * np.exp(p)) / (total + PRIOR)[context])
        retained = np.bincount(context, (longer - p) * learnt, len(total)) >= LEAST_GAIN + np.bincount(parent, n > 0, len(total))
        levels.append((at, total, context, longer, retained))
        p = longer
    out, done = first.copy(), np.zeros(len(group), bool)
    below = np.zeros(len(group), bool)  # a longer context of the place is retained
    for at, _, context, longer, retained in reversed(levels):
        kept = retained | (np.bincount(context, below[at], len(retained)) > 0)
        mine = kept[context]
        below[at] |= mine
        new = mine & ~done[at]
        out[at[new]], done[at[new]] = longer[new], True
    return (out - first) / np.log(10)


def _weighed(kind: pa.DataType, reach: int) -> Callable:
    names = ["key", "more", "doc_id", "n_tokens", "n_known", "base", "score"]
    kinds = [pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bundled = [], []
        for batch in batches:
            many = batch.filter(pc.is_valid(batch.column("bundle")))
            bundled += [_unbundle(x.as_buffer(), n, _widths(max(reach - 1, 1))) for x, n in zip(many.column("bundle"), many.column("packed").to_pylist(), strict=True)]
            batch = batch.filter(pc.is_null(batch.column("bundle")))
            is_head = pc.is_valid(batch.column("head"))
            heads = batch.filter(is_head)
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([heads.column("key"), pa.nulls(heads.num_rows, pa.int64()), *heads.column("head").flatten()], names)
            links = batch.filter(pc.invert(is_head))
            if links.num_rows:
                held.append(tuple(links.column(x).to_numpy() for x in ("key", "context", "packed")))
        if held or bundled:
            if held:
                key, context, packed = (np.concatenate(x) for x in zip(*held))
                shorter = (packed & 0xFFFFFFFF).astype(np.uint32).view(np.float32).astype(np.float64)
                change = weigh(context, packed >> 32, shorter, key & 1)
            else:
                key, group, *farther, following, short = (np.concatenate(x) for x in zip(*bundled))
                key = key.view(np.int64)
                change = weigh_all(group, farther, following, short / -_SHORT_UNIT, key & 1)
            units = np.rint(change * _UNIT)
            on = np.flatnonzero(units)
            keys, at = np.unique(key[on], return_inverse=True)
            more = np.bincount(at, units[on], len(keys)).astype(np.int64)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(more), *(pa.nulls(len(keys), t) for t in kinds[2:])], names)

    return weighed


_SENT = ["key", "context", "packed", "head", "bundle"]


def _widths(farther: int) -> list[int]:
    """Bytes of the columns of a bundle: key, group, farther words, next word, probability from the shorter context."""
    return [8, 5, *[4] * farther, 4, 4]


def score_texts(docs: DataFrame, depth: int = 1, reach: int = 3, rare: int | None = None) -> DataFrame:
    """Learns from rows of `docs` (doc_id, text, train) with `train` and scores all rows.

    Exact contexts are all of up to `reach` (at most 3) words, frequent ones have as many symbols, or `depth`. With `rare`
    frequent contexts have up to `depth` symbols, exact ones up to `reach` words from one seen at most `rare` times on.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).
    """
    if rare is None:
        depth = max(depth, reach)
    if depth > 3:
        raise ValueError("contexts have three symbols at most")
    spark = docs.sparkSession
    size = staging.text_bytes(docs)
    field = docs.schema["doc_id"].dataType
    kind, arrow = field.simpleString(), to_arrow_type(field)
    rows = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"), F.monotonically_increasing_id().alias("row"))
    blocked = staging.staged(rows.mapInArrow(_dealt, f"doc_id {kind}, text string, train boolean, row bigint, block bigint"), "tree-texts")
    asked = blocked.select("block", "text", "train").mapInArrow(_word_counts, "block bigint, word string, n bigint")
    by_word = Window.partitionBy("word").orderBy("block")
    everywhere = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = asked.select("block", "word", F.sum("n").over(everywhere).alias("c"), F.row_number().over(by_word).alias("first"))
    asked = staging.staged(asked.select("block", "word", "c", (F.col("first") == 1).alias("first")), "tree-words")
    vocabulary = asked.where("first and c > 0").select("word", "c")
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = blocked.where("train").count()
    total = (whole["n"] or 0) + ends
    frequent = sorted((r["word"], r["c"]) for r in vocabulary.where(F.col("c") >= max(SYMBOL_SHARE * total, 1.0)).collect())
    others = vocabulary.where(F.col("c") < max(SYMBOL_SHARE * total, 1.0)).groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    others = staging.staged(others, "tree-classes")
    classes = sorted((r["ending"], r["n"], r["v"]) for r in others.where(F.col("n") >= SYMBOL_SHARE * total).collect())
    rest = others.where(F.col("n") < SYMBOL_SHARE * total).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    numbers = lambda rows, i: np.array([r[i] for r in rows], np.int64)
    tree = Tree(total, (whole["v"] or 0) + (ends > 0), ends, [r[0] for r in frequent], numbers(frequent, 1), [r[0] for r in classes], numbers(classes, 1), numbers(classes, 2), (rest["n"] or 0, rest["v"] or 0))
    tree.finish()
    if total:
        since = staging.mark(spark)
        _grow(tree, blocked, depth)
        staging.release(spark, since)
    sent = spark.sparkContext.broadcast(tree)
    needed = asked.where((F.col("c") > 0) & (F.col("c") < max(SYMBOL_SHARE * total, 1.0))).select(F.col("block").alias("side"), "word", "c")
    schema = f"key bigint, context bigint, packed bigint, head struct<doc_id: {kind}, n_tokens: bigint, n_known: bigint, base: double, score: double>, bundle binary"
    parts_n = max(32, size // LINK_BYTES + 1)
    scored = blocked.mapInArrow(_packed, "block bigint, rows binary").groupBy("block").cogroup(needed.groupBy("side")).applyInArrow(_scorer(sent, arrow, reach, rare, parts_n), schema)
    parts = scored.repartition(parts_n, "context")
    parts = parts.mapInArrow(_weighed(arrow, reach), f"key bigint, more bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double")
    whole_rows = parts.groupBy("key").agg(F.sum("more").alias("more"), *(F.max(x).alias(x) for x in ("doc_id", "n_tokens", "n_known", "base", "score")))
    more = F.coalesce("more", F.lit(0)) / F.lit(_UNIT)
    held_out = F.col("key").bitwiseAND(F.lit(1)) == 0
    return whole_rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + more).alias("score"))
