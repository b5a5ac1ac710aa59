"""Token counts by finite-state transducers, without building the tokens.

Two transducers are compiled from the tokenizer file.

* The splitter runs over character classes and marks where each piece (letters, one digit, signs, a contraction) begins.
  Texts are cut into chunks; for each chunk the map from every state to its end state is computed, the maps are composed
  by a parallel prefix scan, and each chunk is then run from its true state.
* The counter runs over the bytes of a piece. A state stands for a prefix; it knows the last token of the prefix's
  encoding and the tokens emitted on the way to it, so a transition emits the difference of two states. The last token
  after one more byte is the only vocabulary entry that ends there and may follow the token before it. States and end
  transitions are compiled when first reached, and all dropped when there are over MAX_STATES. Pieces of over LONG bytes
  are run without compiling states. Time is linear in a piece's length.

Null texts count as empty: no bytes, no tokens. Repeated rows count alike, extra columns are dropped, and texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encode_words, pieces, plain, strings

CHUNK = 256
MAX_STATES = 800_000
LONG = 256
_BLANK, _DIGIT, _SIGN, _QUOTE, _STMD, _RV, _ELL, _EE, _LETTER = range(9)
_BETWEEN, _IN_LETTERS, _IN_SIGNS, _AT_QUOTE, _QUOTE_RV, _QUOTE_ELL = range(6)
_HERE, _BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks (a piece begins here; a piece began one character before), by class and state."""
    to, marks = np.zeros((9, 6), np.uint8), np.zeros((9, 6), np.uint8)
    letters = (_STMD, _RV, _ELL, _EE, _LETTER)
    for s in range(6):
        # after a quote and one letter the contraction may not come about: then that letter began a piece
        late = _BEFORE if s in (_QUOTE_RV, _QUOTE_ELL) else 0
        to[_BLANK, s], marks[_BLANK, s] = _BETWEEN, late
        to[_DIGIT, s], marks[_DIGIT, s] = _BETWEEN, late | _HERE
        signs = s in (_IN_SIGNS, _AT_QUOTE)
        to[_SIGN, s], marks[_SIGN, s] = _IN_SIGNS, 0 if signs else late | _HERE
        to[_QUOTE, s], marks[_QUOTE, s] = (_IN_SIGNS, 0) if signs else (_AT_QUOTE, late | _HERE)
        for c in letters:
            to[c, s], marks[c, s] = _IN_LETTERS, late or (0 if s == _IN_LETTERS else _HERE)
    to[_STMD, _AT_QUOTE], marks[_STMD, _AT_QUOTE] = _BETWEEN, 0
    to[_RV, _AT_QUOTE], marks[_RV, _AT_QUOTE] = _QUOTE_RV, 0
    to[_ELL, _AT_QUOTE], marks[_ELL, _AT_QUOTE] = _QUOTE_ELL, 0
    to[_EE, _QUOTE_RV], marks[_EE, _QUOTE_RV] = _BETWEEN, 0
    to[_ELL, _QUOTE_ELL], marks[_ELL, _QUOTE_ELL] = _BETWEEN, 0
    return to, marks


def _class(c: str) -> int:
    if c in "'":
        return _QUOTE
    if c in "stmd":
        return _STMD
    if c in "rv":
        return _RV
    if c in "le":
        return _ELL if c == "l" else _EE
    kind = unicodedata.category(c)
    if kind[0] in "LN":
        return _LETTER if kind[0] == "L" else _DIGIT
    # White_Space, which unlike str.isspace has no information separators
    return _BLANK if c.isspace() and not "\x1c" <= c <= "\x1f" else _SIGN


@functools.cache
def _classes() -> np.ndarray:
    return np.fromiter((_class(chr(i)) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def chunk_maps(classes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each chunk (row of classes) the end state of every state."""
    maps = np.tile(np.arange(to.shape[1], dtype=np.uint8), (len(classes), 1))
    for column in classes.T:
        maps = to[column[:, None], maps]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of maps 0..i, in log2(n) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        later = np.take_along_axis(out[step:], out[:-step], axis=1)
        out[step:] = later
        step *= 2
    return out


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """True where a piece begins; `classes` ends with a blank."""
    to, marks = _splitter()
    n = len(classes)
    grid = np.full(-(-n // CHUNK) * CHUNK, _BLANK, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(-1, CHUNK)
    scanned = prefix_scan(chunk_maps(grid, to))
    state = np.concatenate([[_BETWEEN], scanned[:-1, _BETWEEN]]).astype(np.uint8)
    found = np.empty_like(grid)
    for i, column in enumerate(grid.T):
        found[:, i] = marks[column, state]
        state = to[column, state]
    found = found.ravel()[:n]
    starts = (found & _HERE) > 0
    starts[:-1] |= (found[1:] & _BEFORE) > 0
    return starts


class Counter:
    """The counting transducer of a byte-level BPE whose last byte carries an end-of-word sign."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        byte_of = _byte_alphabet()
        self.rank: dict[tuple[bytes, bytes], tuple[int, bytes]] = {}
        tokens = {self._bytes(t, byte_of) for t in model["vocab"] if not self.special.fullmatch(t)}
        for i, m in enumerate(model["merges"]):
            a, b = (self._bytes(x, byte_of) for x in (m if isinstance(m, list) else m.split(" ", 1)))
            self.rank.setdefault((a, b), (i, a + b))
        # a token's end sign is kept as a trailing marker that no UTF-8 text holds
        self.tokens = {t for t in tokens if self.merged(t) == [t]}
        self.plain_tokens = {t for t in self.tokens if t[-1:] != _END}
        self.longest = max(map(len, self.tokens), default=1)
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def _bytes(self, token: str, byte_of: dict[str, int]) -> bytes:
        end = token.endswith(self.suffix) and token != self.suffix
        body = token[: -len(self.suffix)] if end else token
        return bytes(byte_of[c] for c in body) + (_END if end else b"")

    def merged(self, word: bytes) -> list[bytes]:
        """The plain merge procedure, for vocabulary entries and pairs of them."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 1 and parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        while len(parts) > 1:
            best = min(((r[0], i) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1])))), default=None)
            if best is None:
                break
            i = best[1]
            pair, out, k = (parts[i], parts[i + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            ok = self.follows[a, b] = self.merged(a + b) == [a, b]
        return ok

    def reset(self) -> None:
        self.next: dict[int, int] = {}  # state and byte -> state
        self.ends: dict[int, int] = {}  # state and last byte -> tokens of the piece
        self.last: list[bytes] = [b""]
        self.total: list[int] = [0]
        self.follows.clear()

    def _last_token(self, body: bytes, n: int, last: list[bytes], total: list[int], vocabulary: set[bytes], end: bytes) -> tuple[bytes, int]:
        """Last token of the encoding of `body[:n] + end`, and the number of tokens, given both for all shorter prefixes."""
        for size in range(min(self.longest, n), 0, -1):
            token = body[n - size : n] + end
            if token in vocabulary and (n == size or self.may_follow(last[n - size], token)):
                return token, total[n - size] + 1
        return body[n - 1 : n] + end, total[n - 1] + 1

    def count(self, piece: bytes) -> int:
        """Runs one piece through the transducer, compiling transitions that it lacks."""
        if len(self.last) + len(self.ends) + len(self.follows) > MAX_STATES:
            self.reset()
        last, total, state = [b""], [0], 0
        compiled = len(piece) <= LONG
        for n, byte in enumerate(piece[:-1], 1):
            to = self.next.get(state << 8 | byte) if compiled else None
            if to is None:
                token, tokens = self._last_token(piece, n, last, total, self.plain_tokens, b"")
                if compiled:
                    to = self.next[state << 8 | byte] = len(self.last)
                    self.last.append(token)
                    self.total.append(tokens)
            else:
                token, tokens = self.last[to], self.total[to]
            last.append(token)
            total.append(tokens)
            state = to
        known = self.ends.get(state << 8 | piece[-1]) if compiled else None
        if known is None:
            known = self._last_token(piece, len(piece), last, total, self.tokens, _END)[1]
            if compiled:
                self.ends[state << 8 | piece[-1]] = known
        return known


_END = b"\xff"


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as is, others from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def _normal(text: str) -> str:
    if not text.isascii():
        # lower-casing goes character by character: a final sigma is like any other
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_known: dict[str, dict[str, int]] = {}


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, special strings taken as one token each."""
    counter, known = _counter(path), _known.setdefault(path, {})
    specials = np.zeros(len(texts), np.int64)
    normal = []
    for i, text in enumerate(texts):
        if "<|" in text:
            text, specials[i] = counter.special.subn("\n", text)
        normal.append(_normal(text))
    joined = "\n".join([*normal, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = _classes()[points]
    starts = piece_starts(classes)
    solid = classes != _BLANK
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.flatnonzero(starts)
    offset = np.concatenate([[0], np.cumsum(np.where(solid, width, 0))])
    data = np.frombuffer(joined.encode(), np.uint8)[np.repeat(solid, width)]
    codes, distinct = encode_words(strings(data, np.concatenate([offset[at], offset[-1:]])))
    table = np.zeros(max(len(distinct), 1), np.int64)
    for i, piece in enumerate(distinct.to_pylist() if len(codes) else ()):
        n = known.get(piece)
        if n is None:
            n = known[piece] = counter.count(piece.encode())
        table[i] = n
        if len(piece) > LONG:
            del known[piece]
    if len(known) > MAX_STATES:
        known.clear()
    sums = np.concatenate([[0], np.cumsum(table[codes])])
    ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)
    upto = sums[np.searchsorted(at, ends)]
    return np.diff(upto, prepend=0) + specials


def _runner(path: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = plain(piece.column("text"))
                n = count_tokens(texts.to_pylist(), path)
                size = pa.array([], pa.int64()) if not len(texts) else pa.array(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), one row for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(_runner(path, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
