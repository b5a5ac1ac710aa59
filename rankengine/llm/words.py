"""Word splitting on Arrow string buffers, shared by the text operators of this subpackage.

A separator table maps every byte to itself, to its lower-case form or to a space. All separators are ASCII, so
multi-byte UTF-8 characters pass through unchanged and no text is decoded. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
_BLANKS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def _blank_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    table[_BLANKS] = SPACE
    return table


def _alnum_table() -> np.ndarray:
    table = _blank_table(lower=True)
    table[0x00:0x30] = SPACE
    table[0x3A:0x41] = SPACE
    table[0x5B:0x61] = SPACE
    table[0x7B:0x80] = SPACE
    return table


#: Words are runs without ASCII white space; case kept.
BLANK = _blank_table(lower=False)
#: The same with A-Z lower-cased.
BLANK_LOWER = _blank_table(lower=True)
#: Words are runs of ASCII letters and digits and of everything beyond ASCII; A-Z lower-cased.
ALNUM_LOWER = _alnum_table()


def plain(texts: pa.Array) -> pa.StringArray:
    """The texts as a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    return texts.fill_null("") if texts.null_count else texts


def raw(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a null-free string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not offsets[-1] - offsets[0]:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def split_words(texts: pa.Array, table: np.ndarray, joint: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[pa.StringArray, np.ndarray]:
    """All words of all texts in one flat array, and per text the offset of its first word (one entry more).

    `joint` (two masks over byte values) also parts a word between a byte of the first mask and one of the second.
    """
    offsets, data = raw(plain(texts))
    data = table[data]
    inside = data != SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if joint is not None and len(data):
        edge[1:-1] |= joint[0][data[:-1]] & joint[1][data[1:]]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    kept = np.concatenate([[0], np.cumsum(inside)])
    word_offsets = np.concatenate([kept[starts], kept[-1:]])
    return strings(data[inside], word_offsets), np.searchsorted(starts, offsets)


def encode_words(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Code of each word and the distinct words that the codes stand for."""
    if not len(words):
        return np.zeros(0, np.int64), words
    coded = pc.dictionary_encode(words)
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def hash_words(distinct: pa.StringArray) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, or one row if that is longer."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
