"""Token-id files: documents compressed one by one with a shared zstandard dictionary, and an offset index beside them.

A written set has two Parquet tables that any store can hold: `dictionary` (one row: hash, bytes, width of an id in
bytes) and `shards` (rows of at most SHARD_BYTES of payload, or one document: part, row, dictionary hash, keys, offsets
into the payload, token counts, payload). Ids are little-endian unsigned integers of that width; readers take it from the
files, and a width that can't hold the tokenizer's ids is refused. A document is read by cutting its range out of one
payload.

Null texts count as empty and hold the end id alone. Keys are integers. Repeated keys stay apart, in no fixed order; null
keys come first. Extra columns are dropped, texts of any length are encoded whole. An empty table gives an empty set with
an untrained (empty) dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import staging
from .words import encode_words, pieces, plain, split_words

#: Documents that the dictionary is trained on at most, bytes of each that it sees, and its size.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 4 << 20
LEVEL = 3
#: Chunks in a generation of the cache (two are held, so frequent chunks stay), and chunks that the library encodes at a time (its results are large).
_CACHE = 300_000
_BATCH = 4096
#: Blanks that the tokenizer drops wherever they stand; no token spans one.
_CUTS = np.arange(256, dtype=np.uint8)
_CUTS[[0x09, 0x0A, 0x0D]] = 0x20
_CUTS_LOWER = np.where((_CUTS >= 0x41) & (_CUTS <= 0x5A), _CUTS + 0x20, _CUTS).astype(np.uint8)
_LETTERS, _STOPS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOPS[[*b".,;:!?"]] = True


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special_string(tokenizer) -> tuple[str, int]:
    """A special string that is looked for in the text as it stands and takes nothing from what is around it, and its id."""
    for i, t in sorted(tokenizer.get_added_tokens_decoder().items()):
        if t.content.startswith("<|") and not (t.normalized or t.lstrip or t.rstrip or t.single_word):
            return t.content, i
    return "", -1


class WordEncoder:
    """Ids of whole texts, each distinct blank-free chunk encoded once by the library.

    Valid for tokenizers that lower-case, drop white space and part letters from other signs, as the word BPE does: no
    token, special string or normalisation reaches across a space, tab or line break, or from a Latin letter to a stop.
    Texts with `<|`, which may begin a special string, keep their case until the library has looked for it.
    """

    def __init__(self, path: str, most: int = _CACHE):
        self.tokenizer, self.known, self.older = _tokenizer(path), {}, {}
        self.most = most
        self.apart = _special_string(self.tokenizer)

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as the bytes of 32-bit integers, which take less room than arrays."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = [x for x, v in zip(chunks, map(known.get, chunks), strict=True) if v is None]
        known.update((x, older[x]) for x in missing if x in older)
        new = [x for x in missing if x not in known]
        for i in range(0, len(new), _BATCH):
            self._learn(new[i : i + _BATCH])
        return [*map(known.__getitem__, chunks)]

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, those that can hold no special string in one text with a special string after each."""
        text, apart = self.apart
        joint = [x for x in chunks if "<|" not in x] if text else []
        if joint:
            found = np.asarray(self.tokenizer.encode_batch_fast([text.join([*joint, ""])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(found == apart)
            data, ends = found.tobytes(), (4 * ends).tolist()
            for x, a, b in zip(joint, [0, *(e + 4 for e in ends[:-1])], ends, strict=True):
                self.known[x] = data[a:b]
        for x in chunks if not text else (x for x in chunks if "<|" in x):
            self.known[x] = np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one flat array, and per text the offset of its first id."""
        texts = plain(texts)
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        words, first = split_words(texts, _CUTS if special else _CUTS_LOWER, (_LETTERS, _STOPS))
        codes, distinct = encode_words(words)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        taken = pa.array(self.ids(distinct.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1) // 4
        flat = np.frombuffer(taken.buffers()[2], np.uint32, ends[-1]) if ends[-1] else np.zeros(0, np.uint32)
        return flat, ends[first]


@functools.cache
def _encoder(path: str, most: int) -> WordEncoder:
    return WordEncoder(path, most)


def _documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int, piece_bytes: int = 1 << 20, cache: int = _CACHE) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and ids, a piece of a batch at a time."""
    encoder = _encoder(path, cache)
    for batch in batches:
        for piece in pieces(batch, size=piece_bytes):
            ids, first = encoder.encode(piece.column("text"))
            end = np.array([end_id], np.uint32)
            yield piece.column("doc_id").to_pylist(), [np.concatenate([ids[a:b], end]) for a, b in zip(first, first[1:], strict=False)]


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _trainer(path: str, end_id: int, width: int, cache: int) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [x.astype(f"<u{width}").tobytes()[:SAMPLE_BYTES] for _, docs in _documents(batches, path, end_id, cache=cache) for x in docs]
        data = b""
        if sum(map(len, samples)) > 10 * DICTIONARY_BYTES:
            try:
                data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
            except zstandard.ZstdError:  # too uniform to train on
                data = b""
        yield pa.RecordBatch.from_pydict({"hash": [dictionary_hash(data)], "data": [data], "width": [width]}, pa.schema([("hash", pa.string()), ("data", pa.binary()), ("width", pa.int32())]))

    return train


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, cache: int = _CACHE) -> DataFrame:
    """One row (hash, data, width), from the SAMPLE_DOCS documents whose key hashes lowest among about four times as many, which
    a threshold on other bits of the hash leaves, so that no task sees more than a few samples."""
    order = F.xxhash64("doc_id", "text")
    share = min(1.0, 4 * SAMPLE_DOCS / max(docs.count(), 1))
    near = docs.where(F.pmod(order, F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    sample = near.select("doc_id", F.substring("text", 1, SAMPLE_BYTES).alias("text")).orderBy(order).limit(SAMPLE_DOCS)
    return sample.coalesce(1).mapInArrow(_trainer(path, end_id, width, cache), "hash string, data binary, width int")


_SHARD = "part int, row int, dictionary string, doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, payload binary"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(data) if data else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_checksum=False)


def _writer(path: str, end_id: int, width: int, dictionary: bytes, piece_bytes: int, cache: int) -> Callable:
    name = dictionary_hash(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, squeeze = TaskContext.get().partitionId(), 0, _compressor(dictionary)
        keys: list[int] = []
        counts: list[int] = []
        blobs: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64).tolist()
            return pa.RecordBatch.from_pydict({"part": [part], "row": [row], "dictionary": [name], "doc_ids": [keys], "offsets": [offsets], "counts": [counts], "payload": [b"".join(blobs)]}, _SHARD_ARROW)

        for ids, docs in _documents(batches, path, end_id, piece_bytes, cache):
            for key, x in zip(ids, docs, strict=True):
                blobs.append(squeeze.compress(x.astype(f"<u{width}").tobytes()))
                keys.append(key)
                counts.append(len(x))
                held += len(blobs[-1])
                if held >= SHARD_BYTES:
                    yield shard()
                    keys, counts, blobs, held, row = [], [], [], 0, row + 1
        if keys:
            yield shard()

    return write


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 2, width: int = 2, part_bytes: int = 16 << 20, piece_bytes: int = 2 << 20, cache: int = _CACHE) -> str:
    """Writes ids of `docs` (doc_id, text) under `out` in ascending doc_id order, parts by range. Texts are encoded about
    `piece_bytes` at a time, with `cache` chunks in a generation of the cache (smaller: less memory, more time). Returns `out`."""
    spark = docs.sparkSession
    if max(_tokenizer(path).get_vocab_size() - 1, end_id) >> 8 * width:
        raise ValueError(f"ids of {path} don't fit into {width} bytes")
    docs = docs.select("doc_id", "text")
    train_dictionary(docs, path, end_id, width, cache).write.parquet(f"{out}/dictionary")
    known = spark.read.parquet(f"{out}/dictionary").first()
    if known is None:  # no task has run, as the plan knows that there are no documents
        spark.createDataFrame([(dictionary_hash(b""), b"", width)], "hash string, data binary, width int").write.mode("append").parquet(f"{out}/dictionary")
    dictionary = bytes(known["data"]) if known else b""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), staging.text_bytes(docs) // part_bytes + 1)
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_writer(path, end_id, width, dictionary, piece_bytes, cache), _SHARD).write.parquet(f"{out}/shards")
    return out


def _reader(width: int, dictionary: bytes, fold: Callable) -> Callable:
    name = dictionary_hash(dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        expand = zstandard.ZstdDecompressor(dict_data=given)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"shard written with dictionary {row['dictionary']}, read with {name}")
                cuts, payload = row["offsets"], row["payload"]
                docs = (np.frombuffer(expand.decompress(payload[a:b]), f"<u{width}") for a, b in zip(cuts, cuts[1:], strict=False))
                yield fold(row, docs)

    return read


def _digest_rows(row: dict, docs: Iterator[np.ndarray]) -> pa.RecordBatch:
    counts, sums = [], []
    for x in docs:
        counts.append(len(x))
        sums.append(zlib.crc32(x.astype("<u4").tobytes()))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = len(counts)
    return pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["row"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["part", "row", "doc_id", "local", "n_tokens", "ids_crc32"])


def _id_rows(row: dict, docs: Iterator[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64()))], ["doc_id", "ids"])


def _opened(spark: SparkSession, out: str) -> tuple[DataFrame, bytes, int]:
    known = spark.read.parquet(f"{out}/dictionary").first()
    return spark.read.schema(_SHARD).parquet(f"{out}/shards"), bytes(known["data"]), known["width"]


def read_ids(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of those named: only shards whose index has one of them are opened."""
    shards, dictionary, width = _opened(spark, out)
    if doc_ids is not None:
        shards = shards.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)) for x in doc_ids])))
    rows = shards.mapInArrow(_reader(width, dictionary, _id_rows), "doc_id bigint, ids array<bigint>")
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts add three sums: inside a shard, over the shards of a part, and over parts. Only the last one, a row for each
    part, runs in one task.
    """
    shards, dictionary, width = _opened(spark, out)
    sizes = shards.select("part", "row", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "row", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    rows = shards.mapInArrow(_reader(width, dictionary, _digest_rows), "part int, row int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    rows = rows.join(starts, ["part", "row"])
    return rows.select("doc_id", (F.col("base") + F.col("inner") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

