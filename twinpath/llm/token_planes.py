"""Token ids in files of byte or bit planes.

Documents are encoded in the order of their ids. The ids of a stretch of
documents, a shard, run on without gaps and are cut into blocks of `BLOCK_IDS`;
each block is transposed, so that the lowest bytes (or bits) of all its ids come
first, then the next, and each plane is compressed with zstandard by itself: the
high planes nearly vanish. A blob holds one block:

    "TPL1", bits for each plane (8 or 1), three unused bytes, number of ids,
    number of planes, the compressed length of each plane, the planes

with integers of 32 bits, little-endian. Blobs are rows of a Parquet table, for
Spark's writers commit whole files on any store that the cluster reads and drop
those of lost tasks. The other columns are the chunk index: shard, chunk, place
of the first id, number of ids, and the id, place and length of every document
that has ids in the chunk.

Defined cases: a null text is the empty text, whose only id is the end id; equal
document ids follow each other in the order of their texts, null ids come
first; an empty table writes an empty one; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, ensure_checkpoint_dir, shared_path, shuffle_partitions, slices, text_of, with_order_bucket
from .word_cache import WHITE, ByteParts, Parted, WordEncoder, byte_slices
from .word_cache import packed as packed_ids

MAGIC = b"TPL1"
BLOCK_IDS = 1 << 16
LEVEL = 3


def planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; bits 8: byte planes, 1: bit planes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(4)]
    flat = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(flat[:, i], bitorder="little").tobytes() for i in range(32)]


def joined(parts: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ids of n-id planes: the inverse of `planes`."""
    if bits == 8:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        rows = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def packed(ids: np.ndarray, bits: int = 8) -> bytes:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    parts = [compressor.compress(p) for p in planes(ids, bits)]
    return MAGIC + struct.pack(f"<B3xII{len(parts)}I", bits, len(ids), len(parts), *map(len, parts)) + b"".join(parts)


def unpacked(blob: bytes) -> np.ndarray:
    if blob[:4] != MAGIC:
        raise ValueError("not a block of token planes")
    bits, n, count = struct.unpack_from("<B3xII", blob, 4)
    lengths = struct.unpack_from(f"<{count}I", blob, 16)
    at, parts, expander = 16 + 4 * count, [], zstandard.ZstdDecompressor()
    for length in lengths:
        parts.append(expander.decompress(blob[at : at + length]))
        at += length
    return joined(parts, n, bits)


def crc_combined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings joined, from theirs and the length of the second.

    Appending a byte of zeros is linear over the bits of a CRC; its matrix is
    squared along the bits of the length.
    """

    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for i in range(32):
            if vector >> i & 1:
                total ^= matrix[i]
        return total

    bit = [0xEDB88320, *(1 << i for i in range(31))]  # one bit of zeros
    matrix = bit
    for _ in range(3):
        matrix = [times(matrix, column) for column in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, column) for column in matrix]
        length >>= 1
    return first ^ second


class Shard:
    """Gathers the ids of a shard's documents and gives off full blocks as rows."""

    def __init__(self, number: int, block_ids: int, bits: int) -> None:
        self.number, self.block, self.bits = number, block_ids, bits
        self.waiting, self.docs = bytearray(), []
        self.first = self.end = self.chunk = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        self.docs.append((doc_id, self.end, n))
        self.end += n
        self.waiting += ids
        while len(self.waiting) >= 4 * self.block:
            yield self.row(self.block)

    def rest(self) -> Iterator[tuple]:
        if self.waiting:
            yield self.row(len(self.waiting) // 4)

    def row(self, n: int) -> tuple:
        ids = np.frombuffer(bytes(self.waiting[: 4 * n]), "<u4")
        del self.waiting[: 4 * n]
        stop = self.first + n
        held = [d for d in self.docs if d[1] < stop]
        row = (self.number, self.chunk, self.first, n, [d[0] for d in held], [d[1] for d in held], [d[2] for d in held], packed(ids, self.bits))
        self.docs = [d for d in self.docs if d[1] + d[2] > stop]
        self.first, self.chunk = stop, self.chunk + 1
        return row


CHUNKS = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_firsts array<long>, doc_lengths array<long>, blob binary"
ARROW_CHUNKS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_firsts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("blob", pa.binary())])


def splits_at_spaces(tokenizer_json: dict) -> bool:
    """Byte-level BPE with its own pattern, no normaliser, no added space and no added token with white space: words are independent."""
    pre = tokenizer_json.get("pre_tokenizer") or {}
    plain = not tokenizer_json.get("normalizer") and not any(re.search(r"\s", t) for t in added_tokens(tokenizer_json))
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def added_tokens(tokenizer_json: dict) -> list[str]:
    return [t["content"] for t in tokenizer_json.get("added_tokens") or []]


def quoted(text: str) -> str:
    """A pattern of RE2 that matches the text itself."""
    return "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in text)


@functools.cache  # a worker keeps it from task to task
def encoder(tokenizer_path: str) -> WordEncoder:
    """An encoder by a tokenizer file and its own settings; texts that hold a string of an added token go whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    learn, settings = None, json.loads(tokenizer.to_str())
    if splits_at_spaces(settings):
        # the letters of a byte-level token stand for a byte each
        lengths = [len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]
        learn = ByteParts(tokenizer, Parted(whole, lengths, 1, " "))
    # a space before white space or the end may go with either side
    dependent = "|".join([f" ({WHITE}|$)", *(quoted(t) for t in added_tokens(settings))])
    return WordEncoder(whole, learn, dependent, lambda words: [packed_ids(ids) for ids in whole(words)])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, bits: int = 8, shards: int | None = None) -> None:
    """Encodes docs in ascending id order and writes the blocks and their index to path."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    placed = with_order_bucket(narrow, "id", shards or 4 * shuffle_partitions(spark), "shard")
    ordered = placed.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, shard = encoder(tokenizer_path), struct.pack("<I", end_id), None

        def record(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW_CHUNKS, strict=True)], schema=ARROW_CHUNKS)

        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            numbers, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for number, doc_id, found in zip(numbers, ids, coder.batch(batch.column(1)), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        yield from map(record, shard.rest())
                    shard = Shard(number, block_ids, bits)
                yield from map(record, shard.add(doc_id, found.tobytes() + end))
        if shard is not None:
            yield from map(record, shard.rest())

    bounded(ordered).mapInArrow(kernel, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the blobs alone.

    Each block gives the CRC of the documents' pieces in it; only these meet in a
    shuffle, where the pieces of a document are combined.
    """
    chunks = spark.read.parquet(path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            rows = []
            for row in batch.to_pylist():
                ids = unpacked(row["blob"])
                first, stop = row["first"], row["first"] + len(ids)
                for doc_id, begin, length in zip(row["doc_ids"], row["doc_firsts"], row["doc_lengths"], strict=True):
                    a, b = max(begin, first), min(begin + length, stop)
                    rows.append((row["shard"], begin, doc_id, length, a, b - a, zlib.crc32(ids[a - first : b - first].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32()] + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "begin", "id", "n_tokens", "at", "n", "crc"])

    found = chunks.mapInArrow(pieces, "shard int, begin long, id long, n_tokens long, at long, n long, crc long")
    gathered = found.groupBy("shard", "begin", "id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for parts in batch.column(4).to_pylist():
                total, done = 0, 0
                for part in parts:
                    total = crc_combined(total, part["crc"], 4 * part["n"]) if done else part["crc"]
                    done += part["n"]
                sums.append((total, done))
            whole = [n for _, n in sums]
            if whole != batch.column(3).to_pylist():
                raise ValueError("a document's pieces don't add up to its length")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([c for c, _ in sums], pa.int64())], names=["shard", "begin", "id", "n_tokens", "ids_crc32"])

    summed = gathered.mapInArrow(combined, "shard int, begin long, id long, n_tokens long, ids_crc32 long")
    # one row for each shard; there are as many as were asked for
    totals = sorted(chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, done = [], 0
    for shard, n in totals:
        starts.append((shard, done))
        done += n
    table = F.broadcast(spark.createDataFrame(starts, "shard int, before long"))
    return summed.join(table, "shard").select("id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder among the shared ones, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    shared_path(spark, path)
    return path
