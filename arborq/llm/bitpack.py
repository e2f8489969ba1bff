"""Token-id files with fixed-width bit packing (operator 2).

A chunk file holds the ids of whole documents in a row. Every id takes the minimum number of bits for the vocabulary,
ids come in blocks of BLOCK, and the block offsets let a reader unpack any block alone with numpy:

    magic 4 bytes | version u2 | width u1 | flags u1 | block u4 | n_docs u4 | n_blocks u4 | pad u4 | first u8 | n_ids u8
    doc_id i8[n_docs] | is_null u1[n_docs] | id_start u8[n_docs + 1] | block_offset u8[n_blocks + 1] | payload

all little-endian; `first` is the chunk's first id within its shard. Inside a block, 64 ids take `width` words of
64 bits: id j of the 64 starts at bit j * width. Chunk files lie in a Parquet dataset, one a row in a binary column, so
any store that Spark writes to will do and a lost task's files are written again by Spark's commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborq.llm import common
from arborq.llm.tokenizing import MORE_WORDS, encoder, tokenizer_path

MAGIC, VERSION, BLOCK, LANES = b"AQID", 1, 4096, 64
#: A chunk is closed once it has so many ids; only a document longer than that makes a larger one.
CHUNK_IDS = 1 << 20
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
HEAD = struct.Struct("<4sHBBIIIIQQ")


def width_for(vocabulary: int) -> int:
    """The fewest bits that tell the ids 0 to vocabulary - 1 apart."""
    if not 1 <= vocabulary <= 1 << 32:
        raise ValueError(f"vocabulary of {vocabulary} ids")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2 ** width, in groups of 64 that take width 64-bit words each; the last group is filled with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    filled = -(-len(ids) // LANES) * LANES
    if width in WHOLE:  # the same layout: an id lies in whole bytes
        return ids.astype(WHOLE[width]).tobytes() + bytes((filled - len(ids)) * width // 8)
    lanes = np.zeros(filled, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, LANES)
    words = np.zeros((len(lanes), width), np.uint64)
    for j in range(LANES):
        word, bit = divmod(j * width, 64)
        words[:, word] |= lanes[:, j] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - bit)
    return words.astype("<u8", copy=False).tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in WHOLE:
        return np.frombuffer(data, WHOLE[width], n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    lanes, mask = np.empty((len(words), LANES), np.uint32), np.uint64((1 << width) - 1)
    for j in range(LANES):
        word, bit = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | words[:, word + 1] << np.uint64(64 - bit)
        lanes[:, j] = x & mask
    return lanes.reshape(-1)[:n]


def write_chunk(doc_ids: list[int | None], ids: list[np.ndarray], width: int, first: int = 0) -> bytes:
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [pack(flat[i : i + BLOCK], width) for i in range(0, len(flat), BLOCK)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    return b"".join([
        HEAD.pack(MAGIC, VERSION, width, 0, BLOCK, len(ids), len(blocks), 0, first, len(flat)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        starts.tobytes(),
        offsets.tobytes(),
        *blocks,
    ])


class Chunk:
    """A chunk file opened for reading: whole documents or any range of ids, by unpacking the blocks that hold them."""

    def __init__(self, data: bytes):
        magic, version, self.width, _, self.block, n_docs, n_blocks, _, self.first, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a chunk of packed ids")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        raw, null = take(n_docs, "<i8"), take(n_docs, np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(raw, null, strict=True)]
        self.starts, self.offsets = take(n_docs + 1, "<u8"), take(n_blocks + 1, "<u8")
        self.payload = memoryview(data)[at:]
        if len(self.payload) != int(self.offsets[-1]):
            raise ValueError("a chunk of packed ids is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        b, e = start // self.block, -(-stop // self.block)
        parts = [unpack(self.payload[int(self.offsets[i]) : int(self.offsets[i + 1])], min(self.block, self.n_ids - i * self.block), self.width) for i in range(b, e)]
        return np.concatenate(parts)[start - b * self.block : stop - b * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def docs(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the chunk and ids of each document; every block is unpacked once."""
        held, have = np.empty(0, np.uint32), 0  # held begins at the id numbered have
        for k, d in enumerate(self.doc_ids):
            start, stop = int(self.starts[k]), int(self.starts[k + 1])
            if stop > have + len(held):
                begin, end = have + len(held), min(self.n_ids, -(-stop // self.block) * self.block)
                held, have = np.concatenate([held[start - have :], self.ids(begin, end)]), start
            yield d, start, held[start - have : stop - have]


WRITTEN = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("content", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes docs (doc_id, text) and writes their packed ids to path in ascending doc_id order.

    Texts are dealt by doc_id range (then by a hash of the text, so that rows of one doc_id can be split), each range is
    a shard, and its task encodes, packs and writes: one shuffle of the texts and none of the ids. Null texts count as
    empty, null doc_ids come first, repeated rows are written as often as they come, other columns are ignored, an empty
    table gives an empty dataset.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer, MORE_WORDS), TaskContext.get().partitionId()
        width, end = width_for(max(enc.vocabulary, end_id + 1)), np.array([end_id], np.uint32)
        held, doc_ids, n, chunk, first = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            return common.to_batch([(shard, chunk, n, write_chunk(doc_ids, held, width, first))], WRITTEN)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(enc.encode(text), "<u4"), end])
                held.append(ids)
                doc_ids.append(d)
                n += len(ids)
                if n >= CHUNK_IDS:
                    yield close()
                    held, doc_ids, n, chunk, first = [], [], 0, chunk + 1, first + n
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
        .mapInArrow(packed, "shard int, chunk int, n_ids long, content binary")
        .write.parquet(path)
    )


def read(spark, path: str) -> DataFrame:
    """Each document of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (  # a row a shard: the number of write tasks bounds it
        files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    chunk = Chunk(content.as_py())
                    for d, start, ids in chunk.docs():
                        yield d, base + chunk.first + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())

        yield from common.rows_out(rows(), READ)

    return files.select("shard", "content").join(F.broadcast(bases), "shard").select("base", "content").mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_bit_packed_ids(spark, sf_dir: str) -> DataFrame:
    """All of documents through byte_bpe_50k with end id 0: packed, written and read back."""
    path = common.new_path(spark, "packed-ids")
    write(common.table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read(spark, path)
