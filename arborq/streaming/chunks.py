"""Chunked JSON documents as a stream.

Input rows are (document_key, request_seq, chunk_no, bytes, is_close). Each document's state is its parser (open
containers and an unfinished token), the chunks that came too early, and counters; output rows are patches: a node
inserted, a node sealed, a document ended or failed. A newer request_seq replaces an older one, whose late chunks are
dropped: that is the only rule about lateness.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.sources.push import Parser, PushError, path_text

OUT = "document_key string, request_seq long, patch_seq long, op string, node_id int, path_text string, kind string, tag string, value string, message string"
STATE = "blob binary"
#: Bytes of a chunk of documents that are smaller than the first number.
SIZES = ((4 << 20, 128 << 10), (10 << 20, 256 << 10))
LARGEST = 1 << 20


def chunk_size(total: int) -> int:
    return next((size for most, size in SIZES if total < most), LARGEST)


class Document:
    """One document's state between triggers."""

    def __init__(self):
        self.request, self.next, self.patch = -1, 0, 0
        self.parser, self.early, self.paths, self.ended = Parser(), {}, {-1: ()}, False

    def begin(self, request: int) -> None:
        self.request, self.next = request, 0
        self.parser, self.early, self.paths, self.ended = Parser(), {}, {-1: ()}, False

    def take(self, request: int, number: int, data: bytes, close: bool) -> list[tuple]:
        if request < self.request:
            return []
        if request > self.request:
            self.begin(request)
        if number < self.next or self.ended:
            return []
        self.early[number] = (data, close)
        out = []
        while self.next in self.early and not self.ended:
            data, close = self.early.pop(self.next)
            self.next += 1
            out += self.feed(data, close)
        return out

    def feed(self, data: bytes, close: bool) -> list[tuple]:
        rows = []
        try:
            events = self.parser.feed(data, close)
        except (PushError, UnicodeDecodeError, ValueError) as x:
            self.ended = True
            return [self.row("failed", message=str(x))]
        for what, n in events:
            if what == "start":
                self.paths[n.number] = (*self.paths[n.parent], n.key if n.key is not None else n.index) if n.parent >= 0 else ()
                rows.append(self.row("inserted", n, path_text(self.paths[n.number])))
            else:
                path = self.paths.pop(n.number)  # only open containers stay
                if n.kind != "scalar":
                    rows.append(self.row("sealed", n, path_text(path)))
        if close:
            self.ended = True
            rows.append(self.row("ended"))
        return rows

    def row(self, op: str, n=None, path: str | None = None, message: str | None = None) -> tuple:
        self.patch += 1
        return (self.request, self.patch, op, n.number if n else None, path, n.kind if n else None, n.tag if n else None, n.value if n else None, message)


def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    doc = pickle.loads(bytes(state.get[0])) if state.exists else Document()
    rows = []
    chunks = pd.concat(list(frames)).sort_values(["request_seq", "chunk_no"])
    for r in chunks.itertuples():
        rows += doc.take(int(r.request_seq), int(r.chunk_no), bytes(r.bytes or b""), bool(r.is_close))
    state.update((pickle.dumps(doc),))
    out = pd.DataFrame([(key[0], *r) for r in rows], columns=NAMES)
    yield out.astype({"node_id": "Int32", "request_seq": "int64", "patch_seq": "int64"})


def patches(chunks: DataFrame) -> DataFrame:
    """A stream of chunks to a stream of patches, in append mode. The state is keyed by document_key."""
    return chunks.groupBy("document_key").applyInPandasWithState(advance, OUT, STATE, "append", "NoTimeout")


NAMES = [x.split()[0] for x in OUT.split(", ")]
SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]]) for n, x in zip(NAMES, OUT.split(", "), strict=True)])


def batch_patches(chunks: DataFrame) -> DataFrame:
    """patches() of chunks that are all there: sorted within partitions, a document's state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc = None, Document()
        for batch in batches:
            rows = []
            for k, request, number, data, close in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, doc = k, Document()
                rows += [(k, *r) for r in doc.take(request, number, data or b"", bool(close))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    ordered = chunks.select("document_key", "request_seq", "chunk_no", "bytes", "is_close").repartition("document_key").sortWithinPartitions("document_key", "request_seq", "chunk_no")
    return ordered.mapInArrow(run, OUT)


def latest_snapshots(rows: DataFrame) -> DataFrame:
    """Patches to each document's latest authoritative snapshot: the newest request that ended; its node rows."""
    ended = rows.where("op = 'ended'").groupBy(F.col("document_key").alias("__key")).agg(F.max("request_seq").alias("__seq"))
    return rows.where("op = 'inserted'").join(ended, (F.col("document_key") == F.col("__key")) & (F.col("request_seq") == F.col("__seq"))).select("document_key", F.col("request_seq").alias("snapshot"), "node_id", "path_text", "kind", "tag", "value")


def split_chunks(df: DataFrame, key: Column, text: Column, size: int | None = None, request_seq: int = 0) -> DataFrame:
    """Documents as rows of chunks, cut by bytes wherever that falls; the size follows the document's if none is given."""
    data = text.cast("binary")
    n = F.octet_length(text)
    step = F.lit(size) if size else F.when(n < SIZES[0][0], SIZES[0][1]).when(n < SIZES[1][0], SIZES[1][1]).otherwise(LARGEST)
    last = F.floor((F.greatest(n, F.lit(1)) - 1) / step).cast("int")
    rows = df.select(key.cast("string").alias("document_key"), data.alias("__data"), step.alias("__step"), last.alias("__last")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    return rows.select("document_key", F.lit(request_seq).cast("long").alias("request_seq"), "chunk_no", F.substring("__data", F.col("chunk_no") * F.col("__step") + 1, F.col("__step")).alias("bytes"), (F.col("chunk_no") == F.col("__last")).alias("is_close"))
