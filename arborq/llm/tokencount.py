"""Token counts without token ids (operator 6).

A sentencepiece BPE model whose pieces hold the word mark only at their front never merges across the place before a run
of marks, nor across a character that is in no longer piece (the line feed). So a text's count is the sum over its
pre-tokens, and each distinct pre-token needs to be counted once:

1. tally(): a task reads its documents in blocks of bounded size. A block gives one row with, for each document, its
   pre-tokens' numbers within the block and their frequencies, and a row a bucket with the block's distinct pre-tokens.
2. count_pieces(): rows of one bucket meet, so a pre-token is counted once however many blocks have it; each row goes
   back with counts in place of words.
3. total(): a block's counts and frequencies meet and are summed by document.

A frequent pre-token comes once a block, not once a document, so no key is hot; a task holds one block or one bucket.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common
from arborq.llm.tokenizing import tokenizer_path

MARK = "▁"
#: Spaces with what they lead, text without spaces, or a line feed.
SPLIT = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall
#: A block is closed once it has so many bytes of text.
BLOCK_BYTES = 6 << 20
ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
ROWS_DDL = "block long, bucket int, payload binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


@functools.lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def splits_safely(path: str) -> bool:
    """Whether pre-tokens are independent in this model: marks only in front, no piece with a line feed, text unchanged."""
    sp = model(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    plain = all("\n" not in p and MARK not in p.lstrip(MARK) for p in pieces)
    probe = "ﬁ  x\n y "
    return plain and sp.decode(sp.encode(probe)) == probe and len(sp.encode("\n")) == 2


def pretokens(text: str | None) -> list[str]:
    """The text with the library's leading mark, split; a mark written in the text counts as a space, as in the library."""
    return SPLIT(" " + text.replace(MARK, " ")) if text else []


def count_each(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token, behind a line feed, which makes two pieces with its mark and merges with nothing."""
    return [len(ids) - 2 for ids in model(path).encode(["\n" + w for w in words], num_threads=1)]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit integers as one compressed string, their bytes by place."""
    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    return zlib.compress(head + b"".join(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    lengths, at, out = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
    for k in map(int, lengths):
        out.append(np.frombuffer(raw, np.uint8, 4 * k, at).reshape(4, k).T.copy().view("<u4").reshape(-1))
        at += 4 * k
    return out


def pack_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    return zlib.compress(np.array([len(coded), *map(len, coded)], "<u4").tobytes() + b"".join(coded), 1)


def unpack_words(data: bytes) -> list[str]:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64).tolist()
    text = memoryview(raw)[4 + 4 * n :]
    return [str(text[a:b], "utf-8") for a, b in zip([0, *ends], ends, strict=False)]


def two_words(values: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([v or 0 for v in values], np.int64).view(np.uint64)
    return (a & np.uint64(0xFFFFFFFF)).astype("<u4"), (a >> np.uint64(32)).astype("<u4")


def tally(docs: DataFrame, buckets: int) -> DataFrame:
    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        local: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            places: list[list[str]] = [[] for _ in range(buckets)]
            order = np.empty(len(local), np.uint32)  # local number to place in the counts, bucket after bucket
            where = np.fromiter((zlib.crc32(w.encode()) % buckets for w in local), np.uint32, len(local))
            order[np.argsort(where, kind="stable")] = np.arange(len(local), dtype=np.uint32)
            for w, b in zip(local, where.tolist(), strict=True):
                places[b].append(w)
            ids, sizes, kinds, words, times = zip(*held, strict=True)
            numbers = [order[w] for w in words]
            by = [np.argsort(x) for x in numbers]
            steps = [np.diff(x[k].astype(np.int64), prepend=0) for x, k in zip(numbers, by, strict=True)]
            payload = packed(*two_words(list(ids)), np.array([d is None for d in ids]), *two_words(list(sizes)), np.array(kinds), np.concatenate(steps), np.concatenate([t[k] for t, k in zip(times, by, strict=True)]), np.array([len(p) for p in places]))
            yield common.to_batch([(number, -1, payload)], ROWS)
            yield from common.rows_out(((number, b, pack_words(p)) for b, p in enumerate(places) if p), ROWS, 256)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                freq = Counter(pretokens(text))
                words = np.fromiter((local.setdefault(w, len(local)) for w in freq), np.uint32, len(freq))
                n = len(text.encode()) if text else 0
                held.append((d, n, len(freq), words, np.fromiter(freq.values(), np.uint32, len(freq))))
                size += n + 64
                if size >= BLOCK_BYTES:
                    yield from close()
                    local, held, size, number = {}, [], 0, number + 1
        if held:
            yield from close()

    return docs.mapInArrow(tallied, ROWS_DDL)


def count_pieces(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of words to rows of counts, by bucket: the dictionary of one bucket is held at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            known: dict[str, int] = {}
            current = None
            for batch in batches:
                for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != current:
                        known, current = {}, bucket
                    own = unpack_words(payload)
                    new = [w for w in own if w not in known]
                    known.update(zip(new, count_each(new, path), strict=True))
                    yield block, bucket, packed(np.fromiter((known[w] for w in own), np.uint32, len(own)))

        yield from common.rows_out(rows(), ROWS, 256)

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, ROWS_DDL)


def total(blocks: DataFrame, limit: int) -> DataFrame:
    """Rows of documents (bucket -1) and of counts, by block, to each document's sum."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            doc, counts = None, None
            for batch in batches:
                for _, bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket == -1:
                        if doc is not None:
                            yield from finish(doc, counts)
                        doc = unpacked(payload)
                        starts = np.concatenate([[0], np.cumsum(doc[-1], dtype=np.int64)])
                        counts = np.zeros(int(starts[-1]), np.int64)
                    else:
                        counts[starts[bucket] : starts[bucket + 1]] = unpacked(payload)[0]
            if doc is not None:
                yield from finish(doc, counts)

        def finish(doc, counts):
            low, high, null, size_low, size_high, kinds, steps, times, _ = doc
            ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
            sizes = size_low.astype(np.int64) | size_high.astype(np.int64) << 32
            edges = np.concatenate([[0], np.cumsum(kinds, dtype=np.int64)])
            run = np.cumsum(steps.view(np.int32), dtype=np.int64)
            base = np.concatenate([[0], run])[edges[:-1]]
            place = run - np.repeat(base, kinds)
            weights = np.concatenate([[0], np.cumsum(counts[place] * times)])
            sums = weights[edges[1:]] - weights[edges[:-1]]
            for d, z, n, s in zip(ids.tolist(), null.tolist(), sizes.tolist(), sums.tolist(), strict=True):
                yield None if z else d, n, s, s > limit

        yield from common.rows_out(rows(), OUT)

    return blocks.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Each document of docs (doc_id, text): UTF-8 bytes, tokens, and whether those exceed limit.

    Null and empty texts have 0 of both. Repeated rows stay repeated, null doc_ids are kept, other columns are ignored,
    an empty table gives an empty result. A model whose pre-tokens depend on each other is run over the whole texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not splits_safely(path):
        return whole_counts(rows, path, limit)
    buckets = max(32, common.shuffle_partitions(docs.sparkSession))
    tallied = common.cut(tally(rows, buckets))
    counts = count_pieces(tallied.where("bucket >= 0"), path, buckets)
    return total(tallied.where("bucket = -1").unionByName(counts), limit)


def whole_counts(rows: DataFrame, path: str, limit: int) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in batches:
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = len(model(path).encode(text)) if text else 0
                    yield d, len(text.encode()) if text else 0, n, n > limit

        yield from common.rows_out(out(), OUT)

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All of documents under piece_bpe_32k.model, limit 4096."""
    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
