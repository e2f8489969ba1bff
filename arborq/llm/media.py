"""Media columns: bytes as PNG images in a binary column, read back and hashed by low-frequency cosines (operator 8).

encode_png() writes 8-bit greyscale; decode_png() reads every 8-bit non-interlaced greyscale, RGB or RGBA image, tests
each chunk's checksum, and undoes row filters with numpy: a run of rows with one of the filters None, Sub or Up at once,
Average and Paeth a row at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH, SIDE, LOW = 64, 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """pixels: rows of unsigned bytes. Each row takes the filter of None, Sub and Up that leaves the least sum of
    differences, an estimate of what compresses best."""
    height, width = pixels.shape
    left = pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    forms = np.stack([pixels, left, up])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = forms[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a PNG is cut short")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        yield kind, body
        at += 12 + n
    if kind != b"IEND":
        raise ValueError("a PNG is cut short")


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """raw: rows with their filter's number in front; step: bytes a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown row filter")
    height, width = rows.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), height], strict=True):
        part, kind = rows[a:b], kinds[a] if a < height else NONE
        if kind == SUB:
            pixels = part.reshape(b - a, -1, step)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == UP:
            if a:
                part[0] += rows[a - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                above = rows[y - 1].astype(int).tolist() if y else [0] * width
                rows[y] = unfilter_row(rows[y].tolist(), above, step, kind)
    return rows


def unfilter_row(row: list[int], above: list[int], step: int, kind: int) -> list[int]:
    for x in range(len(row)):
        left, up = row[x - step] if x >= step else 0, above[x]
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            corner = above[x - step] if x >= step else 0
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        row[x] = row[x] + guess & 255
    return row


def decode_png(data: bytes) -> np.ndarray:
    """Pixels as (height, width) for greyscale, else (height, width, channels)."""
    parts = list(chunks(data))
    if not parts or parts[0][0] != b"IHDR":
        raise ValueError("a PNG begins with IHDR")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit greyscale, RGB and RGBA without interlacing")
    step = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT")), np.uint8)
    rows = unfilter(raw.reshape(height, width * step + 1), step)
    return rows if step == 1 else rows.reshape(height, width, step)


def cosines() -> np.ndarray:
    """The LOW lowest cosines over SIDE samples, in whole numbers so that every machine agrees."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.rint(np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE)) * 4096).astype(np.int64)


COSINES = cosines()


def shrink(pixels: np.ndarray) -> np.ndarray:
    """Mean brightness, times 256, over SIDE x SIDE cells that share the image out; small images repeat pixels."""

    def along(a: np.ndarray) -> np.ndarray:
        n = len(a)
        lo = np.arange(SIDE) * n // SIDE
        hi = np.maximum(lo + 1, np.arange(1, SIDE + 1) * n // SIDE)
        sums = np.concatenate([np.zeros((1, *a.shape[1:]), np.int64), np.cumsum(a, axis=0, dtype=np.int64)])
        return (sums[hi] - sums[lo]) * 256 // (hi - lo)[:, None]

    return along(along(pixels.astype(np.int64)).T).T // 256


def dct_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: which of the LOW x LOW lowest frequencies lie above their median."""
    grey = pixels if pixels.ndim == 2 else pixels[:, :, :3].mean(axis=2).astype(np.int64)
    low = COSINES @ shrink(grey) @ COSINES.T
    return np.packbits(low.reshape(-1) > np.sort(low, axis=None)[LOW * LOW // 2 - 1]).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with each text's bytes, filled with zeros to a positive multiple of 64, as a PNG of 64 columns.

    Null texts count as empty and give one row of zeros. Repeated rows stay repeated, null doc_ids are kept, other
    columns are ignored, an empty table gives an empty result. No shuffle.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n, payload = payload_of(text)
                    yield d, n, encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))

        yield from common.rows_out(rows(), STORED, 512)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload digests, the size and digest of the image itself, and its cosine hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for d, n, image in zip(*(batch.column(k) for k in range(3)), strict=True):
                    png = image.as_py()
                    pixels = decode_png(png)
                    payload = pixels.tobytes()
                    yield d.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), dct_hash(pixels)

        yield from common.rows_out(rows(), READ)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_png_media(spark, sf_dir: str) -> DataFrame:
    """All of documents: stored in a binary column of a table in the shared folder, read back from there."""
    path = common.new_path(spark, "media")
    store(common.table(spark, sf_dir, "documents")).write.parquet(path)
    return features(spark.read.parquet(path))
