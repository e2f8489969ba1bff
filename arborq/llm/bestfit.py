"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction (operator 3).

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most `capacity` counts whatever the
number of documents. The driver solves that histogram: dominating sets are fixed and taken out (reduce_dominated), and
best-fit decreasing packs the rest a length at a time (best_fit). The answer is a short table of slots, a pattern with
its multiplicity at a time, and each piece finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborq.llm import common
from arborq.llm.tokenizing import encoder, tokenizer_path

#: Lengths with counts, and how many sequences have just these lengths.
Pattern = tuple[tuple[tuple[int, int], ...], int]
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def smallest(lengths: list[int], counts: dict[int, int], without: int, n: int) -> list[int]:
    """The n smallest items, leaving out one item of the length `without`."""
    found: list[int] = []
    for x in lengths:
        found += [x] * min(n, counts[x] - (x == without))
        if len(found) >= n:
            break
    return found[:n]


def pairs_within(lengths: list[int], counts: dict[int, int], without: int, room: int) -> tuple[int, int]:
    """Over all pairs of items that fit into room: the largest sum, and the largest smaller item; (0, 0) without a pair."""
    have = lambda x: counts[x] - (x == without)
    best = inner = 0
    hi = bisect.bisect_right(lengths, room) - 1
    for lo, x in enumerate(lengths):
        if 2 * x > room or have(x) < 1:
            if 2 * x > room:
                break
            continue
        while hi > lo and (lengths[hi] + x > room or have(lengths[hi]) < 1):
            hi -= 1
        if hi > lo and have(lengths[hi]) > 0:
            best, inner = max(best, x + lengths[hi]), x
        elif have(x) > 1:
            best, inner = max(best, 2 * x), x
    return best, inner


def dominating(j: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set of up to three items with j that dominates every other feasible set with j, or None where none is proven.

    A set F dominates if the items of any feasible set with j can be shared out over the items of F, each share no
    longer than its item: some optimal packing then has F as one of its sequences.
    """
    room = capacity - j
    low = smallest(lengths, counts, j, 3)
    if not low or low[0] > room:
        return (j,)
    at = bisect.bisect_right(lengths, room) - 1
    while counts[lengths[at]] - (lengths[at] == j) < 1:
        at -= 1
    i = lengths[at]  # the longest that fits
    if i == room or len(low) < 2 or low[0] + low[1] > room:
        return (j, i)
    if len(low) > 2 and sum(low) <= room:
        return None
    pair, inner = pairs_within(lengths, counts, j, room)  # at most two others fit
    if pair <= i:
        return (j, i)
    less = dict(counts)
    less[i] -= 1
    at = bisect.bisect_right(lengths, room - i) - 1
    while at >= 0 and less[lengths[at]] - (lengths[at] == j) < 1:
        at -= 1
    if at >= 0 and inner <= lengths[at]:
        return (j, i, lengths[at])
    return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes dominating sets, longest item first, until none is left to prove; the patterns fixed and what remains.

    Taking items away only shortens what others can be combined with, so a proven set stays proven while its items last
    and is fixed as many times at once as they do.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if counts and not (0 < min(counts) and max(counts) <= capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j, 0) > 0:
                lengths = sorted(counts)
                found = dominating(j, lengths, counts, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(counts[x] // n for x, n in need.items())
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for x, n in need.items():
                    counts[x] -= n * times
                    if not counts[x]:
                        del counts[x]
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each length goes to the fullest open sequences that take it.

    Sequences with the same content are one run, so the work and the result follow the number of lengths, not of items:
    a length splits at most one run in two and opens at most two.
    """
    open_by_room: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, run: tuple[tuple, int]) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append(run)

    for length in sorted(counts, reverse=True):
        n, at = counts[length], bisect.bisect_left(rooms, length)
        moved: list[tuple[int, tuple[tuple, int]]] = []
        while n and at < len(rooms):
            room = rooms.pop(at)
            each = room // length
            for content, times in open_by_room.pop(room):
                full = min(times, n // each)
                rest = min(n - full * each, each) if full < times else 0
                for k, m in ((each, full), (rest, 1 if rest else 0), (0, times - full - (1 if rest else 0))):
                    if m:
                        moved.append((room - k * length, (content + ((length, k),) if k else content, m)))
                n -= full * each + rest
        if n:
            each = capacity // length
            if n // each:
                moved.append((capacity - each * length, (((length, each),), n // each)))
            if n % each:
                moved.append((capacity - n % each * length, (((length, n % each),), 1)))
        for room, run in moved:
            put(room, run)
    return [run for room in sorted(open_by_room) for run in open_by_room[room]]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """A row for each length in each pattern, by length and rank: ranks from lo on fill `repeat` places a sequence."""
    rows, taken, sequence = [], Counter(), 0
    for content, times in patterns:
        offset = 0
        for length, repeat in content:
            rows.append((length, taken[length], sequence, repeat, offset))
            taken[length] += repeat * times
            offset += repeat * length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "sequence", "repeat", "offset"), columns, strict=True))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The ids of each document with end_id after them, cut into pieces of capacity ids; only the last may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def rows():
            for batch in batches:
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        yield d, k, at // 4, len(piece) // 4, zlib.crc32(piece)

        yield from common.rows_out(rows(), PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES_DDL)


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (as from pieces(), already written or checkpointed) with sequence_id and offset.

    The driver gets a count for each length, at most `capacity` of them, and sends back the slots, whose number has the
    same kind of bound: at most four new runs a length, and below 2 * sqrt(capacity) lengths in a sequence. Ranks among
    pieces of one length come from salted counts, so a length that a third of all rows share is dealt over many tasks.
    """
    spark = cut.sparkSession
    salts = max(16, common.shuffle_partitions(spark))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("__n")).collect()}
    table = slots(solve(counts, capacity))
    sent = spark.sparkContext.broadcast({k: v for k, v in table.items()})
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__salt").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(bases, ["length", "__salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        firsts = {int(x): int(i) for x, i in zip(*np.unique(t["length"], return_index=True), strict=True)}
        ends = {x: int(np.searchsorted(t["length"], x, side="right")) for x in firsts}
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                a, b = firsts[int(x)], ends[int(x)]
                at[own] = a + np.searchsorted(t["lo"][a:b], rank[own], side="right") - 1
            k = rank - t["lo"][at]
            repeat = t["repeat"][at]
            extra = [pa.array(t["sequence"][at] + k // repeat), pa.array(t["offset"][at] + k % repeat * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *extra], names=[*PIECES.names, "sequence_id", "offset"])

    rows = ranked.select(*PIECES.names, (F.col("__base") + F.col("__rank")).alias("rank"))
    return rows.mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most capacity ids; a row a piece.

    Null texts count as empty and make a piece of the end id alone, null doc_ids are kept, repeated rows are packed as
    often as they come, other columns are ignored, an empty table gives an empty result. Ties between pieces of one
    length are settled by doc_id, piece and checksum; equal rows may change places with each other only.
    """
    return pack_pieces(common.cut(pieces(docs, tokenizer, end_id, capacity)), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All of documents through word_bpe_49k with end id 1, into sequences of at most 4096 ids."""
    return best_fit_pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)
