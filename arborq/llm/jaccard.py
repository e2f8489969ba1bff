"""N-gram Jaccard join (operator 9): every link of similarity 0.8 or more between documents' sets of 5-word shingles.

1. first_pass(): texts with the same words in the same order are one class, whatever their number; one text of each goes
   on. The same pass counts all shingles in a table of fixed size, by which the rarest go first, and makes a sketch of
   each set: a bit for each place that one of its shingles falls on.
2. prefixes(): of each set in rare-first order, the front part that any linked set must touch.
3. stars(): sets that share a prefix shingle meet. The one with the least of its own is compared with each other one: as
   many pairs as rows, not all pairs of the group. Pairs pass the length and positional filters.
4. verify(): each distinct pair once: the suffix filter (how many places the two sketches differ in bounds the overlap),
   then the two sets.
5. closed(): where a shingle's sets still lie in different components, each set outside the largest one is held against
   the others by the same filters and the triangle inequality through the star's middle, whose distances are known; the
   likeliest few of what is left are verified, components are found again, and so on with the next ones until none is
   left open. Blocks of a large group go to different tasks; pairs of sets exist as rows only once they pass the filters.

Every pair that shares a prefix shingle is thus verified, ruled out by a bound, or already in one component, so the
components are exact. Shingles are compared by 64-bit hashes: an error needs a collision between two compared sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common
from arborq.llm.components import settled

N = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
UP, DOWN = 80, 100
#: The table of shingle counts: a bound for memory, whatever the corpus; how it is cut to be summed, and steps
#: for a power of two in what is sent.
COUNTERS, SLICES, STEPS = 1 << 22, 64, 7
#: Bits of the filter over wanted doc_ids, another fixed bound. When it fills up, more texts are read, none is lost.
FILTER_BITS = 1 << 25
#: Bits of a sketch: a power of two of about SPARSE times the size of the set, within these bounds.
SPARSE, LEAST_BITS, MOST_BITS = 6, 512, 8192
#: Sets of a block of an open group, and how many of a set's likeliest pairs a round verifies; each round takes GROWTH
#: times as many as the one before.
CHUNK, LIKELIEST, GROWTH = 4096, 8, 8
#: Bytes of text that are hashed at once; longer words are hashed one by one.
AT_ONCE, LONG_WORD = 1 << 18, 64
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
STEP = np.uint64(0x9E3779B97F4A7C15)


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: A hash of a word is the sum of a random number for each byte times a power for its place, then mixed.
BYTE = np.where(SPACE, 0, np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1))
POWER = np.cumprod(np.full(LONG_WORD, STEP), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX[:2]:
        x = (x ^ x >> MIX[2]) * m
    return x ^ x >> MIX[2]


def hash_words(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of lower-cased texts that lie one behind the other, edges[k] to edges[k + 1]; and the number
    of words before each edge."""
    a = np.frombuffer(data, np.uint8)
    first = ~SPACE[a]
    begins = edges[:-1][edges[:-1] < len(a)]
    begins = begins[first[begins]]
    first[1:] &= SPACE[a[:-1]]
    first[begins] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    a = a[starts[0] :]
    at = starts - starts[0]
    place = np.arange(len(a)) - np.repeat(at, np.diff(at, append=len(a)))
    lengths = np.add.reduceat(~SPACE[a], at, dtype=np.int64)
    out = np.add.reduceat(BYTE[a] * POWER[np.minimum(place, LONG_WORD - 1)], at)
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return mixed(out + lengths.astype(np.uint64) * MIX[0]), np.searchsorted(starts, edges)


def long_text(data: bytes) -> np.ndarray:
    """hash_words() of one text, a part between spaces at a time; a part without a space is one word."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + AT_ONCE)
        while end < len(data) and not SPACE[data[end]]:
            found = [k for c in b" \t\n\v\f\r" if (k := data.find(c, end, end + AT_ONCE)) >= 0]
            end = min(found, default=min(len(data), end + AT_ONCE))
        if end - at <= 2 * AT_ONCE:
            out.append(hash_words(data[at:end], np.array([0, end - at]))[0])
        else:
            words = data[at:end].split()
            out += [hash_words(w, np.array([0, len(w)]))[0] if len(w) <= LONG_WORD else mixed(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) + np.array([len(w)], np.uint64) * MIX[0]) for w in words]
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row."""
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * STEP + h[k : len(h) - n + 1 + k]
        out ^= out >> MIX[2]
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def hashed_texts(column: pa.Array) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text (null: none), what tells apart sequences of words, null without words, and its distinct shingles'
    hashes, ascending. Fewer than N words make one shingle."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + AT_ONCE, side="right")) - 1)
        part, edges = bytes(data[offsets[low] : offsets[high]]).lower(), offsets[low : high + 1] - offsets[low]
        if len(part) > AT_ONCE:
            h = long_text(part)
            counts = np.array([0, len(h)])
        else:
            h, counts = hash_words(part, edges)
        every = chained(h, N) if len(h) >= N else None
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            own = every[a : b - N + 1] if b - a >= N else chained(h[a:b], b - a) if a < b else h[:0]
            yield xxhash.xxh3_128_digest(h[a:b].tobytes()) if a < b else None, distinct(own)
        low = high


def shingles(text: str | None) -> np.ndarray:
    return next(hashed_texts(pa.array([text], pa.string())))[1]


def alike(overlap: int, a: int, b: int) -> bool:
    return DOWN * overlap >= UP * (a + b - overlap)


def least_overlap(a, b):
    """The smallest overlap at which sets of these sizes link."""
    return -(-UP * (a + b) // (UP + DOWN))


def prefix_length(n: int) -> int:
    return n - -(-UP * n // DOWN) + 1


def sketch(s: np.ndarray) -> bytes:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SPARSE * len(s)):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(40)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches (64-bit words) as they would be with fewer bits: a place is the hash modulo a power of two."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] | sketches[..., half:]
    return sketches


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the sketches differ, row by row: at most as many as shingles that only one of two sets has."""
    words = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=-1, dtype=np.int64)


def by_width(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of equally wide sketches, and these as a matrix."""
    widths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    found = [np.flatnonzero(widths == w) for w in np.unique(widths)]
    return [(at, np.frombuffer(b"".join([sketches[k] for k in at]), "<u8").reshape(len(at), -1)) for at in found]


SEEN = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("slice", pa.int32()), ("payload", pa.binary())])
SEEN_DDL = "doc_id long, sig binary, n_shingles long, sketch binary, slice int, payload binary"


def first_pass(docs: DataFrame) -> DataFrame:
    """A row a document (slice -1): its class, the size and the sketch of its set; and a task's shingle counts, a row a
    slice."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        counts = np.zeros(COUNTERS, np.uint32)

        def rows():
            for batch in batches:
                for d, (sig, s) in zip(batch.column(0).to_pylist(), hashed_texts(batch.column(1)), strict=True):
                    if sig is not None:
                        np.add.at(counts, s & np.uint64(COUNTERS - 1), np.uint32(1))
                    yield d, sig, len(s), sketch(s) if sig is not None else None, -1, None
            for k, part in enumerate(counts.reshape(SLICES, -1)):
                if part.any():
                    yield None, None, None, None, k, zlib.compress(part.astype("<u1" if part.max() < 256 else "<u4").tobytes(), 1)

        yield from common.rows_out(rows(), SEEN)

    return docs.mapInArrow(seen, SEEN_DDL)


def table_of(seen: DataFrame) -> np.ndarray:
    """The tasks' counts summed, slice by slice; the driver gets their logarithms alone, COUNTERS bytes."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(COUNTERS // SLICES, np.uint64))
                raw = zlib.decompress(payload)
                sums[k] += np.frombuffer(raw, "<u1" if len(raw) == COUNTERS // SLICES else "<u4")
        rows = ((k, np.ceil(np.minimum(255, STEPS * np.log2(v + 1.0))).astype(np.uint8).tobytes()) for k, v in sums.items())
        yield from common.rows_out(rows, pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))

    table = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    slices = seen.where("slice >= 0").select("slice", "payload").repartition("slice")
    for k, sums in slices.mapInArrow(added, "slice int, sums binary").collect():
        table[k] = np.frombuffer(sums, np.uint8)
    return table.reshape(-1)


PREFIX_DDL = "token long, doc long, size int, pos int"


def prefixes(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """texts (doc_id, text, sig) to the prefixes of their sets. A row whose text is not of its class is another of the
    same doc_id, and passed over."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        counts, held, n = sent.value, [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _, _ in held]).view(np.int64)
            lengths = [len(t) for t, _, _ in held]
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            columns = [tokens, np.repeat(np.array([d for _, d, _ in held], np.int64), lengths), np.repeat(np.array([z for _, _, z in held], np.int32), lengths), pos]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "doc", "size", "pos"])

        for batch in batches:
            for d, sig, (own, s) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), hashed_texts(batch.column(1)), strict=True):
                if own != sig:
                    continue
                order = np.argsort(counts[s & np.uint64(COUNTERS - 1)], kind="stable")  # then by hash, as s ascends
                front = s[order[: prefix_length(len(s))]]
                held.append((front, d, len(s)))
                n += len(front)
                if n >= 50_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return texts.select("doc_id", "text", "sig").mapInArrow(cut, PREFIX_DDL)


def can_link(size_a, pos_a, size_b, pos_b):
    """The length and the positional filter, for two sets at a shingle of both. At the first that they share, all further
    ones lie behind it in both; a pair that fails there fails at every later one too."""
    small, big = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (DOWN * small >= UP * big) & (1 + np.minimum(size_a - pos_a, size_b - pos_b) - 1 >= least_overlap(size_a, size_b))


STARS_DDL = "token long, pivot long, pivot_size int, doc long, size int, pos int, near boolean"


def in_group(rows: DataFrame) -> DataFrame:
    """Rows by shingle, and in each group by how far in front the shingle stands: a set with little of its own comes first.
    Sets in which it stands so far back that only shorter ones can link come last."""
    behind = f"size - pos < ceil({UP} * 2 * size / {UP + DOWN}.0)"
    return rows.repartition("token").sortWithinPartitions("token", F.expr(behind), "pos", "size", "doc")


def stars(rows: DataFrame) -> DataFrame:
    """Prefix rows to a row for each set of a group but the pivot; near: the pair with the pivot passes the filters.

    Of two linked sets the shorter one has the shingle far enough in front to link with a set of its own length. The pivot
    is the first such set, the one with the least of its own: of edited copies, the original or the closest to it. A
    group without such a set has no links. Sorted rows stream by: a group takes no memory.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        last = None  # token, doc, size and pos of the first row of the group that the previous batch ended in
        for batch in batches:
            token, doc, size, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if last is not None:
                token, doc, size, pos = (np.concatenate([np.array([x], a.dtype), a]) for x, a in zip(last, (token, doc, size, pos), strict=True))
            starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            pivot = np.repeat(starts, np.diff([*starts.tolist(), len(token)]))
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            own = np.flatnonzero((size - pos >= least_overlap(size, size))[pivot] & (doc != doc[pivot]))
            if len(own):
                p = pivot[own]
                near = can_link(size[p], pos[p], size[own], pos[own])
                columns = [token[own], doc[p], size[p].astype(np.int32), doc[own], size[own].astype(np.int32), pos[own].astype(np.int32), near]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "pivot", "pivot_size", "doc", "size", "pos", "near"])
            k = int(starts[-1])
            last = token[k], doc[k], size[k], pos[k]

    return in_group(rows).mapInArrow(paired, STARS_DDL)


def wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has every id's last bits; built by partial aggregation, FILTER_BITS / 64 rows at most."""
    bit = F.col("id").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = ids.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out, got = np.zeros(FILTER_BITS // 64, np.int64), words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


SETS = pa.schema([("doc", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])


def sets_of(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The set of every document whose doc_id the bitmap has, once however often its row is repeated."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        bits = sent.value

        def rows():
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                low = ids & (FILTER_BITS - 1)
                want = np.flatnonzero(bits[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1))
                for d, (sig, s) in zip(ids[want].tolist(), hashed_texts(batch.column(1).take(pa.array(want))), strict=True):
                    if sig is not None:
                        yield d, sig, s.astype("<u8").tobytes()

        yield from common.rows_out(rows(), SETS, 512)

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(made, "doc long, sig binary, shingles binary")
    return found.dropDuplicates(["doc", "sig"]).select("doc", "shingles")


def verify(docs: DataFrame, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) to those that the suffix filter lets through, with sizes and overlap, as a table of its own.
    sketches: (doc, size, sketch)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (3, 5))
            least = least_overlap(*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4)))
            room = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(4).to_numpy(zero_copy_only=False) - 2 * least
            good = np.zeros(len(x), bool)
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, (p, q) in enumerate(zip(x, y, strict=True)):
                shapes.setdefault((len(p), len(q)), []).append(k)
            for at in shapes.values():
                p, q = (np.frombuffer(b"".join([z[k] for k in at]), "<u8").reshape(len(at), -1) for z in (x, y))
                good[at] = differing(p, q) <= room[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(good))

    side = lambda n: sketches.select(F.col("doc").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    left = common.cut(both.mapInArrow(bounded, "a long, b long").distinct())
    sets = common.written(sets_of(docs, wanted(left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))))), "sets")
    whole = lambda n: sets.select(F.col("doc").alias(n), F.col("shingles").alias(f"set_{n}"))
    joined = left.join(whole("b"), "b").join(whole("a"), "a")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("overlap", pa.int64())])

        def rows():
            for batch in batches:
                for a, b, x, y in zip(*batch.columns, strict=True):
                    x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                    both = np.concatenate([x, y])
                    both.sort()
                    yield a.as_py(), b.as_py(), len(x), len(y), int((both[1:] == both[:-1]).sum())

        yield from common.rows_out(rows(), out)

    return common.cut(joined.select("a", "b", "set_a", "set_b").mapInArrow(compared, "a long, b long, size_a long, size_b long, overlap long"))


def links(verified: DataFrame) -> DataFrame:
    return verified.where(f"{DOWN} * overlap >= {UP} * (size_a + size_b - overlap)").select("a", "b")


def open_rows(groups: DataFrame, parts: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of groups whose sets lie in several components: each with whether its component is another
    than the group's largest one, its distance from the pivot (null: unknown), and the number of blocks of the group
    (`own_blocks` of sets outside, `all_blocks` of all sets)."""
    far = known.select("a", "b", (1 - F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("far")).groupBy("a", "b").agg(F.max("far").alias("far"), F.min("far").alias("__near"))
    far = far.where("far = __near").drop("__near")
    placed = groups.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("first", F.coalesce("component", "doc")).drop("component")
    kinds = placed.groupBy("token", "first").agg(F.count("*").alias("n"))
    split = (
        kinds.groupBy("token")
        .agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("first", F.struct("n", "first")).alias("anchor"))
        .where("kinds > 1")
        .select("token", "anchor", F.ceil((F.col("n") - F.col("most")) / CHUNK).alias("own_blocks"), F.ceil(F.col("n") / CHUNK).alias("all_blocks"))
    )
    rows = placed.join(split, "token").withColumns({"a": F.least("pivot", "doc"), "b": F.greatest("pivot", "doc")}).join(far, ["a", "b"], "left")
    return rows.withColumn("outside", F.col("first") != F.col("anchor")).select("token", "doc", "size", "pos", "outside", "far", "own_blocks", "all_blocks")


LEFT_DDL = "token long, a long, b long"
LEFT = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def likeliest(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Open rows, each with its component now (`comp`), to pairs (token, a, b): of each set outside, those of the sets that
    it may link with which come low-th to high-th by their sketches' differences, as far as they are in other components.
    A row with a null pair says that the token has further ones.

    The order is the same in every round, and of two sets outside the one with the greater doc holds the pair, so that
    every pair has its turn. Sets outside and all sets go to blocks of about CHUNK; each two blocks meet in one task.
    """
    whole = F.col("all_blocks") == 1  # the group is one block: its sets outside are among all sets there
    own = rows.where(F.col("outside") & ~whole).withColumns({"__i": F.expr("pmod(xxhash64(doc), own_blocks)"), "__j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)), "__own": F.lit(True), "__other": F.lit(False)})
    every = rows.withColumns({"__j": F.expr("pmod(xxhash64(doc), all_blocks)"), "__i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_blocks") - 1)), "__own": whole & F.col("outside"), "__other": F.lit(True)})
    names = ["token", "__i", "__j", "__own", "__other", "doc", "size", "pos", "outside", "comp", "far", "sketch"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        held: list[tuple] = []
        current = None

        def close() -> Iterator[pa.RecordBatch]:
            token = current[0]
            mine, other, doc, size, pos, outside, comp, far = (np.concatenate([h[k] for h in held]) for k in range(8))
            bits = [x for h in held for x in h[8]]
            at = np.flatnonzero(other)
            doc_, size_, pos_, outside_, comp_, far_ = (c[at] for c in (doc, size, pos, outside, comp, far))
            wide = by_width([bits[k] for k in at])
            out, more = [], False
            for k in np.flatnonzero(mine):
                may = (doc_ != doc[k]) & (~outside_ | (doc_ < doc[k])) & can_link(size[k], pos[k], size_, pos_)
                may &= ~(np.abs(far_ - far[k]) > 1 - UP / DOWN + 1e-9)  # unknown distances rule nothing out
                if not (may & (comp_ != comp[k])).any():
                    continue
                apart = np.full(len(at), -1, np.int64)
                this = np.frombuffer(bits[k], "<u8")
                for places, matrix in wide:
                    chosen = may[places]
                    if chosen.any():
                        apart[places[chosen]] = differing(matrix[chosen], this)
                may &= apart <= size_ + size[k] - 2 * least_overlap(size_, size[k])
                good = np.flatnonzero(may)
                if len(good) <= low:
                    continue
                good = good[np.lexsort((doc_[good], apart[good]))]
                turn = good[low:high]
                turn = turn[comp_[turn] != comp[k]]
                out.append((np.full(len(turn), token, np.int64), np.minimum(doc_[turn], doc[k]), np.maximum(doc_[turn], doc[k])))
                more = more or bool((comp_[good[high:]] != comp[k]).any())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=LEFT)
            if more:
                yield common.to_batch([(token, None, None)], LEFT)

        for batch in batches:
            token, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 10)]
            columns = [c.astype(bool if n in (0, 1, 5) else np.int64) for n, c in enumerate(columns)]
            columns.append(batch.column(10).to_numpy(zero_copy_only=False).astype(np.float64))
            sketches = batch.column(11).to_pylist()
            edges = [0, *(np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(token)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key = (token[a], i[a], j[a])
                if held and key != current:
                    yield from close()
                    held = []
                current = key
                held.append((*(c[a:b] for c in columns), sketches[a:b]))
        if held:
            yield from close()

    blocks = own.select(*names).union(every.select(*names))
    return blocks.repartition("token", "__i", "__j").sortWithinPartitions("token", "__i", "__j").mapInArrow(pairs, LEFT_DDL)


def closed(docs: DataFrame, groups: DataFrame, known: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, component) by all links, from the pairs that the stars had verified."""
    linked = links(known)
    parts = settled(linked)
    rows = common.cut(open_rows(groups, parts, known))
    done, low, high = known.select("a", "b"), 0, LIKELIEST
    sizes = sketches.select("doc", F.col("size").cast("int").alias("size"), "sketch")
    while not rows.isEmpty():
        now = rows.join(parts.withColumnRenamed("node", "doc"), "doc", "left").join(sizes, ["doc", "size"])
        found = common.cut(likeliest(now.withColumn("comp", F.coalesce("component", "doc")), low, high))
        pairs = found.where("a IS NOT NULL").select("a", "b")
        if not pairs.isEmpty():
            more = verify(docs, pairs.distinct().join(done, ["a", "b"], "left_anti"), sketches)
            linked, done = linked.union(links(more)), done.union(pairs)
            parts = settled(linked)
        rows = rows.join(found.where("a IS NULL").select("token").distinct(), "token", "left_semi")
        low, high = high, high * GROWTH
    return parts


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Each document of docs (doc_id, text): the size of its set and the smallest doc_id that links reach, itself included.

    Null texts and texts without words have empty sets and link with nothing; a null doc_id is no name for a component, but
    such a row shares that of its copies. Repeated rows stay repeated. Where one doc_id comes with different texts, links
    of any of them count for it. Other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = common.cut(first_pass(rows))
    table = table_of(seen)
    found = seen.where("slice = -1").select("doc_id", "sig", "n_shingles")
    classes = common.cut(found.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("__rows")))
    one = classes.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), "sig")
    texts = rows.join(one.hint("shuffle_hash"), "doc_id")
    groups = common.cut(stars(prefixes(texts, table)))
    sketches = seen.where("slice = -1").join(one.hint("shuffle_hash"), ["doc_id", "sig"], "left_semi").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "sketch")
    sketches = common.cut(sketches)
    pairs = groups.where("near").select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
    parts = closed(rows, groups, verify(rows, pairs, sketches), sketches)

    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    with_sig = common.join_hot(found.where("sig IS NOT NULL"), named, "sig", classes.select("sig", "__rows"), spread_by=F.xxhash64("doc_id"))
    empty = found.where("sig IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_sig.select("doc_id", "n_shingles", "component_id").union(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns as they were, with one row of each component: the one whose doc_id names it. Rows without words
    and rows with a null doc_id stay, each of them; of repeated rows that name one component one stays, of rows with one
    doc_id and different texts each text. Null texts stay null, an empty table gives an empty result."""
    parts = jaccard_components(docs)
    names = parts.where("n_shingles > 0 AND doc_id = component_id").select("doc_id").distinct()
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn("__bare", wordless)
    kept = rows.where(~F.col("__bare")).join(names.hint("shuffle_hash"), "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.union(rows.where("__bare OR doc_id IS NULL")).select(docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))
