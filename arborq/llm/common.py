"""What the operators of this package share: lineage cuts, skew-safe joins, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most keys that a hot-key broadcast can hold: each of them has at least 1/HOT_KEYS of the rows.
HOT_KEYS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs in one process (tests), a
    temporary one; on a cluster that is an error, as such a folder goes with its machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborq-checkpoints-"))
    return sc.getCheckpointDir()


#: Rows of a file of a small table.
FILE_ROWS = 50_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint: a lost executor costs no recomputation, and two uses read the same
    rows. rows: about how many there are, where that is known and what they are made from is no more; a small table then
    goes to a few files instead of one for each shuffle partition."""
    spark = df.sparkSession
    shared_dir(spark)
    files = None if rows is None else max(1, -(-rows // FILE_ROWS))
    few = df if files is None or files >= shuffle_partitions(spark) else df.coalesce(files)
    return few.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lineage cut for rows with large values."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What this worker process keeps between tasks, by the operator that it is for.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Called as a task begins: what other operators have kept in this process goes, so that workers which serve one
    operator after the other hold the caches of one at a time. What the worker has freed goes back to the machine."""
    others = [x for x in _KEPT if x != owner]
    for other in others:
        _KEPT.pop(other)()
    if others:
        gc.collect()
    _KEPT[owner] = clear
    release()


def release() -> None:
    """Arrow's pool and the C library keep freed memory for later; an executor's limit counts it as used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def rows_out(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most at_once rows; memory stays with one batch."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_hot(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, how: str = "left", spread_by: Column | None = None) -> DataFrame:
    """left joined with right (one row for each key) where one key may hold a third of left.

    weights has (key, __rows): how many rows of left have the key. Keys with at least 1/HOT_KEYS of all rows, so at
    most HOT_KEYS of them, are dealt over several salts: their right row is repeated once a salt, and left rows pick a
    salt by spread_by. Every other key has the one salt 0. No row is dropped and no unbounded side is broadcast.
    """
    salts = max(8, shuffle_partitions(left.sparkSession))
    total = weights.agg(F.sum("__rows").alias("__total"))
    hot = (
        weights.crossJoin(F.broadcast(total))  # one row
        .where(F.col("__rows") * HOT_KEYS >= F.col("__total"))
        .select(F.col(key).alias("__hot"), F.least(F.lit(salts), F.ceil(F.col("__rows") * salts * 2 / F.col("__total")) + 1).cast("int").alias("__salts"))
    )
    salted_right = (
        right.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
        .drop("__hot", "__salts")
    )
    spread = spread_by if spread_by is not None else F.monotonically_increasing_id()
    salted_left = (
        left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.pmod(spread, F.coalesce("__salts", F.lit(1))).cast("int"))
        .drop("__hot", "__salts")
    )
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")
