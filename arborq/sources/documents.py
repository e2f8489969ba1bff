"""Tables of documents: reading files, decoding, evaluating, converting, and writing results.

A document is a row (doc_id, doc_index, value) with its value as canonical JSON text; each step is one Arrow pass without
a shuffle. A text that does not decode, or an expression that does not fit a document, gives a row with `error` set.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.lang import parse
from arborq.operators import tree
from arborq.operators.values import canonical
from arborq.sources import codecs

RESULT = "doc_id long, doc_index int, match_index int, value string, error string"
FIELDS = ["doc_id", "doc_index", "match_index", "value", "error"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: every file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def null_input(spark: SparkSession) -> DataFrame:
    """One document that is null."""
    return spark.range(1).select(F.col("id").alias("doc_id"), F.lit("null").alias("text"))


#: An input of less than so many bytes for each core is dealt anew before it goes to Python.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input lies in a split or two, which keep one core busy in a Python stage: it is dealt to all of them. A large
    one has splits enough and stays where it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def mapped(df: DataFrame, one, ddl: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in one(*row)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    return spread(df).mapInArrow(run, ddl)


KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def evaluate(df: DataFrame, expression: str = ".", source: str | None = "json", target: str = "json", variables: dict | None = None, seed: int = 0, indent: int = 0) -> DataFrame:
    """df (doc_id, text) to a row for each match of the expression, encoded as target. source None: guessed by text."""
    e = parse(expression)

    def one(doc_id, text):
        try:
            if text is None:
                return
            found = codecs.decode_all(text, source or codecs.guess_format(text))
        except (ValueError, RecursionError) as x:
            yield doc_id, 0, 0, None, str(x)
            return
        for k, v in enumerate(found):
            try:
                for n, m in enumerate(tree.evaluate(e, v, variables, seed)):
                    yield doc_id, k, n, canonical(m) if target == "json" and not indent else codecs.encode(m, target, indent=indent), None
            except (ValueError, TypeError, AttributeError, KeyError, RecursionError) as x:
                yield doc_id, k, 0, None, str(x)

    return mapped(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, RESULT, FIELDS, KINDS)


def convert(df: DataFrame, source: str | None, target: str, indent: int = 2) -> DataFrame:
    """df (doc_id, text) with each text in the other format."""

    def one(doc_id, text):
        try:
            out = None if text is None else codecs.convert(text, source or codecs.guess_format(text), target, indent=indent)
            yield doc_id, out, None
        except (ValueError, RecursionError) as x:
            yield doc_id, None, str(x)

    return mapped(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, "doc_id long, text string, error string", ["doc_id", "text", "error"], [pa.int64(), pa.string(), pa.string()])


def guess(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with the format that each text looks like."""
    return mapped(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lambda d, t: [(d, codecs.guess_format(t or ""))], "doc_id long, format string", ["doc_id", "format"], [pa.int64(), pa.string()])


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """One line a match, in the order of documents and matches."""
    df.orderBy("doc_id", "doc_index", "match_index").select("value").write.mode(mode).text(path)


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """Documents (value) as columns by a schema, through Spark's own JSON reader."""
    return df.select("doc_id", "doc_index", F.from_json("value", ddl).alias("v")).select("doc_id", "doc_index", "v.*")


def from_value(v) -> str:
    return json.dumps(v, ensure_ascii=False)
