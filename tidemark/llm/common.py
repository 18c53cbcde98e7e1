"""Shared pieces of the training-data operators: cut lineage, bounded Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.plans.lineage import written  # noqa: F401

#: Rows and bytes of an Arrow batch handed to Python; bounds a worker's memory whatever the documents' lengths.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, set to small Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def as_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's UTF-8 bytes (null: empty) and further columns; extra columns are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("body"), *more)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """mapInArrow that keeps the frame's columns, whatever their names; `run` finds them by place."""
    kinds = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return docs.toDF(*kinds.names).mapInArrow(run, kinds).toDF(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def arrow(schema: str, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the given schema's order; values may be lists or numpy arrays."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], type=k) for n, k in zip(names, kinds)], names=names)


_KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}
