"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pollspark.session import shared_dir, shuffles_freed

SLICE_BYTES = 4 << 20
BATCH_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of the lineage that any executor can read.

    The shuffle files of the writing go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the bytes of the session's Arrow batches; by rows alone, ten thousand texts or sets are one batch.

    The setting stays, because plans read it when they run. It changes memory and not results.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes at most, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if len(sizes) > first:
            yield batch.slice(first)


def rows_with(docs: DataFrame, stay: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(doc, and what ``stay`` adds): one row of ``docs``, as a struct, for each (key, id) of ``stay``.

    ``stay`` holds ``key``, ``id`` and further columns. The join and the choice among repeated rows use the same
    three plain columns, nulls spelled out, so texts are shuffled once.
    """
    own = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("own_key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("own_id"),
                      F.col(id_col).isNull().alias("own_none"))
    named = stay.withColumnsRenamed({"key": "own_key"}).withColumn("own_id", F.coalesce(F.col("id").cast("string"), F.lit(""))) \
        .withColumn("own_none", F.col("id").isNull()).drop("id")
    keys = ["own_key", "own_id", "own_none"]
    return own.join(named.dropDuplicates(keys), keys).dropDuplicates(keys).drop(*keys)
