"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % divisor


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns only: the same rows are drawn whenever a task is repeated."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that driver and executors share; its setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again when an executor is lost.

    The shuffles it took are of no further use, so their files go when the table is there.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def join_split(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with a table that was grouped by the same keys, so that a hot key's rows can be split.

    Grouping leaves the table dealt out by its keys, and a join that makes use of that is one adaptive execution can't
    split. A second key that is 0 for all rows gives both sides an exchange of their own.
    """
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    return rows.withColumn("zero", zero).join(counted.withColumn("zero", zero), [*keys, "zero"]).drop("zero")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by place, so that no name of theirs meets one of the operator's."""
    return df.toDF(*[f"column_{k}" for k in range(len(df.columns))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python's copies of long texts stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
