"""File readers. Filters and column lists are given before the read result is used, so scans stay narrow."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsforge.functions.dates import utc_date
from obsforge.operators.cleaning import conform, in_window
from obsforge.sources.catalogue import OBSERVATION_SCHEMA, REPORT_RENAMES

CSV_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in OBSERVATION_SCHEMA.items())


def read_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA, columns: Iterable[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; no inference pass. Columns are matched by position in `schema`."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_csv_columns(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Wanted columns of a CSV whose header may hold others in any order."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in columns.items()])


def read_observations(spark: SparkSession, path: str, rename: Mapping[str, str] = REPORT_RENAMES) -> DataFrame:
    """A parquet table of observations in the fixed schema."""
    return conform(spark.read.parquet(path), OBSERVATION_SCHEMA, rename)


def read_measurements(
    spark: SparkSession,
    path: str,
    collections: Iterable[str],
    start: Column,
    end: Column,
    bands: Iterable[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Rows of the named collections with start <= ts < end.

    A table partitioned by `source` and `month` (see writers.write_measurements)
    is pruned on both: the month filter repeats the time filter on the partition column.
    """
    df = spark.read.parquet(path).where(F.col("source").isin(*collections)).where(in_window(F.col(ts), start, end))
    if "month" in df.columns:
        months = F.date_format(utc_date(start), "yyyy-MM"), F.date_format(utc_date(end), "yyyy-MM")
        df = df.where(F.col("month").cast("string").between(*months))
    return df.where(F.col("band").isin(*bands)) if bands else df


def near_samples(measured: DataFrame, samples: DataFrame, day: str, frame: tuple[int, int]) -> DataFrame:
    """Measurements of the months that the frames around the samples' days reach; folders of other months are not read.

    `measured` is a table in the layout of writers.write_measurements. The months come from the samples when the query runs, as a
    subquery with one entry per calendar month at most. A sample without a day reaches none.
    """
    first, last = (F.trunc(F.date_add(utc_date(F.col(day)), n), "month") for n in frame)
    months = samples.where(F.col(day).isNotNull()).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("m"))
    reached = months.agg(F.collect_set(F.date_format("m", "yyyy-MM"))).scalar()
    return measured.where(F.array_contains(reached, F.col("month").cast("string")))


def read_static(spark: SparkSession, path: str, layers: Iterable[str]) -> DataFrame:
    """Long layer rows (layer, cell_x, cell_y, value) as one row per cell."""
    return widen_layers(spark.read.parquet(path), layers)


def widen_layers(long: DataFrame, layers: Iterable[str]) -> DataFrame:
    """One column per named layer. The list is given, so no pass is needed to find it."""
    names = list(layers)
    picked = [F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names]
    return long.where(F.col("layer").isin(*names)).groupBy("cell_x", "cell_y").agg(*picked)


def read_boundary(spark: SparkSession, path: str, attribute: str, value: str) -> DataFrame:
    """Polygon edges whose attribute has the given value."""
    return spark.read.parquet(path).where(F.col(attribute) == value)


def list_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """Name, size and time of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_key"), "path", "length", "modificationTime"
    )


def hash_files(spark: SparkSession, path: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """Name, path and md5 of the content; for files of up to 2 GB, such as sample tiles."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_key"), "path", F.md5("content").alias("md5"))
