"""Sinks. Each is one distributed write of a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsforge.functions.dates import utc_date
from obsforge.functions.values import as_float
from obsforge.operators.manifest import new_or_changed


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_batches(df: DataFrame, path: str, selectors: Iterable[str], batch: str = "batch") -> None:
    """CSV with the columns in the given order, one folder per batch."""
    df.select(*selectors, batch).hint("rebalance", batch).write.mode("overwrite").option("header", True).partitionBy(batch).csv(path)


def write_features(df: DataFrame, path: str, bands: list[str], label: str = "label") -> None:
    """Feature rows with 32-bit bands, one folder per label.

    Rows are rebalanced first, so that a label with most of the rows is still
    written by many tasks, in files of a sensible size.
    """
    as_float(df, bands).hint("rebalance").write.mode("overwrite").partitionBy(label).parquet(path)


def write_measurements(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Long measurements in folders by source and month, the layout read_measurements prunes."""
    with_month = df.withColumn("month", F.date_format(utc_date(F.col(ts)), "yyyy-MM"))
    with_month.hint("rebalance", "source", "month").write.mode("overwrite").partitionBy("source", "month").parquet(path)


def update_tile_cache(pixels: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Append the pixels of new or changed files to the cache; returns the files that were added.

    Pixels keep (file_key, md5), so a changed file adds a new version and `read_tile_cache` picks the version that
    `files` names. A table beside them has one row per version, written after the pixels: a run that breaks off leaves a
    version out of it, and the next run adds that version's pixels anew.
    """
    known = known_tiles(pixels.sparkSession, path)
    fresh = files if known is None else new_or_changed(files, known)
    versions = fresh.select("file_key", "md5")
    run = uuid.uuid4().hex
    tagged = pixels.join(versions, "file_key").withColumn("run", F.lit(run))
    tagged.hint("rebalance").write.mode("append").parquet(f"{path}/pixels")
    versions.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/files")
    done = pixels.sparkSession.read.parquet(f"{path}/files").where(F.col("run") == run)
    return done.drop("run")


def known_tiles(spark: SparkSession, path: str) -> DataFrame | None:
    """(file_key, md5) of the versions in the cache; None when there is no cache yet."""
    files = _versions(spark, path)
    return None if files is None else files.select("file_key", "md5")


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("file_key STRING, md5 STRING, run STRING").parquet(f"{path}/files")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_tile_cache(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Pixels of the listed versions; what a run that broke off has left is not read."""
    wanted = _versions(spark, path).join(files.select("file_key", "md5"), ["file_key", "md5"], "left_semi")
    return spark.read.parquet(f"{path}/pixels").join(wanted, ["file_key", "md5", "run"], "left_semi").drop("run")


def write_metrics(long: DataFrame, path: str) -> None:
    """(model, metric, value) rows as JSON lines."""
    long.write.mode("overwrite").json(path)
