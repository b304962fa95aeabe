"""Which samples and files are done, so that an interrupted run can resume."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.names import flag_from_name, index_from_name, label_from_name

STATUSES = ("completed", "failed", "skipped")  # fixed values

MANIFEST_SCHEMA = "object_id BIGINT, status STRING, attempt INT, reason STRING, ts TIMESTAMP"
PROGRESS_SCHEMA = (
    "processed_indices ARRAY<BIGINT>, completed_count BIGINT, failed_count BIGINT, skipped_count BIGINT, timestamp STRING"
)


def latest(manifest: DataFrame, row_id: str = "object_id") -> DataFrame:
    """One row per id: its last attempt."""
    newest = F.max_by(F.struct("status", "attempt", "reason", "ts"), F.struct("attempt", "ts"))
    return manifest.groupBy(row_id).agg(newest.alias("m")).select(row_id, "m.*")


def pending(
    df: DataFrame, manifest: DataFrame, row_id: str = "object_id", statuses: Iterable[str] = STATUSES
) -> DataFrame:
    """Rows whose last attempt has none of the given statuses; leave `failed` out to retry failures."""
    done = latest(manifest, row_id).where(F.col("status").isin(*statuses)).select(row_id)
    return df.join(done, row_id, "left_anti").select(*df.columns)


def progress_summary(manifest: DataFrame, row_id: str = "object_id") -> DataFrame:
    """Counts per status of the last attempts and the completed share in percent, in one row."""
    counts = latest(manifest, row_id).agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES],
    )
    total = F.col("completed_count") + F.col("failed_count") + F.col("skipped_count")
    share = F.when(total > 0, F.col("completed_count") * 100.0 / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0))
    return counts.withColumn("total_count", total).withColumn("completion_percentage", share)


def manifest_rows(df: DataFrame, row_id: Column, status: Column, ts: Column, reason: Column | None = None, attempt: int = 1) -> DataFrame:
    """Manifest rows for processed samples; append them with `append_manifest`."""
    return df.select(
        row_id.cast("bigint").alias("object_id"),
        status.cast("string").alias("status"),
        F.lit(attempt).cast("int").alias("attempt"),
        (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
        ts.cast("timestamp").alias("ts"),
    )


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def progress_from_json(documents: DataFrame, column: str) -> DataFrame:
    """Fields of progress documents, with the defaults an absent field has."""
    parsed = documents.withColumn("p", F.from_json(F.col(column), PROGRESS_SCHEMA))
    return parsed.select(
        *[c for c in documents.columns if c != column],
        F.coalesce(F.col("p.processed_indices"), F.array().cast("array<bigint>")).alias("processed_indices"),
        *[F.coalesce(F.col(f"p.{s}_count"), F.lit(0)).alias(f"{s}_count") for s in STATUSES],
        F.coalesce(F.col("p.timestamp"), F.lit("unknown")).alias("timestamp"),
    )


def new_or_changed(files: DataFrame, known: DataFrame, keys: Iterable[str] = ("file_key", "md5")) -> DataFrame:
    """Files whose (name, content hash) is not known yet."""
    on = list(keys)
    return files.join(known.select(*on), on, "left_anti").select(*files.columns)


def reconcile(expected: DataFrame, saved: DataFrame, row_id: str = "object_id") -> DataFrame:
    """Ids that only one side has, with the side; no rows when both sets are equal."""
    a = expected.select(row_id).distinct().withColumn("e", F.lit(True))
    b = saved.select(row_id).distinct().withColumn("s", F.lit(True))
    side = F.when(F.col("s").isNull(), "not_saved").when(F.col("e").isNull(), "not_expected")
    return a.join(b, row_id, "full_outer").withColumn("side", side).where(F.col("side").isNotNull()).select(row_id, "side")


def count_by_name(names: DataFrame, column: str) -> DataFrame:
    """Presence and absence files by the label in their names, and how many names carry an index."""
    label, flag = label_from_name(F.col(column)), flag_from_name(F.col(column))
    return names.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(label == 1).alias("presence_count"),
        F.count_if(label == 0).alias("absence_count"),
        F.count_if(label.isNull()).alias("no_label"),
        F.sum(flag.cast("bigint")).alias("flagged"),
        F.count(index_from_name(F.col(column))).alias("indexed"),
    )
