"""Observation tables: fixed schema, filters, reasons for rejects, missing-band checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.values import is_missing

CLASSES = ("PRESENT", "ABSENT")  # fixed values: the two classes an observation may have


def conform(df: DataFrame, schema: Mapping[str, str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Rename input columns, cast to the wanted types, add absent columns as typed NULLs."""
    renamed = df.withColumnsRenamed(dict(rename or {}))
    present = {c.lower(): c for c in renamed.columns}
    return renamed.select(
        *[
            (F.col(f"`{present[name.lower()]}`") if name.lower() in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in schema.items()
        ]
    )


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which none of the columns is NULL."""
    return df.dropna(subset=list(columns))


def filter_observations(
    df: DataFrame,
    day: str = "obs_date",
    presence: str = "presence",
    country: str = "country",
    start: str | None = None,
    end: str | None = None,
    min_year: int | None = None,
    after_year: int | None = None,
    before_year: int | None = None,
    classes: Iterable[str] | None = None,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """Date range with both ends included, year bounds, classes and countries.

    `after_year` and `before_year` exclude the year they name. Conditions are
    plain comparisons on columns, so they reach the file scan.
    """
    kept = df
    if start is not None:
        kept = kept.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.where(F.col(day) <= F.lit(end).cast("date"))
    if min_year is not None:
        kept = kept.where(F.col(day) >= F.lit(f"{min_year:04d}-01-01").cast("date"))
    if after_year is not None:
        kept = kept.where(F.col(day) >= F.lit(f"{after_year + 1:04d}-01-01").cast("date"))
    if before_year is not None:
        kept = kept.where(F.col(day) < F.lit(f"{before_year:04d}-01-01").cast("date"))
    if classes is not None:
        kept = kept.where(F.col(presence).isin(*classes))
    if countries is not None:
        kept = kept.where(F.col(country).isin(*countries))
    return kept


def iso_range(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Range on zero-padded ISO text; same rows as the range on dates."""
    return df.where(F.col(text).between(start, end))


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """Start included, end excluded."""
    return (ts >= start) & (ts < end)


def in_days(ts: Column, start: str, end: str) -> Column:
    """Times from the start of one UTC day to that of another, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    zoned = (ts >= F.lit(f"{start} 00:00:00Z").cast("timestamp")) & (ts < F.lit(f"{end} 00:00:00Z").cast("timestamp"))
    plain = (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
    return F.when(F.typeof(ts) == "timestamp", zoned).otherwise(plain)


def reject_reason(
    day: Column, lon: Column, lat: Column, presence: Column, max_year: int, extra: Mapping[str, Column] | None = None
) -> Column:
    """First rule a row breaks, or NULL. `extra` maps further reasons to their conditions."""
    rules = {
        "no_date": day.isNull(),
        "year_out_of_range": ~F.year(day).between(1900, max_year),
        "no_geometry": lon.isNull() | lat.isNull(),
        "no_presence": presence.isNull(),
        "bad_presence": ~presence.isin(*CLASSES),
        **(extra or {}),
    }
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        reason = F.when(broken, name).otherwise(reason)
    return reason


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rest with a `reason` column."""
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def missing_bands(df: DataFrame, bands: list[str], name: str = "missing_bands") -> DataFrame:
    """Names of the bands that are NULL or NaN in a row; every row and band is looked at."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(is_missing(F.col(b)), F.lit(b)) for b in bands])))


def plan_summary(df: DataFrame, presence: str = "presence") -> DataFrame:
    """Counts of what a run would process, in one pass and one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col(presence) == "PRESENT").alias("n_presence"),
        F.count_if(F.col(presence) == "ABSENT").alias("n_absence"),
    )


def inspect(df: DataFrame, row_id: str, limit: int = 5, skip: int = 0) -> DataFrame:
    """A page of rows in id order, for looking at a table."""
    return df.orderBy(row_id).offset(skip).limit(limit)
