"""Exact medians per group, including groups that hold a large part of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.operators.skew import hot_keys


BUCKETS = 1024  # of the range of a hot group's values


def exact_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "median",
    times: str | None = None,
    hot: DataFrame | None | bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per group that has a non-NULL value, with the interpolated median.

    `times` names a column that says how often each row counts. Equal values of a group are counted first, on the map side;
    all that follows reads these counts, so the input is read once. An ordinary group is sorted in one task. A hot group
    is never brought together: its values are counted by buckets of its own range, and only the bucket that
    holds the middle is sorted. `hot` is a table of such groups by some of the key columns, shorter than HOT_SHARE as
    operators.skew.hot_keys gives it and broadcast on that ground; by default rows are counted per group, None means
    that there are none. Nothing runs before the result is asked for.
    """
    weight = F.col(times) if times else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__times"))
    if hot is True:
        hot = hot_keys(rows, keys, weight="__times")
    ordinary = rows
    if hot is not None:
        marks = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in hot.columns if k in keys], F.lit(True).alias("__is_hot"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(c.removeprefix("__hot_"))) for c in marks.columns if c != "__is_hot"])
        # Marked rather than semi- and anti-joined: those would move below the counting, which then ran for each of them.
        marked = rows.join(F.broadcast(marks), same, "left")
        ordinary = marked.where(F.col("__is_hot").isNull()).select(*rows.columns)
    group = Window.partitionBy(*keys)
    ranked = ordinary.withColumns(
        {
            "__last": F.sum("__times").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
            "__total": F.sum("__times").over(group),
        }
    )
    plain = _middle(ranked, keys, value, name)
    if hot is None:
        return plain
    heavy = marked.where("__is_hot").select(*rows.columns)
    return plain.unionByName(_select_middle(heavy, keys, value, name, buckets))


def _middle(ranked: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean of the lower and the upper middle value, from rows that know the rank they end at and the group's total."""
    first = F.col("__last") - F.col("__times")
    lower, upper = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > first) & (rank <= F.col("__last")), F.col(value).cast("double")))

    near = ranked.where((upper > first) & (lower <= F.col("__last")))
    return near.groupBy(*keys).agg(((at(lower) + at(upper)) / 2.0).alias(name))


def _select_middle(counted: DataFrame, keys: list[str], value: str, name: str, buckets: int) -> DataFrame:
    low, high = F.col("__range.low"), F.col("__range.high")
    spans = counted.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(
        F.struct(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high")).alias("__range")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    share = (F.col(value).cast("double") - low) / (high - low)
    bucket = F.when(high > low, F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    rows = counted.join(spans, same).withColumn("__bucket", F.coalesce(bucket, F.lit(0))).drop("__range", *[f"__of_{k}" for k in keys])
    group = Window.partitionBy(*keys)  # of bucket totals: at most `buckets` rows per group
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    lower, upper = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    end = F.col("__start") + F.col("__in")
    holding = (
        rows.groupBy(*keys, "__bucket")
        .agg(F.sum("__times").alias("__in"))
        .withColumn("__start", F.coalesce(F.sum("__in").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__in").over(group))
        .where((upper > F.col("__start")) & (lower <= end))
        .drop("__in")
    )  # two buckets per group at most
    run = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(holding.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, "__bucket"]}), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*keys, "__bucket"]])).withColumn("__last", F.col("__start") + F.sum("__times").over(run))
    return _middle(ranked, keys, value, name)
