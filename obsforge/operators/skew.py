"""Joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 64  # a key is hot when it holds more than 1/64 of the rows: at most 64 keys can
SALTS = 32
SIEVE = 1 << 16  # buckets of wanted keys

_SALT = "__salt"
_HOT = "__hot"


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE, weight: str | None = None) -> DataFrame:
    """Keys that hold more than 1/share of all rows: fewer than `share` rows, whatever the data.

    Counts are combined on the map side, so a hot key costs one row per task.
    `weight` names a column that already holds row counts.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys).agg(rows.alias("__rows"))
    total = counts.agg(F.sum("__rows")).scalar()
    return counts.where(F.col("__rows") * share > total).select(*keys, F.lit(True).alias(_HOT))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    condition: Column | None = None,
    hot: DataFrame | None = None,
    hot_left: str | None = None,
    spread: list[str] | None = None,
    salts: int = SALTS,
    strategy: str | None = None,
) -> DataFrame:
    """Equi-join on `keys` in which no task gets all left rows of a hot key.

    Left rows of a hot key are divided over `salts` sub-keys by a hash of
    `spread` (all columns unless given); the right rows of that key are repeated
    once per sub-key. Every other key is joined as is. `hot` defaults to the hot
    keys of the left side, a list whose length is bounded, hence the broadcast.
    `hot_left` names a boolean column that already marks the left rows to divide;
    `hot` must then hold every key such a row may have. `strategy` is a join hint:
    a join whose rows are few but meet many others should be shuffled ("merge")
    even where its bytes would fit a broadcast, so that all cores take part.
    Use with how in inner, left, left_semi, left_anti: all of them look at left
    rows one by one, so the division does not change the result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    hot = F.broadcast(hot_keys(left, keys) if hot is None else hot)
    pick = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salts)).cast("int")
    if hot_left:
        divided = left.withColumn(_SALT, F.when(F.col(hot_left), pick).otherwise(F.lit(0)))
    else:
        marked = left.join(hot, keys, "left")
        divided = marked.withColumn(_SALT, F.when(F.col(_HOT), pick).otherwise(F.lit(0))).drop(_HOT)
    copies = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, keys, "left").withColumn(_SALT, F.explode(copies)).drop(_HOT)
    if strategy:
        repeated = repeated.hint(strategy)
    return _join(divided, repeated, [*keys, _SALT], how, condition).drop(_SALT)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, condition: Column | None) -> DataFrame:
    """Equi-join with a further condition on `l.` and `r.` columns; the columns of `on` come from the left."""
    if condition is None:
        return left.join(right, on, how)
    matched = condition
    for key in on:
        matched = (F.col(f"l.{key}") == F.col(f"r.{key}")) & matched
    joined = left.alias("l").join(right.alias("r"), matched, how)
    kept = [F.col(f"l.{c}") for c in left.columns]
    if how in ("inner", "left"):
        kept += [F.col(f"r.{c}") for c in right.columns if c not in on]
    return joined.select(*kept)


def splittable_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", condition: Column | None = None) -> DataFrame:
    """Join whose hot keys are left to adaptive execution, also where a side was grouped by the same keys.

    A grouped table is dealt out by its keys already, and a join that makes use of that is one that can't be split. A
    further key that is 0 for all rows gives both sides an exchange of their own. Unlike salted_join it looks for hot keys in
    the rows that arrive, so no side is planned again to count them. Use with how in inner, left, left_semi, left_anti.
    """
    zero = F.xxhash64(*keys).bitwiseAND(F.lit(0))
    return _join(left.withColumn(_SALT, zero), right.withColumn(_SALT, zero), [*keys, _SALT], how, condition).drop(_SALT)


def sieved(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose integer keys may be among those of `wanted`: all that are, and few others.

    Keys are hashed into SIEVE buckets, so what is broadcast is bounded however many keys are wanted; most rows of
    other keys go before they are shuffled. A later join decides.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("bigint") for k in keys]), F.lit(SIEVE))
    held = wanted.select(bucket.alias("__bucket")).distinct()
    return df.join(F.broadcast(held), bucket == F.col("__bucket"), "left_semi")


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """Spread a table over all cores before its rows multiply.

    Adaptive execution sizes partitions by the bytes they hold and cannot see
    that each row is about to become many. Only for tables already reduced to
    distinct keys, so that no key is hot.
    """
    # on a hash of the keys: repartitioning on the keys themselves is dropped right after grouping by them
    return df.repartition(_parts(df), F.xxhash64(*columns))


def gather(df: DataFrame, *columns: str) -> DataFrame:
    """Bring rows of a key together for grouping, over all cores: the one shuffle that grouping by it, or by more, then needs.

    Adaptive execution would put small keys into few tasks, however much work each of them is.
    """
    return df.repartition(_parts(df), *columns)


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
