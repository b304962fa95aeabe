"""Limits, balanced samples, exact splits and pages, all reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.functions.hashing import order_key
from obsforge.operators.cleaning import CLASSES
from obsforge.operators.ranking import first_n_per_class, global_index, order_cut


def take_first(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The first n rows by id, as a top-n report: keep n small."""
    return df.orderBy(row_id).limit(n)


def sample_n(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer) in an order that only the rows and the seed decide.

    Rows that share an id share a key; where the cut falls among them, a hash of
    the whole row decides.
    """
    keyed = df.withColumn("__key", order_key(F.col(row_id), seed))
    cut = order_cut(keyed, "__key", {"last": lambda total: F.lit(n)}).scalar()
    below = keyed.agg(F.count_if(F.col("__key") < cut)).scalar()
    ties = Window.partitionBy("__key").orderBy(F.xxhash64(*df.columns))  # rows of one id
    last = keyed.where(F.col("__key") == cut).withColumn("__turn", F.row_number().over(ties))
    last = last.where(F.col("__turn") <= F.lit(n) - below).drop("__turn")
    return keyed.where(F.col("__key") < cut).unionByName(last).drop("__key")


def cap_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The first n rows by a unique numeric id, for any n: the n-th id is found, and rows are only filtered."""
    return first_n_per_class(df.withColumn("__all", F.lit("all")), row_id, "__all", {"all": lambda size: F.lit(n)}).drop("__all")


def _per_class(size: dict[str, Column], most: int | None) -> Column:
    n = F.least(*size.values())
    return n if most is None else F.least(n, F.lit(most // 2).cast("bigint"))


def balance_first(df: DataFrame, row_id: str, class_col: str, most: int | None = None) -> DataFrame:
    """The first N rows by id of each class, N = min(class sizes, most // 2)."""
    limits = {c: (lambda size: _per_class(size, most)) for c in CLASSES}
    return first_n_per_class(df, row_id, class_col, limits)


def balance_random(
    df: DataFrame, row_id: str, class_col: str, seed: int = 42, most: int | None = None, order: str = "shuffle_key"
) -> DataFrame:
    """A random N per class, N as in balance_first, with the key that shuffles the result. Ids must be unique."""
    keyed = df.where(F.col(class_col).isin(*CLASSES)).withColumn(order, order_key(F.col(row_id), seed))
    sizes = keyed.agg(F.struct(*[F.count_if(F.col(class_col) == c).alias(f"c{i}") for i, c in enumerate(CLASSES)])).scalar()
    n = _per_class({c: sizes[f"c{i}"] for i, c in enumerate(CLASSES)}, most)
    kept = F.lit(False)
    for c in CLASSES:
        cut = order_cut(keyed.where(F.col(class_col) == c), order, {"last": lambda total: n}).scalar()
        kept = kept | ((F.col(class_col) == c) & (F.col(order) <= cut))
    return keyed.where(kept)


def split_exact(
    df: DataFrame, row_id: str, shares: tuple[float, float] = (0.6, 0.2), seed: int = 42, name: str = "split"
) -> DataFrame:
    """Append train, val or test: int(a N) rows, int(b N) rows and the rest, at random by id.

    Rows that share an id share a part, so the counts are exact for unique ids.
    """
    first, second = shares
    keyed = df.withColumn("__key", order_key(F.col(row_id), seed))
    cuts = order_cut(
        keyed,
        "__key",
        {
            "train": lambda total: F.floor(total * F.lit(first)),
            "val": lambda total: F.floor(total * F.lit(first)) + F.floor(total * F.lit(second)),
        },
    ).select(F.struct("train", "val")).scalar()
    part = F.when(F.col("__key") <= cuts["train"], "train").when(F.col("__key") <= cuts["val"], "val").otherwise("test")
    return keyed.withColumn(name, part).drop("__key")


def page(df: DataFrame, day: str, row_id: str, size: int, name: str = "batch") -> DataFrame:
    """Running index over (day, row_id) and the page of `size` rows it falls in; no row is lost."""
    return global_index(df, day, row_id).withColumn(name, F.floor(F.col("index") / size))
