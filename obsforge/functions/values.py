"""Missing values, casts and simple class columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_missing(c: Column) -> Column:
    """True for NULL and for NaN, which Spark keeps apart."""
    return c.isNull() | F.isnan(c)


def unmask(c: Column, value: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(value))


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(usable, c).otherwise(F.lit(0.0))


def binarise(c: Column, threshold: float = 0.5) -> Column:
    """1 when strictly above the threshold, else 0; NULL stays 0."""
    return F.coalesce((c > threshold).cast("int"), F.lit(0))


def class_label(presence: Column, positive: str = "PRESENT") -> Column:
    return F.when(presence == positive, 1.0).otherwise(0.0).cast("float")


def as_float(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast the named columns to 32-bit floats, for use right before a sink."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def rescale(c: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Physical value of a stored measurement."""
    if scale == 1.0 and offset == 0.0:
        return c
    return c * F.lit(scale) + F.lit(offset)
