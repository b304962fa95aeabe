"""Reproducible order and reproducible random numbers from a row's own id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 8


def order_key(row_id: Column, seed: int) -> Column:
    """32 hex digits; sorting by them shuffles the rows the same way on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")).cast("binary"))


def uniform(row_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digits = F.substring(order_key(row_id, seed), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def coin(row_id: Column, seed: int) -> Column:
    """True for about half of the ids."""
    return F.conv(F.substring(order_key(row_id, seed), 1, 1), 16, 10).cast("int") % 2 == 0
