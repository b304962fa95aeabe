"""Observation dates: free text in, DATE out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One or two digits, slash, one or two digits, slash, four digits.
OBSERVATION_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"


def parse_obs_date(
    raw: Column, min_year: int | None = None, max_year: int | None = None, fallback: Column | None = None
) -> Column:
    """Month/day/year text, optionally followed by a blank and a time, as a DATE.

    Text of any other shape and days the calendar lacks give `fallback`, which
    is NULL unless the caller wants the tolerant form.
    """
    token = F.substring_index(raw, " ", 1)
    day = F.when(token.rlike(OBSERVATION_DATE), F.try_to_date(token, "M/d/yyyy"))
    if min_year is not None:
        day = F.when(F.year(day) >= min_year, day)
    if max_year is not None:
        day = F.when(F.year(day) <= max_year, day)
    return day if fallback is None else F.coalesce(day, fallback)


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def utc_date(moment: Column) -> Column:
    """The calendar day of a DATE or TIMESTAMP_NTZ, and the day in UTC of a TIMESTAMP, whatever the session's time zone.

    The type of the column decides when the plan is made, so nothing is tested per row.
    """
    micros = F.unix_micros(moment.cast("timestamp"))
    utc = F.date_from_unix_date(F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    return F.when(F.typeof(moment) == "timestamp", utc).otherwise(moment.cast("date"))


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, the integer every window frame runs on."""
    return F.datediff(utc_date(day), F.lit("1970-01-01").cast("date"))


def season(day: Column) -> Column:
    return F.when(F.month(day).between(3, 8), "breeding").otherwise("migration")


def seasonal_cycle(day: Column) -> tuple[Column, Column]:
    """Cosine and sine of the 0-based day of the year over 365 days."""
    angle = (F.dayofyear(day) - 1) * F.lit(2.0) * F.pi() / F.lit(365.0)
    return F.cos(angle), F.sin(angle)
