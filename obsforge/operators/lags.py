"""Measurements before (or around) each sample's day.

The table of measurements is reduced to one row per (place, day) first. Samples
are reduced to distinct (place, day) too, so the rows that meet at a place
are bounded by the calendar, however many samples or measurements share it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsforge.functions.dates import day_number
from obsforge.operators.skew import splittable_join
from obsforge.operators.window_median import window_medians

LAGS = (30, 60, 90)  # fixed values: days looked back


@dataclass(frozen=True)
class Band:
    """One output variable: rows where `rows` holds, their `value`, and how to reduce it.

    reducer is one of mean, sum, min, max, count.
    """

    name: str
    rows: Column
    value: Column
    reducer: str = "mean"


def _daily(bands: Iterable[Band]) -> list[Column]:
    out = []
    for b in bands:
        v = F.when(b.rows, b.value)
        out.append(F.count(v).alias(f"{b.name}__n"))
        if b.reducer in ("mean", "sum"):
            out.append(F.sum(v).alias(f"{b.name}__v"))
        elif b.reducer in ("min", "max"):
            out.append(getattr(F, b.reducer)(v).alias(f"{b.name}__v"))
    return out


def _pieces(frames: Mapping[str, tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """Disjoint day ranges that the frames are unions of, each with the frames it belongs to.

    Nested windows then read every day once instead of once per window.
    """
    edges = sorted({first for first, _ in frames.values()} | {last + 1 for _, last in frames.values()})
    parts = {}
    for low, high in zip(edges, edges[1:]):
        members = [name for name, (first, last) in frames.items() if first <= low and high - 1 <= last]
        if members:
            parts[(low, high - 1)] = members
    return parts


def _combine(reducer: str, parts: list[Column]) -> Column:
    """One value from those of disjoint ranges; NULL when all are."""
    if reducer in ("min", "max"):
        return parts[0] if len(parts) == 1 else (F.least if reducer == "min" else F.greatest)(*parts)
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def _finished(band: Band, suffix: str, pieces: list[int], on_missing: str) -> dict[str, Column]:
    n = F.lit(0)
    for i in pieces:
        n = n + F.coalesce(F.col(f"{band.name}__n{i}"), F.lit(0))
    if band.reducer == "count":
        value = n
    else:
        value = _combine(band.reducer, [F.col(f"{band.name}__v{i}") for i in pieces])
        if band.reducer == "mean":
            value = F.try_divide(value, n)
        if on_missing == "zero":
            value = F.coalesce(value, F.lit(0.0))
    return {f"{band.name}_{suffix}": value, f"n_{band.name}_{suffix}": n}


def _meetings(wanted: DataFrame, daily: DataFrame, place: list[str], parts: Mapping[tuple[int, int], list[str]]) -> DataFrame:
    """(place, __day, __piece, daily columns): each wanted day with the measured days of every piece around it, and once alone.

    Both sides are binned by days, in bins as long as all pieces together, so that a wanted day meets two of them. Only wanted
    days are worked out: a window over the days of both would do so for each measured day too, and most days are those.
    """
    first, last = min(low for low, _ in parts), max(high for _, high in parts)
    width = last - first + 1
    reach = F.sequence(F.floor((F.col("__day") + first) / width), F.floor((F.col("__day") + last) / width))
    measured = daily.withColumnRenamed("__day", "__at").withColumn("__bin", F.floor(F.col("__at") / width))
    ahead = F.col("r.__at") - F.col("l.__day")
    asked = wanted.select(*place, "__day").withColumn("__bin", F.explode(reach))
    met = splittable_join(asked, measured, [*place, "__bin"], "inner", (ahead >= first) & (ahead <= last))
    piece = F.lit(None).cast("int")
    for i, (low, high) in enumerate(parts):
        piece = F.when((F.col("__at") - F.col("__day")).between(low, high), F.lit(i)).otherwise(piece)
    pieces = met.withColumn("__piece", piece).where(F.col("__piece").isNotNull()).drop("__bin", "__at")
    return pieces.unionByName(wanted.select(*place, "__day"), allowMissingColumns=True)


def _wanted(samples: DataFrame, place: list[str], day: str) -> DataFrame:
    """Distinct (place, day) of the samples, marked."""
    return samples.select(*place, day_number(F.col(day)).alias("__day")).distinct().withColumn("__rows", F.lit(True))


def _attach(samples: DataFrame, values: DataFrame, place: list[str], day: str, how: str) -> DataFrame:
    """Join values per (place, day) back to the samples; a day with a large part of them is left to adaptive execution."""
    keyed = samples.withColumn("__day", day_number(F.col(day)))
    return splittable_join(keyed, values, [*place, "__day"], how).drop("__day")


def frame_features(
    samples: DataFrame,
    measurements: DataFrame,
    place: list[str],
    sample_day: str,
    measured_day: str,
    bands: list[Band],
    frames: Mapping[str, tuple[int, int]],
    on_missing: str = "null",
    keep_counts: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """Append `<band>_<frame>` for each band and day frame to every sample.

    A frame (a, b) covers the days d+a .. d+b, both included. With on_missing
    ``zero`` an empty frame gives 0; with ``drop`` a sample with any empty frame
    is removed. `keep_counts` keeps `n_<band>_<frame>`.

    `base` is a table with the places and days of all samples, for samples that
    already went through costly steps: places are then read from it instead.
    """
    bands = list(bands)
    used = measurements.where(reduce(lambda a, b: a | b, [b.rows for b in bands]))  # reaches the scan
    partial = used.groupBy(*place, day_number(F.col(measured_day)).alias("__day")).agg(*_daily(bands))
    wanted = _wanted(samples if base is None else base, place, sample_day)
    parts = _pieces(frames)
    met = _meetings(wanted, partial, place, parts)
    summed: list[Column] = []
    for i in range(len(parts)):
        for band in bands:
            kept = {c: F.when(F.col("__piece") == i, F.col(f"{band.name}__{c}")) for c in ("n", "v") if c == "n" or band.reducer != "count"}
            summed.append(F.sum(kept["n"]).alias(f"{band.name}__n{i}"))
            if "v" in kept:
                fold = getattr(F, band.reducer if band.reducer in ("min", "max") else "sum")
                summed.append(fold(kept["v"]).alias(f"{band.name}__v{i}"))
    added: dict[str, Column] = {}
    for suffix in frames:
        pieces = [i for i, members in enumerate(parts.values()) if suffix in members]
        for band in bands:
            added.update(_finished(band, suffix, pieces, on_missing))
    values = met.groupBy(*place, "__day").agg(*summed).select(*place, "__day", *[c.alias(k) for k, c in added.items()])
    counts = [f"n_{band.name}_{suffix}" for suffix in frames for band in bands]
    if on_missing == "drop":
        for c in counts:
            values = values.where(F.col(c) > 0)
    joined = _attach(samples, values, place, sample_day, "inner" if on_missing == "drop" else "left")
    return joined if keep_counts else joined.drop(*counts)


def lag_features(
    samples: DataFrame,
    measurements: DataFrame,
    place: list[str],
    sample_day: str,
    measured_day: str,
    bands: list[Band],
    lags: Iterable[int] = LAGS,
    on_missing: str = "zero",
    keep_counts: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """Cumulative windows [d - lag, d): the sample's own day is not part of them."""
    frames = {str(lag): (-lag, -1) for lag in lags}
    return frame_features(
        samples, measurements, place, sample_day, measured_day, bands, frames, on_missing, keep_counts, base
    )


def disjoint_counts(
    samples: DataFrame, reports: DataFrame, place: list[str], sample_day: str, report_day: str, bands: list[Band]
) -> DataFrame:
    """Counts of the periods [d-30, d), [d-60, d-30), [d-90, d-60) at the sample's own place."""
    frames = {"30": (-30, -1), "60": (-60, -31), "90": (-90, -61)}
    return frame_features(samples, reports, place, sample_day, report_day, bands, frames, "null")


def missing_list(names: Mapping[str, Column], column: str = "missing") -> Column:
    """Array of the names whose count column is 0."""
    return F.array_compact(F.array(*[F.when(n == 0, F.lit(name)) for name, n in names.items()])).alias(column)


def critical_gate(missing: Column, critical: Iterable[str], most: int | None = None) -> Column:
    """True when a critical name is missing, or, given `most`, when more than that many names are."""
    gate = F.arrays_overlap(missing, F.array(*[F.lit(c) for c in critical]))
    return gate if most is None else gate | (F.size(missing) > most)


def with_fallback(n_first: Column, first: Column, n_second: Column, second: Column, default: float = 0.0) -> Column:
    """The first source when it has any row for this sample, else the second, else the default."""
    return F.when(n_first > 0, first).when(n_second > 0, second).otherwise(F.lit(default))


def best_in_window(
    samples: DataFrame,
    scenes: DataFrame,
    place: list[str],
    sample_day: str,
    scene_day: str,
    rank: list[str],
    carry: list[str],
    frame: tuple[int, int] = (-15, 14),
    name: str = "best",
    base: DataFrame | None = None,
) -> DataFrame:
    """Append the struct of `rank` + `carry` of the best scene within the frame; NULL without one.

    `rank` orders scenes, smallest first, and should end in a unique id. Only the
    best scene of each (place, day) enters the window, so a place with many
    scenes per day costs no more than one with a single scene.
    """
    best = F.min(F.struct(*rank, *carry))
    daily = scenes.groupBy(*place, day_number(F.col(scene_day)).alias("__day")).agg(best.alias("__best"))
    wanted = _wanted(samples if base is None else base, place, sample_day)
    window = Window.partitionBy(*place).orderBy("__day").rangeBetween(*frame)
    found = (
        wanted.unionByName(daily, allowMissingColumns=True)
        .withColumn(name, F.min("__best").over(window))
        .where(F.col("__rows").isNotNull())
        .select(*place, "__day", name)
    )
    return _attach(samples, found, place, sample_day, "left")


def window_median(
    samples: DataFrame,
    measurements: DataFrame,
    place: list[str],
    sample_day: str,
    measured_day: str,
    values: list[str],
    frame: tuple[int, int],
    base: DataFrame | None = None,
) -> DataFrame:
    """Append `<value>_median`, the exact median of each value within the frame; NULL when it is empty."""
    source = samples if base is None else base
    medians = window_medians(_wanted(source, place, sample_day), measurements, place, measured_day, values, frame)
    return _attach(samples, medians, place, sample_day, "left")
