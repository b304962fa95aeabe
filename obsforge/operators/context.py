"""Counts of earlier reports on a grid around each sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.dates import day_number
from obsforge.operators.skew import gather

GRID_SIZE = 7  # fixed values: cells per side, and (name, first day back, last day back) of the periods
PERIODS = (("30", 1, 30), ("60", 31, 60), ("90", 61, 90))
GROUP_ROWS = 1 << 16  # samples of a bin that one task takes at most
BIN_REACHES = 2  # days of a bin, in lengths of all periods together
TABLE_CELLS = 1 << 22  # running sums, and about as many reports, that a task holds at a time
FEW_SAMPLES = 4  # fewer samples than this at a position on average are counted one by one
COUNT_CLASSES = {"presence": "PRESENT", "absence": "ABSENT"}

_BINS = ["bx", "by", "bt"]


def grid_cells(samples: DataFrame, lon: str, lat: str, step: float, size: int = GRID_SIZE) -> DataFrame:
    """Each sample with its size x size cells: row and col from 0, centre and corners.

    `step` is in the unit of the coordinates; metres / 111000 gives degrees.
    """
    half = size // 2
    offsets = F.sequence(F.lit(-half), F.lit(half))
    cells = samples.withColumn("__i", F.explode(offsets)).withColumn("__j", F.explode(offsets))
    centre_lon = F.col(lon) + F.col("__j") * F.lit(step)
    centre_lat = F.col(lat) + F.col("__i") * F.lit(step)
    edge = F.lit(step / 2)
    return cells.withColumns(
        {
            "row": F.col("__i") + half,
            "col": F.col("__j") + half,
            "center_lon": centre_lon,
            "center_lat": centre_lat,
            "min_lon": centre_lon - edge,
            "max_lon": centre_lon + edge,
            "min_lat": centre_lat - edge,
            "max_lat": centre_lat + edge,
        }
    ).drop("__i", "__j")


def context_counts(
    samples: DataFrame,
    reports: DataFrame,
    sample_id: str,
    lon: str,
    lat: str,
    day: str,
    presence: str,
    step: float,
    size: int = GRID_SIZE,
    periods=PERIODS,
) -> DataFrame:
    """Presence and absence counts per grid cell and period: one row per cell with any report.

    Cells are half open, so a report on a shared edge counts once. The sample's
    own day is outside every period. See sample_grids for how they are counted.
    """
    cells = _cells_of(sample_grids(samples, reports, sample_id, lon, lat, day, presence, step, size, periods), sample_id, size, periods)
    return cells.where(F.greatest(*count_columns(periods), F.lit(0)) > 0)


def dense_counts(
    samples: DataFrame,
    reports: DataFrame,
    sample_id: str,
    lon: str,
    lat: str,
    day: str,
    presence: str,
    step: float,
    size: int = GRID_SIZE,
    periods=PERIODS,
) -> DataFrame:
    """Every cell of every sample's grid, with zeros where context_counts has no row."""
    return _cells_of(sample_grids(samples, reports, sample_id, lon, lat, day, presence, step, size, periods), sample_id, size, periods)


def _cells_of(grids: DataFrame, sample_id: str, size: int, periods) -> DataFrame:
    names = count_columns(periods)
    each = grids.select(sample_id, "counts", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("__cell"))
    counts = [F.get("counts", F.col("__cell") * len(names) + k).alias(name) for k, name in enumerate(names)]
    return each.select(sample_id, F.floor(F.col("__cell") / size).cast("int").alias("row"), (F.col("__cell") % size).alias("col"), *counts)


def sample_grids(
    samples: DataFrame,
    reports: DataFrame,
    sample_id: str,
    lon: str,
    lat: str,
    day: str,
    presence: str,
    step: float,
    size: int = GRID_SIZE,
    periods=PERIODS,
) -> DataFrame:
    """(sample_id, counts): one row per sample with the counts of its cells, row by row, each as count_columns lists them.

    Positions and days are binned. Reports at one position and day become a
    single row, sent to every bin from which a sample can see it; a bin's samples
    and reports then meet in one task, where reports are added up per position
    of samples, cell and day, and each sample takes differences of running sums.
    So a report is looked at once per position of samples near it, however many
    samples that has. A bin of more than GROUP_ROWS samples is divided over tasks.
    """
    reach = max(last for _, _, last in periods)
    half = size / 2.0
    span = float(step) * GRID_SIZE * -(-size // GRID_SIZE)
    length = reach * BIN_REACHES
    slack = F.lit((half + 0.001) * step)  # the exact cell decides; bins only have to offer enough
    names = list(COUNT_CLASSES.values())

    def place(x: Column, y: Column, t: Column) -> dict[str, Column]:
        return {"bx": F.floor(x / span), "by": F.floor(y / span), "bt": F.floor(t / length)}

    def located(df: DataFrame, *more: str | Column) -> DataFrame:
        at = [F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), day_number(F.col(day)).cast("int").alias("day")]
        return df.select(*more, *at)

    complete = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("day").isNotNull()
    spots = located(samples, F.col(sample_id).alias("id")).withColumns(place(F.col("lon"), F.col("lat"), F.col("day")))
    # A sample without a place or day sees no report; any bin will do for it.
    anywhere = F.pmod(F.xxhash64("id"), F.lit(1024))
    spots = spots.withColumns(
        {b: F.when(complete, F.col(b)).otherwise(anywhere if b == "bx" else F.lit(0)) for b in _BINS}
        | {"lon": F.when(complete, F.col("lon")).otherwise(F.lit(float("nan"))), "lat": F.when(complete, F.col("lat")).otherwise(F.lit(float("nan"))), "day": F.coalesce("day", F.lit(0))}
    )
    rows = spots.groupBy(*_BINS).agg(F.count(F.lit(1)).alias("__rows"))
    large = rows.where(F.col("__rows") > GROUP_ROWS).select(*_BINS, F.ceil(F.col("__rows") / GROUP_ROWS).alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))
    dealt = spots.join(F.broadcast(large), _BINS, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("__parts")

    def touches(first: Column, last: Column, width: float) -> Column:
        return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))

    packed = (
        located(reports.where(F.col(presence).isin(names)), presence)
        .where(complete)
        .groupBy("lon", "lat", "day")
        .agg(*[F.count_if(F.col(presence) == c).alias(f"r_{k}") for k, c in COUNT_CLASSES.items()])
        .withColumn("bx", touches(F.col("lon") - slack, F.col("lon") + slack, span))
        .withColumn("by", touches(F.col("lat") - slack, F.col("lat") + slack, span))
        .withColumn("bt", touches(F.col("day") + 1, F.col("day") + reach, length))
        .join(F.broadcast(large), _BINS, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .drop("__parts")
    )
    group = [*_BINS, "part"]
    left, right = (gather(df, *group).groupBy(*group) for df in (dealt, packed))
    kind = samples.schema[sample_id].dataType.simpleString()
    met = left.cogroup(right).applyInArrow(_counter(float(step), size, tuple(periods), len(COUNT_CLASSES)), f"id {kind}, counts array<bigint>")
    return met.withColumnRenamed("id", sample_id)


def _counter(step: float, size: int, periods: tuple, classes: int):
    """The function that counts the reports of one bin for the samples of that bin."""
    half, cells = size / 2.0, size * size

    def numbers(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("id", left.schema.field("id").type), ("counts", pa.list_(pa.int64()))])
        # distinct positions of either side, by latitude; samples in the order of their positions
        s_at, s_place = np.unique(np.stack([numbers(left, "lat"), numbers(left, "lon")], 1), axis=0, return_inverse=True)
        r_at, r_place = np.unique(np.stack([numbers(right, "lat"), numbers(right, "lon")], 1), axis=0, return_inverse=True)
        s_order = np.argsort(s_place.ravel(), kind="stable")
        s_day = numbers(left, "day").astype(np.int64)[s_order]
        s_first = np.searchsorted(s_place.ravel()[s_order], np.arange(len(s_at) + 1))
        ids = left.column("id").take(pa.array(s_order))
        r_order = np.argsort(r_place.ravel(), kind="stable")
        r_day = numbers(right, "day").astype(np.int64)[r_order]
        r_first = np.searchsorted(r_place.ravel()[r_order], np.arange(len(r_at) + 1))
        r_count = np.stack([numbers(right, c) for c in right.column_names if c.startswith("r_")], 1)[r_order].astype(np.float64)
        start = int(r_day.min()) if len(r_day) else 0
        days = int(r_day.max()) - start + 1 if len(r_day) else 0
        # Where positions have few samples each, reports are put into the periods of every sample at once.
        single = len(s_day) < FEW_SAMPLES * len(s_at)
        if single:
            s_at, s_first = s_at[s_place.ravel()[s_order]], np.arange(len(s_day) + 1)
        width = len(periods) if single else days + 1
        block = max(1, min(64, TABLE_CELLS // (cells * classes * width), TABLE_CELLS // max(1, len(r_day))))
        batches = []
        for begin in range(0, len(s_at), block):
            at = s_at[begin : begin + block]
            n = len(at)
            mine = slice(s_first[begin], s_first[begin + n])
            low, high = (np.searchsorted(r_at[:, 0], x) for x in (at[0, 0] - (half + 1) * step, at[-1, 0] + (half + 1) * step))
            row = np.floor((r_at[None, low:high, 0] - at[:, None, 0]) / step + half)
            col = np.floor((r_at[None, low:high, 1] - at[:, None, 1]) / step + half)
            who, seen = np.nonzero((row >= 0) & (row < size) & (col >= 0) & (col < size))
            cell = who * cells + row[who, seen].astype(np.int64) * size + col[who, seen].astype(np.int64)
            seen += low
            times = r_first[seen + 1] - r_first[seen]
            ends = np.cumsum(times)
            report = np.arange(ends[-1] if len(ends) else 0) + np.repeat(r_first[seen] - ends + times, times)
            if single:
                ago = np.repeat(s_day[mine][who], times) - r_day[report]
                period = np.full(len(ago), -1)
                for k, (first, last) in enumerate((f, t) for _, f, t in periods):
                    period[(ago >= first) & (ago <= last)] = k
                inside = period >= 0
                slot = (np.repeat(cell, times)[inside] * width + period[inside]) * classes
                report = report[inside]
                stride, shape = 1, (n, cells, width, classes)
            else:
                slot = np.repeat(cell * classes * width, times) + r_day[report] - start + 1
                stride, shape = width, (n, cells, classes, width)
            slots = np.concatenate([slot + k * stride for k in range(classes)])
            table = np.bincount(slots, r_count[report].T.ravel(), n * cells * classes * width).reshape(shape)
            found = table
            if not single:
                # running sums by day; before the first day there is nothing
                np.cumsum(table, axis=3, out=table)
                whose = np.repeat(np.arange(n), np.diff(s_first[begin : begin + n + 1]))
                until = [table[whose, :, :, np.clip(s_day[mine] - back - start + 1, 0, days)] for _, f, t in periods for back in (f, t + 1)]
                found = np.stack([x - y for x, y in zip(until[::2], until[1::2])], 2)
            flat = pa.array(found.astype(np.int64).ravel())
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * (cells * classes * len(periods)))
            mine_ids = ids.slice(mine.start, mine.stop - mine.start).combine_chunks()
            batches.append(pa.record_batch([mine_ids, pa.ListArray.from_arrays(offsets, flat)], schema=kind))
        return pa.Table.from_batches(batches, kind)

    return count


def count_columns(periods=PERIODS) -> list[str]:
    return [f"{k}_{name}" for name, _, _ in periods for k in COUNT_CLASSES]


def centre_counts(
    samples: DataFrame,
    reports: DataFrame,
    sample_id: str,
    lon: str,
    lat: str,
    day: str,
    presence: str,
    step: float,
    periods=PERIODS,
) -> DataFrame:
    """The counts of the grid cell the sample itself lies in, one row per sample that has any."""
    one = context_counts(samples, reports, sample_id, lon, lat, day, presence, step, 1, periods)
    return one.select(sample_id, *count_columns(periods))
