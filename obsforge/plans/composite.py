"""Training rows from composites over a whole date range: medians and sums per cell, sampled at report points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.indices import evi, lst_celsius, normalised_difference, relative_humidity
from obsforge.operators.cleaning import in_days
from obsforge.operators.quantiles import exact_median
from obsforge.operators.skew import sieved
from obsforge.operators.spatial import pixel_coordinates, rasterise, sample_cells
from obsforge.sources.catalogue import TRAINING_CSV

CELL = ["cell_x", "cell_y"]
CLOUD_LIMIT = 30.0  # fixed value: scenes with less cloud than this are used
KELVIN = 273.15

# Output column of each median band of the measurement table.
MEDIAN_BANDS = {
    "sm_surface": "sm_surface",
    "LST_Day_1km": "LST_Day_1km",
    "u_component_of_wind_10m": "uWindSpeed_10m",
    "v_component_of_wind_10m": "vWindSpeed_10m",
}


def scene_indices(scenes: DataFrame, cloud_limit: float = CLOUD_LIMIT) -> DataFrame:
    """(cell_x, cell_y, band, value) rows of NDVI and EVI of every clear scene."""
    clear = scenes.where(F.col("cloud") < cloud_limit)
    ndvi = normalised_difference(F.col("B5"), F.col("B4"))
    greenness = evi(F.col("B5"), F.col("B4"), F.col("B2"))
    bands = F.explode(
        F.array(
            F.struct(F.lit("NDVI").alias("band"), ndvi.alias("value")),
            F.struct(F.lit("EVI").alias("band"), greenness.alias("value")),
        )
    )
    return clear.select(*CELL, bands.alias("b")).select(*CELL, "b.band", "b.value").where(F.col("value").isNotNull())


def humidity_rows(measurements: DataFrame, mode: str = "literal") -> DataFrame:
    """Relative humidity of every place and time that has air and dewpoint temperature, both in Kelvin."""

    def of(band: str) -> Column:
        return F.max(F.when(F.col("band") == band, F.col("value")))

    both = (
        measurements.where(F.col("band").isin("temperature_2m", "dewpoint_temperature_2m"))
        .groupBy(*CELL, "ts")
        .agg(of("temperature_2m").alias("t"), of("dewpoint_temperature_2m").alias("d"))
        .where(F.col("t").isNotNull() & F.col("d").isNotNull())
    )
    value = relative_humidity(F.col("t") - KELVIN, F.col("d") - KELVIN, mode)
    return both.select(*CELL, F.lit("Relative_Humidity").alias("band"), value.alias("value"))


def composite_cells(
    scenes: DataFrame, measurements: DataFrame, elevation: DataFrame, start: str, end: str, humidity: str = "literal", wanted: DataFrame | None = None
) -> DataFrame:
    """One row per cell with every composite band; NULL where a band was never measured.

    All median bands go through one exact median keyed by cell and band. `wanted` is a table with the cells that will be
    looked up: all of these have their row, and most others none.
    """
    if wanted is not None:
        scenes, measurements, elevation = (sieved(df, wanted, CELL) for df in (scenes, measurements, elevation))
    seen, measured = (df.where(in_days(F.col("ts"), start, end)) for df in (scenes, measurements))
    stored = measured.where(F.col("band").isin(*MEDIAN_BANDS)).select(
        *CELL,
        F.create_map(*[F.lit(x) for pair in MEDIAN_BANDS.items() for x in pair])[F.col("band")].alias("band"),
        F.when(F.col("band") == "LST_Day_1km", lst_celsius(F.col("value"))).otherwise(F.col("value")).alias("value"),
    )
    long = scene_indices(seen).unionByName(stored).unionByName(humidity_rows(measured, humidity))
    medians = exact_median(long, [*CELL, "band"], "value", "value")
    rain = (
        measured.where(F.col("band") == "precipitation")
        .groupBy(*CELL)
        .agg(F.sum("value").alias("value"))
        .select(*CELL, F.lit("precipitation").alias("band"), "value")
    )
    height = elevation.select(*CELL, F.lit("elevation").alias("band"), F.col("elevation").cast("double").alias("value"))
    names = [c for c in TRAINING_CSV if c not in ("longitude", "latitude", "label")]
    return (
        medians.unionByName(rain)
        .unionByName(height)
        .groupBy(*CELL)
        .agg(*[F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names])
    )


def composite_table(
    cells: DataFrame, reports: DataFrame, points: DataFrame, lon: Column, lat: Column, step: float, keep: list[str]
) -> DataFrame:
    """The tabular export: every point whose cell has all bands, with the cell's label and centre."""
    labelled = pixel_coordinates(rasterise(cells, reports, lon, lat, step), step)
    sampled = sample_cells(points, labelled, lon, lat, step, list(TRAINING_CSV))
    return sampled.select(*keep, *TRAINING_CSV)
