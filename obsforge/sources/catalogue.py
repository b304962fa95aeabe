"""What is measured, where it comes from and how it is reduced. All fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsforge.functions.values import rescale
from obsforge.operators.lags import Band

# The columns of an observation table, and the names other inputs use for them.
OBSERVATION_SCHEMA = {
    "OBJECTID": "bigint", "Obs Date": "string", "Year": "int", "Locust Presence": "string",
    "Latitude": "double", "Longitude": "double", "Country": "string",
}
REPORT_RENAMES = {"FINISHDATE": "Obs Date", "LOCPRESENT": "Locust Presence", "lon": "Longitude", "lat": "Latitude", "year": "Year"}


@dataclass(frozen=True)
class Source:
    """A band of a collection, the variable it feeds and its unit conversion."""

    variable: str
    collection: str
    band: str
    reducer: str
    scale: float = 1.0
    offset: float = 0.0


# One row per variable and collection. The wind rows come in a
# first and a second choice; NDWI is a ratio of two bands of one collection.
SOURCES = (
    Source("NDVI", "MODIS/061/MOD13Q1", "NDVI", "mean"),
    Source("EVI", "MODIS/061/MOD13Q1", "EVI", "mean"),
    Source("LST_Day_1km", "MODIS/061/MOD11A2", "LST_Day_1km", "mean"),
    Source("precipitation", "UCSB-CHG/CHIRPS/DAILY", "precipitation", "sum"),
    Source("u_component_of_wind_10m", "ECMWF/ERA5/DAILY", "u_component_of_wind_10m", "mean"),
    Source("v_component_of_wind_10m", "ECMWF/ERA5/DAILY", "v_component_of_wind_10m", "mean"),
    Source("u_component_of_wind_10m", "NCEP_DOE_II/daily_averages", "uwnd_10m", "mean"),
    Source("v_component_of_wind_10m", "NCEP_DOE_II/daily_averages", "vwnd_10m", "mean"),
    Source("sm_surface", "NASA/SMAP/SPL4SMGP/007", "sm_surface", "mean"),
    Source("ET", "MODIS/061/MOD16A2", "ET", "sum"),
    Source("aet", "IDAHO_EPSCOR/TERRACLIMATE", "aet", "sum"),
    Source("pet", "IDAHO_EPSCOR/TERRACLIMATE", "pet", "mean"),
    Source("NDWI_pair", "MODIS/061/MOD09GA", "sur_refl_b02", "mean"),
    Source("NDWI_pair", "MODIS/061/MOD09GA", "sur_refl_b06", "mean"),
)

# The variables of a feature row, in export order.
DYNAMIC = (
    "NDVI", "EVI", "LST_Day_1km", "precipitation", "u_component_of_wind_10m", "v_component_of_wind_10m",
    "sm_surface", "ET", "aet", "pet", "NDWI",
)
STATIC = (
    "elevation", "slope", "aspect", "landcover", "soil_texture", "sand_0_5cm", "sand_5_15cm", "sand_15_30cm",
)
# A sample without one of these is dropped.
CRITICAL = ("NDVI_30", "NDVI_60", "NDVI_90", "LST_Day_1km_30", "LST_Day_1km_60", "LST_Day_1km_90")
# The same for the multi-scale table, where more than this many missing names also drop a sample.
MULTISCALE_CRITICAL = (
    "NDVI_30", "LST_Day_1km_30", "sm_surface_30", "precipitation_30", "u_component_of_wind_10m_30", "elevation",
)
MULTISCALE_MOST_MISSING = 5
# Columns of the tabular export, in order.
TRAINING_CSV = (
    "NDVI", "EVI", "sm_surface", "LST_Day_1km", "Relative_Humidity", "uWindSpeed_10m", "vWindSpeed_10m",
    "precipitation", "elevation", "longitude", "latitude", "label",
)


def is_source(collection: Column, band: Column, source: Source) -> Column:
    return (collection == source.collection) & (band == source.band)


def band_for(source: Source, name: str, collection: str = "source", band: str = "band", value: str = "value") -> Band:
    """The lag band that reads this source from a long measurement table."""
    rows = is_source(F.col(collection), F.col(band), source)
    return Band(name, rows, rescale(F.col(value), source.scale, source.offset), source.reducer)


def pair_as_ratio(measurements, place: list[str], ts: str, first: Source, second: Source, name: str):
    """Normalised difference of two bands measured at the same place and time, as rows of a band `name`."""
    from obsforge.functions.indices import normalised_difference

    def of(source: Source) -> Column:
        return F.max(F.when(F.col("band") == source.band, F.col("value")))

    both = (
        measurements.where((F.col("source") == first.collection) & F.col("band").isin(first.band, second.band))
        .groupBy(*place, ts)
        .agg(of(first).alias("a"), of(second).alias("b"))
    )
    return both.select(
        *place,
        ts,
        F.lit(first.collection).alias("source"),
        F.lit(name).alias("band"),
        normalised_difference(F.col("a"), F.col("b")).alias("value"),
    ).where(F.col("value").isNotNull())
