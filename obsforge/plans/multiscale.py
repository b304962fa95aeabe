"""Coarse, medium and fine features weighted by season and land cover, and the suitability index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsforge.functions.dates import season, seasonal_cycle
from obsforge.functions.indices import add_lag_indices, normalised_difference, scale_weights, suitability, weighted_groups
from obsforge.functions.values import class_label
from obsforge.operators.context import centre_counts, count_columns
from obsforge.operators.lags import Band, critical_gate, frame_features, window_median
from obsforge.operators.landscape import LANDSCAPE_RADIUS_M, landscape_metrics
from obsforge.operators.skew import splittable_join
from obsforge.operators.spatial import near_places, polygon_attribute
from obsforge.plans.training import Columns, environment
from obsforge.sources.catalogue import MULTISCALE_CRITICAL, MULTISCALE_MOST_MISSING, STATIC

# Climate bands of the coarse scale, their output prefix, and its two windows.
COARSE_BANDS = {
    "mean_2m_air_temperature": "temp_era5",
    "total_precipitation": "precip_era5",
    "u_component_of_wind_10m": "u_wind_era5",
    "v_component_of_wind_10m": "v_wind_era5",
}
COARSE_COLLECTION = "ECMWF/ERA5/DAILY"
COARSE_LAGS = (30, 90)
CLIMATE = ("temp_jan_mean", "temp_jul_mean", "prec_jan_mean", "prec_jul_mean")
# Bands of the two fine-scale sources (near infrared, red, green, red edge), cloud limit, window.
FINE_FIRST = {"nir": "B8", "red": "B4", "green": "B3", "edge": "B5"}
FINE_SECOND = {"nir": "SR_B5", "red": "SR_B4", "green": "SR_B3"}
FINE_CLOUD = 20.0
FINE_FRAME = (-30, -1)
FINE = (
    "fine_ndvi", "fine_ndwi", "fine_rededge", "texture_contrast", "texture_correlation", "texture_entropy",
    "texture_variance", "patch_density", "shannon_diversity",
)


def coarse_features(
    samples: DataFrame, measurements: DataFrame, place: list[str], day: str, ts: str
) -> DataFrame:
    """Climate means over 30 and 90 days, zero without rows, and the seasonal cycle."""
    bands = [
        Band(out, (F.col("source") == COARSE_COLLECTION) & (F.col("band") == band), F.col("value"), "mean")
        for band, out in COARSE_BANDS.items()
    ]
    frames = {str(lag): (-lag, -1) for lag in COARSE_LAGS}
    wide = frame_features(samples, measurements, place, day, ts, bands, frames, on_missing="zero")
    cosine, sine = seasonal_cycle(F.col(day))
    return wide.withColumns({"seasonal_cos": cosine, "seasonal_sin": sine})


def with_biome(
    samples: DataFrame, edges: DataFrame, lon: str, lat: str, strip: float, attribute: str = "biome_id", base: DataFrame | None = None
) -> DataFrame:
    return polygon_attribute(samples, edges, lon, lat, "poly_id", attribute, strip, base)


def fine_indices(
    samples: DataFrame, first: DataFrame, second: DataFrame, place: list[str], day: str, ts: str, base: DataFrame | None = None
) -> DataFrame:
    """Append fine_ndvi, fine_ndwi and fine_rededge: ratios of the medians of the last 30 days.

    Clear scenes of the first source are used when there are any, else the
    second source (which has no red edge), else zeros.
    """
    one, two = FINE_FIRST, FINE_SECOND
    clear = first.where(F.col("cloud") < FINE_CLOUD)
    a = window_median(samples, clear, place, day, ts, list(one.values()), FINE_FRAME, base or samples)
    both = window_median(a, second, place, day, ts, list(two.values()), FINE_FRAME, base or samples)

    def m(band: str):
        return F.col(f"{band}_median")

    has_first, has_second = m(one["nir"]).isNotNull(), m(two["nir"]).isNotNull()

    def pick(x, y):
        return F.when(has_first, x).when(has_second, y).otherwise(F.lit(0.0))

    added = {
        "fine_ndvi": pick(
            normalised_difference(m(one["nir"]), m(one["red"])), normalised_difference(m(two["nir"]), m(two["red"]))
        ),
        "fine_ndwi": pick(
            normalised_difference(m(one["green"]), m(one["nir"])), normalised_difference(m(two["green"]), m(two["nir"]))
        ),
        "fine_rededge": pick(normalised_difference(m(one["nir"]), m(one["edge"])), F.lit(0.0)),
    }
    return both.withColumns(added).drop(*[f"{b}_median" for b in (*one.values(), *two.values())])


def attach_cells(
    samples: DataFrame, cells: DataFrame, keys: list[str], columns: list[str], base: DataFrame | None = None
) -> DataFrame:
    """Cell-level features (texture, landscape, climate) for each sample; zero where the cell has none."""
    joined = splittable_join(samples, cells.select(*keys, *columns), keys)
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def landscape_around(
    samples: DataFrame, cells: DataFrame, lon: str, lat: str, cell_lon: str, cell_lat: str, landcover: str, metres: float = LANDSCAPE_RADIUS_M
) -> DataFrame:
    """Patch density and Shannon diversity of the land-cover cells whose centre lies in a circle around each sample.

    Every position is looked up once, however many samples it has; a circle without cells has zeros.
    Coordinates are degrees. The cell columns must have names that the samples lack.
    """
    places = samples.select(F.col(lon).alias("__lon"), F.col(lat).alias("__lat")).distinct()
    inside = near_places(places, cells.select(cell_lon, cell_lat, landcover), metres, "__lon", "__lat", cell_lon, cell_lat)
    found = landscape_metrics(inside, ["__lon", "__lat"], landcover, metres)
    renamed = found.withColumnsRenamed({"__lon": lon, "__lat": lat})
    return attach_cells(samples, renamed, [lon, lat], ["patch_density", "shannon_diversity"], samples)


@dataclass(frozen=True)
class Scales:
    """The tables of the three scales.

    climate: long climate measurements by place; measured: long measurements by place; edges: polygon edges with a
    biome_id; static: one row per cell with CLIMATE and STATIC; cover: land-cover cells with centres in degrees;
    scenes: the two fine sources; texture: one row of texture per scene place; reports: what is counted around a sample.
    """

    climate: DataFrame
    measured: DataFrame
    edges: DataFrame
    static: DataFrame
    cover: DataFrame
    first: DataFrame
    second: DataFrame
    texture: DataFrame
    reports: DataFrame


def multiscale_features(
    samples: DataFrame, scales: Scales, names: Columns, cell: list[str], scene_place: list[str], scene_day: str, degrees: tuple[str, str], grid_step: float, strip: float
) -> DataFrame:
    """One row per sample that passes the gate: coarse, medium, fine and context features, side by side.

    The gate is MULTISCALE_CRITICAL, with the static layers among the names, and MULTISCALE_MOST_MISSING.
    """
    rows = coarse_features(samples, scales.climate, list(names.place), names.day, names.ts)
    rows = with_biome(rows, scales.edges, names.lon, names.lat, strip, base=samples)
    rows = environment(rows, scales.measured, names, critical=(), base=samples, split_wind=True).drop("critical_missing")
    layers = [c for c in (*CLIMATE, *STATIC) if c in scales.static.columns]
    rows = splittable_join(rows, scales.static.select(*cell, *layers), cell)
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in STATIC if c in layers]))
    rows = rows.withColumn("missing", F.concat("missing", lost))
    rows = rows.where(~critical_gate(F.col("missing"), MULTISCALE_CRITICAL, MULTISCALE_MOST_MISSING)).drop("missing")
    rows = add_lag_indices(rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLIMATE if c in layers}))
    dated = samples.select(names.sample_id, *scene_place, F.col(scene_day).alias("fine_day"))
    fine = fine_indices(dated, scales.first, scales.second, scene_place, "fine_day", names.ts)
    rows = rows.join(fine.drop(*scene_place, "fine_day"), names.sample_id, "left")
    textures = [c for c in FINE if c.startswith("texture_")]
    rows = attach_cells(rows, scales.texture, scene_place, textures, samples)
    rows = landscape_around(rows, scales.cover, *degrees, "cover_lon", "cover_lat", "cover")
    middle = centre_counts(samples, scales.reports, names.sample_id, names.lon, names.lat, names.day, names.presence, grid_step)
    return rows.join(middle, names.sample_id, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in count_columns()})


def integrate(features: DataFrame, day: str, landcover: str, presence: str) -> DataFrame:
    """Append the weighted copies, the suitability index and the label."""
    weights = scale_weights(season(F.col(day)), F.col(landcover))
    index = suitability(features)
    weighted = weighted_groups(features, weights)
    return weighted.withColumns(
        {"habitat_suitability_index": index, "label": class_label(F.col(presence))}
    )
