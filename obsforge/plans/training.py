"""Labelled feature rows: lag windows, fallbacks, indices, static layers and neighbouring reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsforge.functions.indices import add_lag_indices, ndwi_proxy
from obsforge.functions.values import as_float, class_label
from obsforge.operators.context import centre_counts, count_columns
from obsforge.operators.lags import LAGS, Band, critical_gate, lag_features, missing_list, with_fallback
from obsforge.operators.skew import splittable_join
from obsforge.sources.catalogue import CRITICAL, DYNAMIC, SOURCES, STATIC, band_for, pair_as_ratio

WIND = ("u_component_of_wind_10m", "v_component_of_wind_10m")
NDWI_BAND = "NDWI"


@dataclass(frozen=True)
class Columns:
    """Names the flow needs. `place` are the key columns samples and measurements share."""

    sample_id: str = "object_id"
    day: str = "obs_date"
    lon: str = "lon"
    lat: str = "lat"
    presence: str = "presence"
    ts: str = "ts"
    place: tuple[str, ...] = ("cell_x", "cell_y")


def environment_bands(sources=SOURCES) -> list[Band]:
    """Lag bands of every source; a variable's second source gets the suffix `_alt`."""
    bands, seen = [], set()
    for source in sources:
        if source.variable == "NDWI_pair":
            continue
        name = source.variable + ("_alt" if source.variable in seen else "")
        seen.add(source.variable)
        bands.append(band_for(source, name))
    first = next(s for s in sources if s.variable == "NDWI_pair")
    rows = (F.col("source") == first.collection) & (F.col("band") == NDWI_BAND)
    bands.append(Band(NDWI_BAND, rows, F.col("value"), "mean"))
    return bands


def with_ndwi_rows(measurements: DataFrame, names: Columns, sources=SOURCES) -> DataFrame:
    """Measurements plus one NDWI row per place and time that has both bands of the pair."""
    nir, swir = [s for s in sources if s.variable == "NDWI_pair"]
    ratio = pair_as_ratio(measurements, list(names.place), names.ts, nir, swir, NDWI_BAND)
    return measurements.select(*ratio.columns).unionByName(ratio)


def environment(
    samples: DataFrame,
    measurements: DataFrame,
    names: Columns = Columns(),
    lags=LAGS,
    critical=CRITICAL,
    sources=SOURCES,
    base: DataFrame | None = None,
    most_missing: int | None = None,
    split_wind: bool = False,
) -> DataFrame:
    """Samples with 11 variables per lag, `missing` (names without any source) and `critical_missing`.

    Missing wind is one name per lag, or with `split_wind` one per component and lag. More than
    `most_missing` names also count as critical.
    """
    wide = lag_features(
        samples,
        with_ndwi_rows(measurements, names, sources),
        list(names.place),
        names.day,
        names.ts,
        environment_bands(sources),
        lags,
        on_missing="zero",
        keep_counts=True,
        base=base,
    )

    def n(band: str, lag: int) -> Column:
        return F.coalesce(F.col(f"n_{band}_{lag}"), F.lit(0))

    values: dict[str, Column] = {}
    absent: dict[str, Column] = {}
    plain = [v for v in DYNAMIC if v not in WIND and v != NDWI_BAND]
    for lag in lags:
        for v in plain:
            values[f"{v}_{lag}"] = F.coalesce(F.col(f"{v}_{lag}"), F.lit(0.0))
            absent[f"{v}_{lag}"] = n(v, lag)
        first = n(WIND[0], lag) + n(WIND[1], lag)
        second = n(WIND[0] + "_alt", lag) + n(WIND[1] + "_alt", lag)
        for w in WIND:
            values[f"{w}_{lag}"] = with_fallback(first, F.col(f"{w}_{lag}"), second, F.col(f"{w}_alt_{lag}"))
        for w in WIND if split_wind else ("Wind",):
            absent[f"{w}_{lag}"] = first + second
        proxy = ndwi_proxy(values[f"EVI_{lag}"], values[f"NDVI_{lag}"])
        values[f"NDWI_{lag}"] = F.when(n(NDWI_BAND, lag) > 0, F.col(f"NDWI_{lag}")).otherwise(proxy)
    marked = wide.select(*samples.columns, *[c.alias(k) for k, c in values.items()], missing_list(absent))
    return marked.withColumn("critical_missing", critical_gate(F.col("missing"), critical, most_missing))


def feature_columns(lags=LAGS) -> list[str]:
    """The 56 features of a row, in export order; the label follows them."""
    return [
        *[f"{v}_{lag}" for v in DYNAMIC for lag in lags],
        *STATIC,
        *[f"{v}_{lag}" for v in ("TCI", "VHI", "TVDI") for lag in lags],
        *count_columns(),
    ]


def build_training_table(
    samples: DataFrame,
    measurements: DataFrame,
    static: DataFrame,
    reports: DataFrame,
    grid_step: float,
    names: Columns = Columns(),
    static_place: tuple[str, ...] | None = None,
    on_missing: str = "zero",
    to_float: bool = False,
) -> DataFrame:
    """One row per sample with every critical variable: id, 56 features, label.

    `samples` are valid observations with the `place` columns and, if they
    differ, the `static_place` columns filled in. `reports` are the observations
    counted around each sample. With on_missing ``drop`` any missing variable
    removes the sample.
    """
    env = environment(samples, measurements, names)
    kept = env.where(~F.col("critical_missing"))
    if on_missing == "drop":
        kept = kept.where(F.size("missing") == 0)
    kept = kept.drop("missing", "critical_missing")
    cell = list(static_place or names.place)
    placed = splittable_join(kept, static.select(*cell, *STATIC), cell)
    indexed = add_lag_indices(placed)
    middle = centre_counts(
        samples, reports, names.sample_id, names.lon, names.lat, names.day, names.presence, grid_step
    )
    full = indexed.join(middle, names.sample_id, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in count_columns()}
    )
    features = feature_columns()
    out = full.select(names.sample_id, *features, class_label(F.col(names.presence)).alias("label"))
    return as_float(out, features) if to_float else out
