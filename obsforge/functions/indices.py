"""Vegetation, temperature, dryness and suitability indices as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN = 273.15

# Scale weights by season, then the land-cover classes that raise
# one of them and the ceiling of the raised weight.
SEASON_WEIGHTS = {
    "breeding": {"coarse": 0.2, "medium": 0.3, "fine": 0.5},
    "migration": {"coarse": 0.5, "medium": 0.4, "fine": 0.1},
}
CROPLAND_CLASS = 12
BARREN_CLASS = 16
COVER_BONUS = 0.2
COVER_CEILING = 0.6

# Feature groups by band-name pattern (whole name must match).
SCALE_PATTERNS = {
    "coarse": ["temp_era5_.*", "precip_era5_.*", "u_wind_era5_.*", "v_wind_era5_.*", "seasonal_.*", "biome_id",
               "temp_.*_mean", "prec_.*_mean"],
    "medium": ["NDVI_.*", "EVI_.*", "LST_Day_.*", "precipitation_.*", "sm_surface_.*", "u_component_of_wind_10m_.*",
               "v_component_of_wind_10m_.*", "NDWI_.*", "VHI_.*", "TVDI_.*", "TCI_.*"],
    "fine": ["fine_.*", "texture_.*", "patch_density", "shannon_diversity"],
}

# Weights of the suitability index; elevation is scaled before it is weighted.
SUITABILITY_WEIGHTS = {"NDVI_.*": 0.3, "LST_Day_.*": 0.2, "sm_surface_.*": 0.2, "precipitation_.*": 0.2}
ELEVATION_SCALE = 0.1
ELEVATION_WEIGHT = 0.1


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL when either input is negative or the sum is zero."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.lit(2.5) * F.try_divide(nir - red, nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0))


def tci(lst: Column) -> Column:
    return (lst - KELVIN) * 0.1


def vhi(ndvi: Column, tci_value: Column) -> Column:
    return ndvi * 0.5 + tci_value * 0.5


def tvdi(lst: Column, ndvi: Column) -> Column:
    return F.try_divide(lst - KELVIN, ndvi * 10.0 + KELVIN)


def tvdi_region(lst: Column, ndvi: Column, lst_min: Column) -> Column:
    """Dryness against the coldest value of a region and a linear dry edge."""
    return F.try_divide(lst - lst_min, ndvi * 50.0 + KELVIN - lst_min)


def ndwi_proxy(evi_value: Column, ndvi: Column) -> Column:
    return (evi_value - ndvi) * 0.5 + 0.5


def lst_celsius(stored: Column) -> Column:
    return stored * 0.02 - KELVIN


def relative_humidity(temperature: Column, dewpoint: Column, mode: str = "literal") -> Column:
    """Humidity from Celsius temperatures.

    ``literal`` applies the exponential to the whole product, as existing
    tables were made: it overflows to Infinity for a spread under about 21
    degrees. ``approx`` is the linear rule 100 - 5 (T - Td).
    """
    spread = temperature - dewpoint
    if mode == "approx":
        return F.lit(100.0) - spread * 5.0
    return F.exp((F.lit(112.0) - spread * 5.0) * 100.0) / 100.0


def matching_columns(columns: Iterable[str], patterns: str | Iterable[str]) -> list[str]:
    """Columns whose whole name matches any pattern, in table order."""
    compiled = [re.compile(p) for p in ([patterns] if isinstance(patterns, str) else patterns)]
    return [c for c in columns if any(p.fullmatch(c) for p in compiled)]


def row_mean(columns: list[str]) -> Column:
    """Mean over columns of one row; NULL if any of them is NULL."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return total / F.lit(float(len(columns)))


def scale_weights(season: Column, landcover: Column) -> dict[str, Column]:
    """Weights of the coarse, medium and fine groups; they are not renormalised."""
    base = {
        scale: F.when(season == "breeding", SEASON_WEIGHTS["breeding"][scale]).otherwise(
            SEASON_WEIGHTS["migration"][scale]
        )
        for scale in ("coarse", "medium", "fine")
    }
    raised = {s: F.least(base[s] + COVER_BONUS, F.lit(COVER_CEILING)) for s in ("coarse", "fine")}
    return {
        "coarse": F.when(landcover == BARREN_CLASS, raised["coarse"]).otherwise(base["coarse"]),
        "medium": base["medium"],
        "fine": F.when(landcover == CROPLAND_CLASS, raised["fine"]).otherwise(base["fine"]),
    }


def weighted_groups(
    df: DataFrame, weights: Mapping[str, Column], patterns: Mapping[str, list[str]] = SCALE_PATTERNS, suffix: str = "_w"
) -> DataFrame:
    """Append `<name>_w` for every column a group matches, multiplied by the group's weight."""
    added = {
        c + suffix: F.col(c) * weights[group]
        for group, group_patterns in patterns.items()
        for c in matching_columns(df.columns, group_patterns)
    }
    return df.withColumns(added)


def suitability(df: DataFrame, elevation: str = "elevation") -> Column:
    """Weighted mean of the matched bands, clamped to [0, 1]; NaN counts as 0."""
    score = F.lit(0.0)
    for pattern, weight in SUITABILITY_WEIGHTS.items():
        names = matching_columns(df.columns, pattern)
        if names:
            score = score + row_mean(names) * weight
    score = score + F.col(elevation) * ELEVATION_SCALE * ELEVATION_WEIGHT
    return F.least(F.greatest(F.nanvl(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def add_lag_indices(df: DataFrame, lags: Iterable[int] = (30, 60, 90)) -> DataFrame:
    """TCI, VHI and TVDI for each lag, from NDVI_<lag> and LST_Day_1km_<lag>."""
    added = {}
    for lag in lags:
        lst, ndvi = F.col(f"LST_Day_1km_{lag}"), F.col(f"NDVI_{lag}")
        added[f"TCI_{lag}"] = tci(lst)
        added[f"VHI_{lag}"] = vhi(ndvi, tci(lst))
        added[f"TVDI_{lag}"] = tvdi(lst, ndvi)
    return df.withColumns(added)
