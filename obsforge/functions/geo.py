"""Degrees, cells and great-circle distances on plain longitude/latitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111000.0  # fixed value: one degree, on both axes
EARTH_RADIUS_M = 6371008.8  # mean radius


def degrees(metres: float) -> float:
    return metres / METRES_PER_DEGREE


def cell_index(coordinate: Column, step: float) -> Column:
    return F.floor(coordinate / F.lit(step)).cast("bigint")


def cell_centre(index: Column, step: float) -> Column:
    return (index + F.lit(0.5)) * F.lit(step)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points given in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def reach_lat(metres: float) -> float:
    """Degrees of latitude that cover `metres`; a hair too wide, never too narrow."""
    return metres / (EARTH_RADIUS_M * 3.141592653589793 / 180.0) * 1.000001


def reach_lon(metres: float, lat: Column) -> Column:
    """Degrees of longitude that cover `metres` around a point at `lat`.

    The exact bound of a circle on a sphere; 360 when the circle holds a pole.
    """
    ratio = F.sin(F.lit(metres / EARTH_RADIUS_M)) / F.cos(F.radians(lat))
    return F.when(F.abs(ratio) < 1.0, F.degrees(F.asin(ratio)) * 1.000001).otherwise(360.0)


def bounds_of_buffer(lon: Column, lat: Column, metres: float) -> dict[str, Column]:
    """Box around a point: degree step on latitude, widened by 1/cos(lat) on longitude."""
    dy = F.lit(degrees(metres))
    dx = dy / F.cos(F.radians(lat))
    return {"min_lon": lon - dx, "max_lon": lon + dx, "min_lat": lat - dy, "max_lat": lat + dy}
