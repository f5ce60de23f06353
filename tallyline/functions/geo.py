"""Coordinate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def usable(lat: Column, lon: Column) -> Column:
    """Both present, numbers and different from zero."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (lat != 0) & (lon != 0)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def haversine_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    dlat, dlon = F.radians(lat - F.lit(lat0)), F.radians(lon - F.lit(lon0))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def radius_box(lat0: float, lon0: float, radius_km: float) -> tuple[float, float, float, float]:
    """A box that holds the whole circle: a cheap filter the scan can evaluate first.

    A circle that reaches a pole or the date line gets the full longitude range.
    """
    dlat = math.degrees(radius_km / EARTH_KM) * 1.000001
    top = min(abs(lat0) + dlat, 90.0)
    full = top >= 89.9
    dlon = 360.0 if full else math.degrees(
        math.asin(min(1.0, math.sin(radius_km / EARTH_KM) / math.cos(math.radians(abs(lat0)))))) * 1.000001
    if full or lon0 - dlon < -180 or lon0 + dlon > 180:
        return lat0 - dlat, lat0 + dlat, -360.0, 360.0
    return lat0 - dlat, lat0 + dlat, lon0 - dlon, lon0 + dlon


def grid_index(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(float(cell)))


def rounded_key(value: Column, digits: int = 4) -> Column:
    """Half-even rounding on the scaled double, as an exact grouping key."""
    return F.rint(value * F.lit(float(10 ** digits)))
