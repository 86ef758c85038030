"""Web-Mercator on the unit square, as column expressions and as scalars for bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fround(c: Column) -> Column:
    """Rounded to 32-bit precision, kept as a double."""
    return c.cast("float").cast("double")


def lng_x(lng: Column) -> Column:
    return lng / 360.0 + 0.5


def lat_y(lat: Column) -> Column:
    """Clamped to [0, 1]; beyond 86 degrees it is the clamp, which spares the poles' division by zero."""
    s = F.sin(lat * math.pi / 180.0)
    y = 0.5 - 0.25 * F.ln((1.0 + s) / (1.0 - s)) / math.pi
    return F.when(lat >= 86.0, 0.0).when(lat <= -86.0, 1.0).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))


def x_lng(x: Column) -> Column:
    return (x - 0.5) * 360.0


def y_lat(y: Column) -> Column:
    return 360.0 * F.atan(F.exp((180.0 - y * 360.0) * math.pi / 180.0)) / math.pi - 90.0


def lng_x_of(lng: float) -> float:
    return lng / 360.0 + 0.5


def lat_y_of(lat: float) -> float:
    if abs(lat) >= 86.0:
        return 0.0 if lat > 0 else 1.0
    s = math.sin(lat * math.pi / 180.0)
    return min(1.0, max(0.0, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi))
