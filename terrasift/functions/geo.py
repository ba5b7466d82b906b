"""Distances, projections, boxes and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in miles that different parts of the planning model use (fixed values).
MILES, MILES_EVALUATION, MILES_ZONES = 3959.0, 3958.8, 3958.7613
#: Miles a degree of latitude, in gaussian kernels and in the Manhattan distance (fixed values).
MILES_PER_DEGREE, MANHATTAN_LAT, MANHATTAN_LON = 69.13, 69.0, 54.6
METRES_PER_MILE = 1609.344


def num(x) -> Column:
    """A column or number as DOUBLE, so that no literal is taken for a decimal."""
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = MILES) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(num(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2.0), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2.0), F.lit(2.0))
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a)))


def haversine_asin(lat1, lon1, lat2, lon2, radius: float = MILES) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(num(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2.0), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2.0), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def manhattan(lat1, lon1, lat2, lon2) -> Column:
    return F.abs(num(lat1) - num(lat2)) * MANHATTAN_LAT + F.abs(num(lon1) - num(lon2)) * MANHATTAN_LON


def miles_to_degrees(miles, lat) -> tuple[Column, Column]:
    """(degrees of latitude, degrees of longitude) at a latitude."""
    return num(miles) / MANHATTAN_LAT, num(miles) / (F.lit(MANHATTAN_LAT) * F.cos(F.radians(num(lat))))


def planar_miles(lat, lon, lat0, lon0, at) -> tuple[Column, Column]:
    """Offsets (east, north) in miles on a plane whose scale is that of latitude `at`."""
    return (num(lon) - num(lon0)) * MILES_PER_DEGREE * F.cos(F.radians(num(at))), (num(lat) - num(lat0)) * MILES_PER_DEGREE


def projected(lat, lon, lat0: float = 37.5) -> tuple[Column, Column]:
    """Local equirectangular metres (x, y)."""
    k = math.pi / 180.0 * 6_371_000.0
    return num(lon) * F.lit(k * math.cos(math.radians(lat0))), num(lat) * F.lit(k)


def geographic(x, y, lat0: float = 37.5) -> tuple[Column, Column]:
    """(lat, lon) of `projected` metres."""
    k = math.pi / 180.0 * 6_371_000.0
    return num(y) / F.lit(k), num(x) / F.lit(k * math.cos(math.radians(lat0)))


def in_box(lat, lon, lat1: float, lat2: float, lon1: float, lon2: float) -> Column:
    """Closed box."""
    return num(lat).between(lat1, lat2) & num(lon).between(lon1, lon2)


def first_box(lat, lon, boxes: list[tuple[str, float, float, float, float]], default: str = "Unknown") -> Column:
    """The name of the first closed box (name, lon1, lat1, lon2, lat2) that holds the point."""
    out = F.lit(default)
    for name, lon1, lat1, lon2, lat2 in reversed(boxes):
        out = F.when(in_box(lat, lon, lat1, lat2, lon1, lon2), F.lit(name)).otherwise(out)
    return out


def in_polygon(x, y, ring: list[tuple[float, float]]) -> Column:
    """Ray casting for a fixed ring; points on an edge fall to one side by the half-open rule."""
    x, y = num(x), num(y)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
            crossings = crossings + F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at), 1).otherwise(0)
    return (crossings % 2) == 1


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Planar distance of a point from a segment."""
    px, py, x1, y1, x2, y2 = (num(v) for v in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    return F.sqrt(F.pow(px - (x1 + t * dx), F.lit(2.0)) + F.pow(py - (y1 + t * dy), F.lit(2.0)))


def sigma_miles(lat, lon) -> Column:
    """Spread of a seed by the box it lies in (fixed values)."""
    return (
        F.when(in_box(lat, lon, 38.3, 39.5, -77.5, -77.0), 1.86)
        .when(in_box(lat, lon, 36.5, 37.5, -77.0, -75.5), 2.17)
        .when(in_box(lat, lon, 37.2, 37.8, -77.8, -77.1), 2.17)
        .otherwise(3.73)
    )
