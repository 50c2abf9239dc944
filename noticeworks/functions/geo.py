"""Distances and map positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def project(lat: Column, lon: Column, west: float, north: float, squeeze: float = 0.72033, scale: float = 350.7477, pad: float = 8.0) -> Column:
    """Equirectangular position on a map whose corner is given."""
    return F.struct((pad + (lon - west) * squeeze * scale).alias("x"), (pad + (north - lat) * scale).alias("y"))


def radius(count: Column, most: Column) -> Column:
    """A circle whose area goes with the count."""
    return 5 + F.sqrt(F.try_divide(count, most)) * 30


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line with the points left out that lie within ``tolerance`` of what remains; for outlines drawn once, on the driver.

    The farthest point of a stretch from its chord stays if it is farther than that, and parts the stretch in two.
    """
    if len(points) < 3:
        return list(points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        far, at = 0.0, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((by - ay) * (x - ax) - (bx - ax) * (y - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]
