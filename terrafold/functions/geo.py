"""Bounding boxes, WKT text and great-circle distance as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value
MIN_AREA = 1e-9  # fixed value: floor of the area an overlap is divided by


class Box(NamedTuple):
    """Four columns of an axis-parallel lon/lat box."""

    min_lon: Column
    min_lat: Column
    max_lon: Column
    max_lat: Column

    @classmethod
    def named(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(prefix + name) for name in cls._fields))

    @classmethod
    def literal(cls, values) -> "Box":
        return cls(*(F.lit(float(v)) for v in values))

    def known(self) -> Column:
        return (
            self.min_lon.isNotNull() & self.min_lat.isNotNull() & self.max_lon.isNotNull() & self.max_lat.isNotNull()
        )

    def area(self) -> Column:
        return (self.max_lon - self.min_lon) * (self.max_lat - self.min_lat)

    def centre(self) -> tuple[Column, Column]:
        return (self.min_lon + self.max_lon) / 2, (self.min_lat + self.max_lat) / 2

    def aliased(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self)]


def intersection(a: Box, b: Box) -> Box:
    return Box(
        F.greatest(a.min_lon, b.min_lon),
        F.greatest(a.min_lat, b.min_lat),
        F.least(a.max_lon, b.max_lon),
        F.least(a.max_lat, b.max_lat),
    )


def intersection_area(a: Box, b: Box) -> Column:
    """Shared area; touching or disjoint boxes share 0."""
    i = intersection(a, b)
    empty = (i.min_lon >= i.max_lon) | (i.min_lat >= i.max_lat)
    return F.when(empty, F.lit(0.0)).otherwise(i.area())


def boxes_touch(a: Box, b: Box) -> Column:
    """True when the boxes share at least one point (edges count)."""
    return (
        (a.max_lon >= b.min_lon) & (a.min_lon <= b.max_lon) & (a.max_lat >= b.min_lat) & (a.min_lat <= b.max_lat)
    )


def overlap_ratio(candidate: Box, query: Box) -> Column:
    return intersection_area(candidate, query) / F.greatest(candidate.area(), F.lit(MIN_AREA))


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    union = a.area() + b.area() - inter
    return F.when((inter > 0) & (union > 0), F.try_divide(inter, union)).otherwise(F.lit(0.0))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))  # rounding may pass 1 at the antipode


def point_to_box_degrees(lon: Column, lat: Column, box: Box) -> Column:
    """Planar distance in degrees from a point to a box (0 inside)."""
    zero = F.lit(0.0)
    dx = F.greatest(box.min_lon - lon, zero, lon - box.max_lon)
    dy = F.greatest(box.min_lat - lat, zero, lat - box.max_lat)
    return F.sqrt(dx * dx + dy * dy)


def wkt_box(wkt: Column) -> Column:
    """``struct<min_lon,min_lat,max_lon,max_lat>`` of the outer ring, else null."""
    ring = F.regexp_extract(wkt, r"(?i)POLYGON\s*\(\(([^)]+)\)\)", 1)
    points = F.filter(
        F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2
    )
    lon = F.transform(points, lambda p: F.get(p, 0).try_cast("double"))
    lat = F.transform(points, lambda p: F.get(p, 1).try_cast("double"))
    numeric = ~F.exists(lon, lambda v: v.isNull()) & ~F.exists(lat, lambda v: v.isNull())
    box = F.struct(
        F.array_min(lon).alias("min_lon"),
        F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"),
        F.array_max(lat).alias("max_lat"),
    )
    return F.when((F.size(points) > 0) & numeric, box)


def polygon_box(coordinates: Column) -> Column:
    """Box struct of the first ring of GeoJSON-like coordinates, null when empty."""
    ring = F.get(coordinates, 0)
    lon = F.transform(ring, lambda p: F.get(p, 0))
    lat = F.transform(ring, lambda p: F.get(p, 1))
    box = F.struct(
        F.array_min(lon).alias("min_lon"),
        F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"),
        F.array_max(lat).alias("max_lat"),
    )
    return F.when(F.size(ring) > 0, box)


def box_wkt(box: Box) -> Column:
    """Closed five-point polygon text, counter-clockwise from the lower left corner."""
    corners = [
        (box.min_lon, box.min_lat),
        (box.max_lon, box.min_lat),
        (box.max_lon, box.max_lat),
        (box.min_lon, box.max_lat),
        (box.min_lon, box.min_lat),
    ]
    points = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners]
    return F.when(box.known(), F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *points), F.lit("))")))


def box_around(lon: Column, lat: Column, buffer: float) -> Box:
    return Box(lon - buffer, lat - buffer, lon + buffer, lat + buffer)
