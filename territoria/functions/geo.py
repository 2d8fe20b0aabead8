"""Geometry as Column expressions: distances, Lambert-93, ray casting, segment distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, col

# GRS80 ellipsoid and the Lambert-93 definition.
_A, _INV_F = 6378137.0, 298.257222101
_PHI0, _PHI1, _PHI2, _LON0, _X0, _Y0 = 46.5, 44.0, 49.0, 3.0, 700000.0, 6600000.0
_E = math.sqrt(2 / _INV_F - 1 / _INV_F**2)


def _iso_py(deg: float) -> float:
    s = math.sin(math.radians(deg))
    return math.atanh(s) - _E * math.atanh(_E * s)


def _radius_py(deg: float) -> float:
    r = math.radians(deg)
    return _A * math.cos(r) / math.sqrt(1 - (_E * math.sin(r)) ** 2)


_N = math.log(_radius_py(_PHI1) / _radius_py(_PHI2)) / (_iso_py(_PHI2) - _iso_py(_PHI1))
_C = _radius_py(_PHI1) / _N * math.exp(_N * _iso_py(_PHI1))
_YS = _Y0 + _C * math.exp(-_N * _iso_py(_PHI0))


def to_lambert93(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    s = F.sin(F.radians(col(lat)))
    iso = F.atanh(s) - _E * F.atanh(_E * s)
    r = _C * F.exp(-_N * iso)
    theta = _N * F.radians(col(lon) - _LON0)
    return _X0 + r * F.sin(theta), _YS - r * F.cos(theta)


def from_lambert93(x: ColumnLike, y: ColumnLike, rounds: int = 6) -> tuple[Column, Column]:
    dx, dy = col(x) - _X0, _YS - col(y)
    lon = _LON0 + F.degrees(F.atan2(dx, dy) / _N)
    iso = -F.ln(F.hypot(dx, dy) / _C) / _N
    phi = 2 * F.atan(F.exp(iso)) - math.pi / 2
    for _ in range(rounds):
        phi = 2 * F.atan(F.exp(iso + _E * F.atanh(_E * F.sin(phi)))) - math.pi / 2
    return lon, F.degrees(phi)


def haversine_km(lon1: ColumnLike, lat1: ColumnLike, lon2: ColumnLike, lat2: ColumnLike) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def plane_km(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    """Pseudo-metric plane: (lon*111*cos lat, lat*111)."""
    return col(lon) * 111.0 * F.cos(F.radians(col(lat))), col(lat) * 111.0


def bbox(lon: ColumnLike, lat: ColumnLike, west: float, south: float, east: float, north: float) -> Column:
    return col(lon).between(west, east) & col(lat).between(south, north)


def inside_ring(lon: ColumnLike, lat: ColumnLike, ring: ColumnLike) -> Column:
    """Even-odd ray casting."""
    x, y = col(lon), col(lat)

    def crosses(e: Column) -> Column:
        a, b = e["0"], e["1"]
        spans = (a["lat"] > y) != (b["lat"] > y)
        cut = (b["lon"] - a["lon"]) * (y - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.coalesce(spans & (x < cut), F.lit(False))

    return F.aggregate(ring_edges(ring), F.lit(False), lambda acc, e: acc != crosses(e))


def ring_edges(ring: ColumnLike) -> Column:
    ring = col(ring)
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("0"), F.element_at(ring, F.pmod(i + 1, n) + 1).alias("1")))


def ring_distance(lon: ColumnLike, lat: ColumnLike, ring: ColumnLike) -> Column:
    """Smallest planar distance to the ring's edges, in the ring's own units."""
    x, y = col(lon), col(lat)

    def dist(e: Column) -> Column:
        a, b = e["0"], e["1"]
        ux, uy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        length2 = ux * ux + uy * uy
        t = F.when(length2 > 0, F.least(F.greatest(((x - a["lon"]) * ux + (y - a["lat"]) * uy) / length2,
                                                   F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.hypot(x - a["lon"] - t * ux, y - a["lat"] - t * uy)

    return F.array_min(F.transform(ring_edges(ring), dist))


def ring_bounds(ring: ColumnLike) -> dict[str, Column]:
    ring = col(ring)
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return {"west": F.array_min(lons), "east": F.array_max(lons), "south": F.array_min(lats), "north": F.array_max(lats)}


def ring_area(ring: ColumnLike) -> Column:
    """Shoelace area, absolute value."""
    parts = F.transform(ring_edges(ring), lambda e: e["0"]["lon"] * e["1"]["lat"] - e["1"]["lon"] * e["0"]["lat"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)) / 2
