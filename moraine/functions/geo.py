"""Distances, polygons and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
DEGREE_KM = 111.0
#: The WGS84 ellipsoid and the UTM grid.
A, FLATTENING, SCALE, FALSE_EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def equirect_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat distance, east-west shrunk by the first point's latitude, the short way round."""
    east = F.abs(lon2 - lon1)
    return DEGREE_KM * F.hypot(lat2 - lat1, F.when(east > 180, 360 - east).otherwise(east) * F.cos(F.radians(lat1)))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring of struct<x, y>."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    crossed = F.filter(
        F.arrays_zip(ring.alias("a"), nxt.alias("b")),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], F.lit(1.0)).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment, which may be a point."""
    length2 = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.coalesce(F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), length2), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay)))


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series of sixth order in n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - ((utm_zone(lon) - 1) * 6 - 177))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * radius * east, SCALE * radius * north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of northern UTM coordinates, by the inverse series of third order in n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi0, eta0 = north / (SCALE * radius), (east - FALSE_EAST) / (SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)
