"""Geodesy and geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def bounded_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; the argument of asin is held at 1."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial direction in degrees true, 0 to below 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def moved(lat: Column, lon: Column, direction: Column, metres: Column) -> tuple[Column, Column]:
    """The position so many metres away on the sphere."""
    p, t, d = F.radians(lat), F.radians(direction), metres / EARTH_M
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    east = F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), lon + F.degrees(east)


def ground_range(slant: Column, height: Column) -> Column:
    return bounded_sqrt(slant * slant - height * height)


def layback(cable: Column, depth: Column, tow_point_height_m: float = 0.0, antenna_m: float = 0.0) -> Column:
    """Straight-cable distance of the towfish astern; null where the cable length is missing or not positive."""
    down = depth - tow_point_height_m
    return F.when(cable > 0, bounded_sqrt(cable * cable - down * down) + antenna_m)


def uncertainty(ground_m: Column, altitude: Column, speed: Column, layback_m: Column, estimated: Column, resolution_m: float = 0.1) -> Column:
    """Root of the sum of squares of six error terms, 2 decimals; a missing input adds nothing."""
    size = lambda x: F.coalesce(F.abs(x), F.lit(0.0))
    terms = [
        F.lit(2.0),
        F.when(estimated, size(layback_m) * 0.1).otherwise(0.0),
        size(ground_m) * math.sin(math.radians(2.0)),
        0.5 * size(altitude) / F.greatest(size(ground_m), F.lit(1.0)),
        size(speed) * 0.2,
        F.lit(resolution_m / math.sqrt(12) * math.sqrt(2)),
    ]
    total = F.lit(0.0)
    for t in terms:
        total += t * t
    return F.round(F.sqrt(total), 2)


def utm_epsg(lat: Column, lon: Column) -> Column:
    """326xx or 327xx; null beyond 80 S to 84 N."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return F.when(lat.between(-80, 84), F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with whole hundredths, and the hemisphere."""
    total = F.bround(F.abs(value) * 360000, 0).cast("long")
    return F.format_string("%02d° %02d' %02d.%02d\" %s", (total / 360000).cast("long"), (total % 360000 / 6000).cast("long"), (total % 6000 / 100).cast("long"), total % 100, F.when(value >= 0, positive).otherwise(negative))


def closed_ring(footprint: Column) -> Column:
    """The [lat, lon] corners as a closed counter-clockwise ring of [lon, lat]; null below three corners."""
    n = F.size(footprint)
    nxt = F.concat(F.slice(footprint, 2, 1_000_000), F.slice(footprint, 1, 1))
    twice = F.aggregate(F.zip_with(footprint, nxt, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda s, x: s + x)
    ring = F.when(twice < 0, F.reverse(footprint)).otherwise(footprint)
    return F.when(n >= 3, F.concat(ring, F.slice(ring, 1, 1)))


def _krueger() -> tuple[float, tuple[float, ...], tuple[float, ...]]:
    """The rectifying radius of WGS84 and the third-order series of the transverse Mercator projection, forth and back."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return radius, forth, back


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) on WGS84, northern grid (negative south of the equator), to well under a millimetre in a zone."""
    radius, forth, _ = _krueger()
    f = 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    p, d = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    x, y = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    north, east = x, y
    for j, a in enumerate(forth, 1):
        north += a * F.sin(2 * j * x) * F.cosh(2 * j * y)
        east += a * F.cos(2 * j * x) * F.sinh(2 * j * y)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def from_utm(easting: Column, northing: Column, zone: Column) -> tuple[Column, Column]:
    """(lat, lon) of a grid position; the conformal latitude is turned back by its series."""
    radius, _, back = _krueger()
    f = 1 / 298.257223563
    n = f / (2 - f)
    x, y = northing / (0.9996 * radius), (easting - 500000) / (0.9996 * radius)
    a, b = x, y
    for j, c in enumerate(back, 1):
        a -= c * F.sin(2 * j * x) * F.cosh(2 * j * y)
        b -= c * F.cos(2 * j * x) * F.sinh(2 * j * y)
    chi = F.asin(F.sin(a) / F.cosh(b))
    turned = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    lat = chi
    for j, c in enumerate(turned, 1):
        lat += c * F.sin(2 * j * chi)
    return F.degrees(lat), (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(b), F.cos(a)))
