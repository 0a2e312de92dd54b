"""Coordinate systems of layers, as column expressions: transverse Mercator by Krueger's
series (to the fourth power of the third flattening, which is below a micrometre in a
zone), and the seven-parameter shift between two datums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80 ellipsoid, and the grid of the zones.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0
#: Shift in metres, rotation of the frame in seconds of arc, scale in parts per million, from EPSG:4283 to EPSG:7844.
SHIFT, ROTATION, PPM = (0.06155, -0.01087, -0.04019), (-0.0394924, -0.0327221, -0.0328979), -0.009994
#: Geographic systems; EPSG:4326 counts as the newer of the two.
NEWER, OLDER = (4326, 7844), (4283,)

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E2 = FLATTENING * (2 - FLATTENING)
#: The series' coefficients.
FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
INVERSE = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def zone_of(crs: int) -> tuple[int | None, bool]:
    """The zone of a system, if it has one, and whether it is of the older datum; raises for others."""
    for first, older in ((28300, True), (7800, False)):
        if 49 <= crs - first <= 56:
            return crs - first, older
    if crs in (*NEWER, *OLDER):
        return None, crs in OLDER
    raise ValueError(f"EPSG:{crs} is not supported; systems are 4326, 7844, 4283, 7849 to 7856 and 28349 to 28356")


def _series(coefficients: list[float], a: Column, b: Column, f, g) -> Column:
    return sum((c * f(2 * k * a) * g(2 * k * b) for k, c in enumerate(coefficients, 1)), F.lit(0.0))


def to_grid(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a zone, in metres."""
    e, off, s = math.sqrt(_E2), F.radians(lon - F.lit(zone * 6.0 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    return EAST + SCALE * _RADIUS * (eta + _series(FORWARD, xi, eta, F.cos, F.sinh)), NORTH + SCALE * _RADIUS * (xi + _series(FORWARD, xi, eta, F.sin, F.cosh))


def from_grid(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = (north - NORTH) / (SCALE * _RADIUS), (east - EAST) / (SCALE * _RADIUS)
    x, y = xi - _series(INVERSE, xi, eta, F.sin, F.cosh), eta - _series(INVERSE, xi, eta, F.cos, F.sinh)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((c * F.sin(2 * k * chi) for k, c in enumerate(LATITUDE, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + F.lit(zone * 6.0 - 183), F.degrees(lat)


def shifted(lon: Column, lat: Column, to_newer: bool) -> tuple[Column, Column]:
    """Longitude and latitude of a point on the ellipsoid in the other datum."""
    sign = 1 if to_newer else -1
    la, lo = F.radians(lat), F.radians(lon)
    nu = AXIS / F.sqrt(1 - _E2 * F.sin(la) * F.sin(la))
    x, y, z = nu * F.cos(la) * F.cos(lo), nu * F.cos(la) * F.sin(lo), nu * (1 - _E2) * F.sin(la)
    rx, ry, rz = (sign * math.radians(r / 3600) for r in ROTATION)
    tx, ty, tz = (sign * t for t in SHIFT)
    m = 1 + sign * PPM / 1e6
    x, y, z = tx + m * (x + rz * y - ry * z), ty + m * (-rz * x + y + rx * z), tz + m * (ry * x - rx * y + z)
    flat = F.sqrt(x * x + y * y)
    # Bowring's formula, exact to far below a millimetre near the ellipsoid.
    u = F.atan2(z, flat * (1 - FLATTENING))
    top, low = z + _E2 / (1 - _E2) * AXIS * (1 - FLATTENING) * F.pow(F.sin(u), F.lit(3.0)), flat - _E2 * AXIS * F.pow(F.cos(u), F.lit(3.0))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(top, low))


def to_layer(lon: Column, lat: Column, crs: int) -> tuple[Column, Column]:
    """x and y in a layer's system of points in EPSG:4326."""
    zone, older = zone_of(crs)
    lon, lat = shifted(lon, lat, False) if older else (lon, lat)
    return to_grid(lon, lat, zone) if zone else (lon, lat)


def from_layer(x: Column, y: Column, crs: int) -> tuple[Column, Column]:
    """Longitude and latitude in EPSG:4326 of points in a layer's system."""
    zone, older = zone_of(crs)
    lon, lat = from_grid(x, y, zone) if zone else (x, y)
    return shifted(lon, lat, True) if older else (lon, lat)
