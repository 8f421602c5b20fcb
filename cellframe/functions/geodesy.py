"""Transverse Mercator (UTM) to and from geographic coordinates on GRS80.

Kruger series to third order in the third flattening, written as column arithmetic:
below a millimetre inside a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid and the UTM projection constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_n = FLATTENING / (2 - FLATTENING)
_radius = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_alpha = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16,
    13 * _n**2 / 48 - 3 * _n**3 / 5,
    61 * _n**3 / 240,
)
_beta = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96,
    _n**2 / 48 + _n**3 / 15,
    17 * _n**3 / 480,
)
_delta = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3,
    7 * _n**2 / 3 - 8 * _n**3 / 5,
    56 * _n**3 / 15,
)
_ecc = 2 * math.sqrt(_n) / (1 + _n)


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees on GRS80."""
    phi = F.radians(lat)
    dlon = F.radians(lon - F.lit(central_meridian(zone)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ecc) * F.atanh(F.lit(_ecc) * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    north, east = xi, eta
    for j, a in enumerate(_alpha, start=1):
        k = F.lit(2.0 * j)
        north = north + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
        east = east + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
    size = F.lit(SCALE * _radius)
    offset = F.lit(FALSE_NORTHING_SOUTH if south else 0.0)
    return F.lit(FALSE_EASTING) + size * east, offset + size * north


def to_lonlat(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees on GRS80 of UTM metres."""
    size = F.lit(SCALE * _radius)
    offset = F.lit(FALSE_NORTHING_SOUTH if south else 0.0)
    xi = (y - offset) / size
    eta = (x - F.lit(FALSE_EASTING)) / size
    xi_p, eta_p = xi, eta
    for j, b in enumerate(_beta, start=1):
        k = F.lit(2.0 * j)
        xi_p = xi_p - F.lit(b) * F.sin(k * xi) * F.cosh(k * eta)
        eta_p = eta_p - F.lit(b) * F.cos(k * xi) * F.sinh(k * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    phi = chi
    for j, d in enumerate(_delta, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lon = F.lit(central_meridian(zone)) + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    return lon, F.degrees(phi)
