"""Geodesy as Column expressions. Longitudes and latitudes are degrees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0
#: Degrees of latitude in a kilometre of the display grid.
CELL_DEGREES = 1 / 111.32
#: WGS84 and the transverse Mercator zone 49 south.
FLATTENING, CENTRAL_LON, SCALE, FALSE_EAST, FALSE_NORTH = 1 / 298.257223563, 111.0, 0.9996, 500_000.0, 10_000_000.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, to six decimals."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))), 6)


def raw_bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, clockwise from north, in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing to six decimals; what rounds to 360 is 0."""
    return F.pmod(F.round(raw_bearing_deg(lon1, lat1, lon2, lat2), 6), F.lit(360.0))


def travelled(lon: np.ndarray, lat1: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What haversine_km() and bearing_deg() give, for arrays inside a task: of the degrees of longitude from start to end, and the latitudes of both."""
    d, p, q = np.radians(lon), np.radians(lat1), np.radians(lat2)
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
    km = np.round(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a))), 6)
    raw = np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d)))
    return km, np.fmod(np.round(np.fmod(raw + 360, 360), 6), 360)


def relative_heading(bearing: Column, direction: Column) -> Column:
    """Angle of the waves against the ship: 90 is abeam."""
    return F.pmod(bearing - direction + 90, F.lit(360.0))


def mercator_x(lon: Column) -> Column:
    return MERCATOR_M * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_M * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def snapped(value: Column, low: float, high: float, size: float = CELL_DEGREES) -> Column:
    """Centre of the value's grid cell counted from low, kept within [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), (F.floor((value - low) / size) + 0.5) * size + low))


_n = FLATTENING / (2 - FLATTENING)
_e = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = MERCATOR_M / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
#: Coefficients of the sixth-order series, by power of the third flattening.
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
)

#: The same from the conformal latitude to the latitude.
DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45 + 26 * _n**5 / 45 - 2854 * _n**6 / 675,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45 + 2704 * _n**5 / 315 + 2323 * _n**6 / 945,
    56 * _n**3 / 15 - 136 * _n**4 / 35 - 1262 * _n**5 / 105 + 73814 * _n**6 / 2835,
    4279 * _n**4 / 630 - 332 * _n**5 / 35 - 399572 * _n**6 / 14175,
    4174 * _n**5 / 315 - 144838 * _n**6 / 6237,
    601676 * _n**6 / 22275,
)


def _conformal(tau: Column) -> Column:
    s = F.sinh(_e * F.atanh(_e * tau / F.sqrt(1 + tau * tau)))
    return tau * F.sqrt(1 + s * s) - s * F.sqrt(1 + tau * tau)


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    lam, tau = F.radians(lon - CENTRAL_LON), _conformal(F.tan(F.radians(lat)))
    xi, eta = F.atan2(tau, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(tau * tau + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EAST + SCALE * _A * x, FALSE_NORTH + SCALE * _A * y


def utm_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing."""
    eta0, xi0 = (east - FALSE_EAST) / (SCALE * _A), (north - FALSE_NORTH) / (SCALE * _A)
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    lon = CENTRAL_LON + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return lon, F.degrees(lat)
