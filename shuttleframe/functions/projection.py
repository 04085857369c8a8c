"""Coordinate reference systems by EPSG code, as columns: projected metres to and from degrees on WGS 84.

Transverse Mercator goes by Krueger's series to the fourth order, Lambert's azimuthal equal-area projection by its closed
form, and datums by a seven-parameter shift, which for the German and the British one is good to a few metres, as
published; no shift grids are used. ETRS 89 counts as WGS 84.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-axis and flattening of ellipsoids; shifts to WGS 84 (metres, seconds of arc, parts of a million);
# projections as published for the codes.
ELLIPSOIDS = {"wgs84": (6378137.0, 1 / 298.257223563), "grs80": (6378137.0, 1 / 298.257222101), "bessel": (6377397.155, 1 / 299.1528128), "airy": (6377563.396, 1 / 299.3249646)}
SHIFTS = {"bessel": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7), "airy": (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)}
WGS_84, LAEA_EUROPE, BRITISH_GRID, GAUSS_KRUEGER_3, GAUSS_KRUEGER_4 = 4326, 3035, 27700, 31467, 31468


@dataclass(frozen=True)
class Mercator:
    """Transverse Mercator: ellipsoid, origin in degrees, scale, false easting and northing."""

    ellipsoid: str
    lat: float
    lng: float
    scale: float
    east: float
    north: float


SYSTEMS = {
    BRITISH_GRID: Mercator("airy", 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0),
    GAUSS_KRUEGER_3: Mercator("bessel", 0.0, 9.0, 1.0, 3_500_000.0, 0.0),
    GAUSS_KRUEGER_4: Mercator("bessel", 0.0, 12.0, 1.0, 4_500_000.0, 0.0),
}


def _series(n: float) -> tuple[list[float], list[float], list[float], float]:
    """Krueger's coefficients (forward, inverse, latitude from the conformal one) and the rectifying radius over the semi-axis."""
    n2, n3, n4 = n * n, n**3, n**4
    forward = [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280]
    inverse = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280]
    latitude = [2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630]
    return forward, inverse, latitude, (1 + n2 / 4 + n4 / 64) / (1 + n)


def _meridian(n: float, radius: float, lat: float) -> float:
    """Length of the meridian from the equator to a latitude (radians)."""
    e = 2 * math.sqrt(n) / (1 + n)
    xi = math.atan(math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))))
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_series(n)[0])))


def to_mercator(lat: np.ndarray, lng: np.ndarray, m: Mercator) -> tuple[np.ndarray, np.ndarray]:
    """(easting, northing) of degrees on the system's own ellipsoid."""
    a, f = ELLIPSOIDS[m.ellipsoid]
    n = f / (2 - f)
    forward, _, _, unit = _series(n)
    radius, e = m.scale * a * unit, 2 * math.sqrt(n) / (1 + n)
    sin, turn = np.sin(np.radians(lat)), np.radians(lng - m.lng)
    t = np.sinh(np.arctanh(sin) - e * np.arctanh(e * sin))
    xi, eta = np.arctan2(t, np.cos(turn)), np.arctanh(np.sin(turn) / np.sqrt(1 + t * t))
    east = eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(forward))
    north = xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(forward))
    return m.east + radius * east, m.north - _meridian(n, radius, math.radians(m.lat)) + radius * north


def from_mercator(east: np.ndarray, north: np.ndarray, m: Mercator) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lng) in degrees on the system's own ellipsoid."""
    a, f = ELLIPSOIDS[m.ellipsoid]
    n = f / (2 - f)
    _, inverse, latitude, unit = _series(n)
    radius = m.scale * a * unit
    xi, eta = (north - m.north + _meridian(n, radius, math.radians(m.lat))) / radius, (east - m.east) / radius
    x = xi - sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(inverse))
    y = eta - sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(inverse))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi + sum(c * np.sin(2 * (j + 1) * chi) for j, c in enumerate(latitude))
    return np.degrees(lat), m.lng + np.degrees(np.arctan2(np.sinh(y), np.cos(x)))


def shifted(lat: np.ndarray, lng: np.ndarray, source: str, target: str, shift: tuple[float, ...], back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Degrees on another ellipsoid by a seven-parameter shift of the point on the surface."""
    (a, f), (b, g) = ELLIPSOIDS[source], ELLIPSOIDS[target]
    e2 = f * (2 - f)
    phi, lam = np.radians(lat), np.radians(lng)
    nu = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    x, y, z = nu * np.cos(phi) * np.cos(lam), nu * np.cos(phi) * np.sin(lam), nu * (1 - e2) * np.sin(phi)
    dx, dy, dz = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    s = shift[6] * 1e-6
    if back:
        dx, dy, dz, rx, ry, rz, s = -dx, -dy, -dz, -rx, -ry, -rz, -s
    u, v, w = dx + (1 + s) * x - rz * y + ry * z, dy + rz * x + (1 + s) * y - rx * z, dz - ry * x + rx * y + (1 + s) * z
    g2, p = g * (2 - g), np.hypot(u, v)
    out = np.arctan2(w, p * (1 - g2))
    for _ in range(5):
        out = np.arctan2(w + g2 * b / np.sqrt(1 - g2 * np.sin(out) ** 2) * np.sin(out), p)
    return np.degrees(out), np.degrees(np.arctan2(v, u))


def _converted(epsg: int, first: Column, second: Column, inverse: bool) -> tuple[Column, Column]:
    """Both coordinates by one vectorised function; its series would make an expression of some thousand nodes."""
    m = SYSTEMS[epsg]

    @F.pandas_udf("a double, b double")
    def convert(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        u, v = x.to_numpy(float), y.to_numpy(float)
        if inverse:
            a, b = shifted(*from_mercator(u, v, m), m.ellipsoid, "wgs84", SHIFTS[m.ellipsoid], False)
        else:
            a, b = to_mercator(*shifted(u, v, "wgs84", m.ellipsoid, SHIFTS[m.ellipsoid], True), m)
        return pd.DataFrame({"a": a, "b": b})

    both = convert(first.cast("double"), second.cast("double"))
    return both["a"], both["b"]


# Fixed values of the equal-area projection of Europe: origin in degrees, false easting and northing.
LAEA = (52.0, 10.0, 4_321_000.0, 3_210_000.0)


def _authalic() -> tuple[float, float, float, float, float, float]:
    """Eccentricity squared, q at the pole, authalic latitude of the origin, authalic radius, the origin's stretch."""
    a, f = ELLIPSOIDS["grs80"]
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    top, s0 = q(1.0), math.sin(math.radians(LAEA[0]))
    b0, radius = math.asin(q(s0) / top), a * math.sqrt(top / 2)
    return e2, top, b0, radius, a * math.cos(math.radians(LAEA[0])) / math.sqrt(1 - e2 * s0 * s0) / (radius * math.cos(b0)), e


def to_laea(lat: Column, lng: Column) -> tuple[Column, Column]:
    e2, top, b0, radius, d, e = _authalic()
    s, turn = F.sin(F.radians(lat)), F.radians(lng) - math.radians(LAEA[1])
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    sin = q / top
    cos = F.sqrt(1 - sin * sin)
    scale = radius * F.sqrt(2 / (1 + math.sin(b0) * sin + math.cos(b0) * cos * F.cos(turn)))
    return LAEA[2] + scale * d * cos * F.sin(turn), LAEA[3] + scale / d * (math.cos(b0) * sin - math.sin(b0) * cos * F.cos(turn))


def from_laea(east: Column, north: Column) -> tuple[Column, Column]:
    e2, _, b0, radius, d, _ = _authalic()
    x, y = east - LAEA[2], north - LAEA[3]
    rho = F.greatest(F.sqrt((x / d) * (x / d) + (d * y) * (d * y)), F.lit(1e-9))
    angle = 2 * F.asin(rho / (2 * radius))
    beta = F.asin(F.cos(angle) * math.sin(b0) + d * y * F.sin(angle) * math.cos(b0) / rho)
    e4, e6 = e2 * e2, e2**3
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.degrees(lat), LAEA[1] + F.degrees(F.atan2(x * F.sin(angle), d * rho * math.cos(b0) * F.cos(angle) - d * d * y * math.sin(b0) * F.sin(angle)))


def to_degrees(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lng) in degrees on WGS 84 of coordinates in a system: easting and northing, or longitude and latitude."""
    if epsg == WGS_84:
        return y, x
    if epsg == LAEA_EUROPE:
        return from_laea(x, y)
    return _converted(epsg, x, y, True)


def from_degrees(epsg: int, lat: Column, lng: Column) -> tuple[Column, Column]:
    """(x, y) in a system of degrees on WGS 84."""
    if epsg == WGS_84:
        return lng, lat
    if epsg == LAEA_EUROPE:
        return to_laea(lat, lng)
    return _converted(epsg, lat, lng, False)
