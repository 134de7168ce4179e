"""The two projections in use and the pixel grid, as column expressions.

Transverse Mercator follows the fourth-order Krueger series (Karney 2011, "Transverse
Mercator with an accuracy of a few nanometers"); polar stereographic on a sphere has
a closed form (Snyder 1987, USGS Professional Paper 1395).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.spectral import col

# WGS84 ellipsoid, UTM zone 3N (EPSG:32603), sphere of the climate grid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_K0, UTM_E0, UTM_LON0 = 0.9996, 500000.0, -165.0
SPHERE_R, STEREO_LAT_TS, STEREO_LON0 = 6370000.0, 64.0, -152.0
REGION_CENTER = (66.0756, -162.7172)

_N = WGS84_F / (2 - WGS84_F)
UTM_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
UTM_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
# The inverse series: of the meridian arc, and of geographic from conformal latitude.
UTM_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
UTM_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
UTM_ECC = math.sqrt(WGS84_F * (2 - WGS84_F))
STEREO_SCALE = SPHERE_R * (1 + math.sin(math.radians(STEREO_LAT_TS)))


def utm_xy(lon: Column | str, lat: Column | str, lon0: float = UTM_LON0) -> tuple[Column, Column]:
    """Geographic degrees to UTM easting and northing in metres."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - UTM_ECC * F.atanh(UTM_ECC * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(UTM_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_E0 + UTM_K0 * UTM_A * east, UTM_K0 * UTM_A * north


def utm_lonlat(x: Column | str, y: Column | str, lon0: Column | float = UTM_LON0) -> tuple[Column, Column]:
    """Inverse of utm_xy, in degrees."""
    xi, eta = col(y) / (UTM_K0 * UTM_A), (col(x) - UTM_E0) / (UTM_K0 * UTM_A)
    north, east = _on_sphere(xi, eta)
    return _lonlat(north, east, F.asin(F.sin(north) / F.cosh(east)), lon0)


def _on_sphere(xi: Column, eta: Column) -> tuple[Column, Column]:
    north, east = xi, eta
    for j, b in enumerate(UTM_BETA, start=1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return north, east


def _lonlat(north: Column, east: Column, chi: Column, lon0: Column | float) -> tuple[Column, Column]:
    phi = chi
    for j, d in enumerate(UTM_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.degrees(phi)


def with_utm_lonlat(df: DataFrame, x: Column | str, y: Column | str, lon0: Column | float, lon: str, lat: str) -> DataFrame:
    """df with utm_lonlat as columns lon and lat, term by term.

    As one expression the terms are repeated in each other hundreds of times; as columns each is computed once a row.
    """
    df = df.withColumns({"_xi": col(y) / (UTM_K0 * UTM_A), "_eta": (col(x) - UTM_E0) / (UTM_K0 * UTM_A)})
    df = df.withColumns(dict(zip(("_north", "_east"), _on_sphere(F.col("_xi"), F.col("_eta")), strict=True)))
    df = df.withColumn("_chi", F.asin(F.sin("_north") / F.cosh("_east")))
    df = df.withColumns(dict(zip((lon, lat), _lonlat(F.col("_north"), F.col("_east"), F.col("_chi"), lon0), strict=True)))
    return df.drop("_xi", "_eta", "_north", "_east", "_chi")


def affine_xy(row: Column | str, column: Column | str, affine: Column) -> tuple[Column, Column]:
    """World coordinates of a pixel centre; affine is a struct (a, b, c, d, e, f) with x = a col + b row + c, y = d col + e row + f at pixel corners."""
    i, j = col(column) + 0.5, col(row) + 0.5
    return affine["a"] * i + affine["b"] * j + affine["c"], affine["d"] * i + affine["e"] * j + affine["f"]


def affine_pixel(x: Column, y: Column, affine: Column) -> tuple[Column, Column]:
    """Fractional (row, col) of a place, whole numbers at pixel centres; inverse of affine_xy."""
    det = affine["a"] * affine["e"] - affine["b"] * affine["d"]
    dx, dy = x - affine["c"], y - affine["f"]
    return (affine["a"] * dy - affine["d"] * dx) / det - 0.5, (affine["e"] * dx - affine["b"] * dy) / det - 0.5


def stereo_xy(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Geographic degrees to the climate grid (north polar stereographic, sphere)."""
    lam = F.radians(col(lon) - STEREO_LON0)
    rho = STEREO_SCALE * F.tan(math.pi / 4 - F.radians(col(lat)) / 2)
    return rho * F.sin(lam), -rho * F.cos(lam)


def stereo_lonlat(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Inverse of stereo_xy, in degrees."""
    rho = F.sqrt(col(x) * col(x) + col(y) * col(y))
    return (
        STEREO_LON0 + F.degrees(F.atan2(col(x), -col(y))),
        90.0 - F.degrees(2 * F.atan(rho / STEREO_SCALE)),
    )


def stereo_point(lon: float, lat: float) -> tuple[float, float]:
    """stereo_xy of one constant point."""
    lam = math.radians(lon - STEREO_LON0)
    rho = STEREO_SCALE * math.tan(math.pi / 4 - math.radians(lat) / 2)
    return rho * math.sin(lam), -rho * math.cos(lam)


def pixel_xy(
    row: Column | str, column: Column | str, origin_x: Column | float, origin_y: Column | float, size: Column | float
) -> tuple[Column, Column]:
    """World coordinates of a pixel centre, origin at the upper left corner."""
    return origin_x + (col(column) + 0.5) * size, origin_y - (col(row) + 0.5) * size
