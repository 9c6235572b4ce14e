"""Planar and geographic geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: metres per degree, and the cosine floor used near the poles
METRES_PER_LON_DEGREE = 111320.0
METRES_PER_LAT_DEGREE = 110540.0
COS_FLOOR = 0.2


def _edges(pts: Column) -> Column:
    """Array of vertex pairs (a, b), closing edge included; `pts` is array<struct<x,y>>."""
    n = F.size(pts)
    nxt = F.concat(F.slice(pts, F.lit(2), n - 1), F.slice(pts, 1, 1))
    return F.zip_with(pts, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def poly_area(pts: Column) -> Column:
    """Area of a simple polygon."""
    cross = F.transform(_edges(pts), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2.0


def poly_centroid(pts: Column) -> Column:
    """Mean of the vertices as struct<x,y>."""
    mean = lambda f: F.aggregate(F.transform(pts, f), F.lit(0.0), lambda s, v: s + v) / F.size(pts)
    return F.struct(mean(lambda p: p["x"]).alias("x"), mean(lambda p: p["y"]).alias("y"))


def side_lengths(pts: Column) -> Column:
    def length(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        return F.sqrt(dx * dx + dy * dy)

    return F.transform(_edges(pts), length)


def long_axis_deg(pts: Column) -> Column:
    """Direction of the longest edge in [0, 180), first edge wins a tie."""

    def edge(e, i):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        return F.struct((-(dx * dx + dy * dy)).alias("l"), i.alias("i"), dx.alias("dx"), dy.alias("dy"))

    best = F.array_min(F.transform(_edges(pts), edge))
    return axial(F.degrees(F.atan2(best["dy"], best["dx"])))


def axial(deg: Column) -> Column:
    """Fold an angle into [0, 180)."""
    return F.pmod(F.pmod(deg, F.lit(180.0)) + 180.0, F.lit(180.0))


def axial_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two axes, in [0, 90]."""
    return F.abs(axial(a - b + 90.0) - 90.0)


def affine_apply(t: Column, col: Column, row: Column) -> Column:
    """Pixel to world; `t` is the six-number transform (x0, dx, rx, y0, ry, dy)."""
    g = lambda k: F.element_at(t, k)
    return F.struct((g(1) + col * g(2) + row * g(3)).alias("x"), (g(4) + col * g(5) + row * g(6)).alias("y"))


def affine_invert(t: Column, x: Column, y: Column) -> Column:
    """World to pixel for the same transform."""
    g = lambda k: F.element_at(t, k)
    det = g(2) * g(6) - g(3) * g(5)
    ex, ey = x - g(1), y - g(4)
    return F.struct(((ex * g(6) - ey * g(3)) / det).alias("col"), ((ey * g(2) - ex * g(5)) / det).alias("row"))


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Equirectangular offsets from a reference point."""
    return F.struct(
        ((lon - lon0) * METRES_PER_LON_DEGREE * F.cos(F.radians(lat0))).alias("x"),
        ((lat - lat0) * METRES_PER_LAT_DEGREE).alias("y"),
    )


def loa_radius_deg(length_m: Column, lat: Column) -> Column:
    """Twice the vessel length in degrees at a latitude."""
    return 2.0 * length_m / (METRES_PER_LON_DEGREE * F.greatest(F.lit(COS_FLOOR), F.abs(F.cos(F.radians(lat)))))


def hull_geometry(length: Column, width: Column, area: Column, axis_deg: Column, pixel_m: float) -> dict[str, Column]:
    return {
        "log_length": F.log1p(length * pixel_m), "log_width": F.log1p(width * pixel_m),
        "log_area": F.log1p(area * pixel_m * pixel_m),
        "aspect": length / F.greatest(F.lit(1e-6), width),
        "cos2": F.cos(F.radians(2.0 * axis_deg)),
    }


def utm_zone(min_lon: Column, max_lon: Column) -> Column:
    """One zone per port, from the middle of its box."""
    return (F.floor((min_lon + max_lon) / 2.0 / 6.0) + 31).cast("int")


# fixed values: WGS 84 ellipsoid and transverse Mercator frame
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0

_N = WGS84_F / (2.0 - WGS84_F)
_RADIUS = WGS84_A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_E = math.sqrt(WGS84_F * (2.0 - WGS84_F))


def _atanh(c: Column) -> Column:
    return 0.5 * F.log((1.0 + c) / (1.0 - c))


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """Longitude and latitude to easting and northing (northern frame) by the Krueger series."""
    lam = F.radians(lon - (zone * 6.0 - 183.0))
    s = F.sin(F.radians(lat))
    t = F.sinh(_atanh(s) - _E * _atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * _RADIUS
    return F.struct((UTM_FALSE_EASTING + k * x).alias("x"), (k * y).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column) -> Column:
    """Easting and northing (northern frame) back to longitude and latitude."""
    k = UTM_SCALE * _RADIUS
    xi, eta = y / k, (x - UTM_FALSE_EASTING) / k
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6.0 - 183.0)).alias("lon"), F.degrees(lat).alias("lat"))
