"""Geometry as Column expressions: distances, Gauss-Krueger projection, grid cells. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..spec import EARTH_RADIUS_M, GridSpec, ProjSpec


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, form: str = "atan2", radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle metres. form: "atan2"; "asin" (NaN past the antipode by rounding); "asin_guarded", which is null unless all
    four coordinates are set and never exceeds half the circumference."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    if form == "atan2":
        return F.lit(radius) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))
    if form == "asin":
        return F.lit(2.0 * radius) * F.asin(F.sqrt(a))
    if form == "asin_guarded":
        whole = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
        return F.when(whole, F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))
    raise ValueError(f"unknown form {form}")


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, F.lit(2.0)) + F.pow(y2 - y1, F.lit(2.0)))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def _series(p: ProjSpec):
    """Rectifying radius, eccentricity and the Krueger series' coefficients to the fourth order (forward, inverse)."""
    f = 1 / p.inv_f
    n = f / (2 - f)
    radius = p.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    return radius * p.scale, math.sqrt(f * (2 - f)), alpha, beta


def valid_lonlat(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def gk_forward(lon: Column, lat: Column, p: ProjSpec = ProjSpec()) -> Column:
    """struct(x, y) in metres of WGS84-like degrees; null outside the valid range or where a coordinate doesn't parse."""
    radius, e, alpha, _ = _series(p)
    lon, lat = lon.try_cast("double"), lat.try_cast("double")
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    d = F.radians(lon - F.lit(p.lon0))
    xi = F.atan2(t, F.cos(d))
    eta = F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    at = F.struct((F.lit(p.false_easting) + F.lit(radius) * east).alias("x"), (F.lit(p.false_northing) + F.lit(radius) * north).alias("y"))
    return F.when(valid_lonlat(lon, lat), at)


def gk_inverse(x: Column, y: Column, p: ProjSpec = ProjSpec()) -> Column:
    """struct(lon, lat) of projected metres. The latitude takes four fixed-point steps, enough for 1e-12 degrees."""
    radius, e, _, beta = _series(p)
    xi, eta = (y - F.lit(p.false_northing)) / radius, (x - F.lit(p.false_easting)) / radius
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0 = xi0 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta0 = eta0 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    conformal = F.asinh(F.sin(xi0) / F.sqrt(F.pow(F.sinh(eta0), F.lit(2.0)) + F.pow(F.cos(xi0), F.lit(2.0))))
    psi = conformal
    for _ in range(4):
        psi = conformal + F.lit(e) * F.atanh(F.lit(e) * F.tanh(psi))
    lon = F.lit(p.lon0) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return F.struct(lon.alias("lon"), F.degrees(F.asin(F.tanh(psi))).alias("lat"))


def grid_cell(x: Column, y: Column, grid: GridSpec, bounds: str = "half_open") -> Column:
    """struct(loc_x, loc_y) of cell numbers, null outside. bounds: "closed" tests each axis by itself with both ends in;
    "joint" needs both axes inside, both ends in; "half_open" tests each axis without its upper end."""
    cell = lambda v, low: F.floor((v - F.lit(low)) / F.lit(grid.size)).cast("int")
    in_x, in_y = x.between(grid.x_min, grid.x_max), y.between(grid.y_min, grid.y_max)
    if bounds == "joint":
        in_x = in_y = in_x & in_y
    elif bounds == "half_open":
        in_x, in_y = (x >= grid.x_min) & (x < grid.x_max), (y >= grid.y_min) & (y < grid.y_max)
    elif bounds != "closed":
        raise ValueError(f"unknown bounds {bounds}")
    return F.struct(F.when(in_x, cell(x, grid.x_min)).alias("loc_x"), F.when(in_y, cell(y, grid.y_min)).alias("loc_y"))


def cell_centre(loc_x: Column, loc_y: Column, grid: GridSpec) -> Column:
    return F.struct((F.lit(grid.x_min) + (loc_x + 0.5) * grid.size).alias("x"), (F.lit(grid.y_min) + (loc_y + 0.5) * grid.size).alias("y"))
