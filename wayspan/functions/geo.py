"""Planar and map geometry as closed-form column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the scale of a transverse Mercator zone.
SEMI_MAJOR, FLATTENING, ZONE_SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def _series() -> tuple[float, tuple[float, ...], tuple[float, ...], float]:
    """Rectifying radius and the forward and inverse coefficients of the Krueger series, from the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return radius, forward, inverse, 2 * math.sqrt(n) / (1 + n)


def to_metres(lon: Column, lat: Column, central: float) -> tuple[Column, Column]:
    """Easting and northing in the transverse Mercator zone around a central meridian."""
    radius, forward, _, e = _series()
    phi, lam = F.radians(lat), F.radians(lon - F.lit(central))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return x * (ZONE_SCALE * radius) + FALSE_EASTING, y * (ZONE_SCALE * radius)


def to_degrees(x: Column, y: Column, central: float) -> tuple[Column, Column]:
    """Longitude and latitude of a place in the zone; the inverse of to_metres."""
    radius, _, inverse, e = _series()
    xi, eta = y / (ZONE_SCALE * radius), (x - FALSE_EASTING) / (ZONE_SCALE * radius)
    u, v = xi, eta
    for j, b in enumerate(inverse, 1):
        u = u - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        v = v - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for _ in range(5):  # conformal to geodetic latitude
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + F.atanh(F.sin(phi) * e) * e))
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + central, F.degrees(phi)


def tile_x(lon: Column, zoom: int) -> Column:
    """Web-Mercator tile column with its fraction."""
    return (lon + 180) / 360 * float(1 << zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    return (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * float(1 << zoom)


def tile_address(lon: Column, lat: Column, zoom: int, size: int = 256) -> list[Column]:
    """tile_x, tile_y, pixel_x, pixel_y; places on the far edge belong to the last tile."""
    out = []
    for name, c in (("x", tile_x(lon, zoom)), ("y", tile_y(lat, zoom))):
        c = F.least(F.greatest(c, F.lit(0.0)), F.lit((1 << zoom) - 1e-9))
        out += [F.floor(c).alias(f"tile_{name}"), F.floor((c - F.floor(c)) * size).alias(f"pixel_{name}")]
    return [out[0], out[2], out[1], out[3]]


def cell(x: Column, y: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """Row and column of a place in a grid whose rows run down from (x0, y0)."""
    return F.floor((F.lit(y0) - y) / size), F.floor((x - F.lit(x0)) / size)


def snapped_bounds(left: Column, bottom: Column, right: Column, top: Column, size: float) -> list[Column]:
    """A box grown outwards to whole cells: left, bottom, right, top."""
    return [F.floor(left / size) * size, F.floor(bottom / size) * size, F.ceil(right / size) * size, F.ceil(top / size) * size]


def block_key(row: Column, col: Column, block: int) -> tuple[Column, Column]:
    """The block that a cell lies in."""
    return F.floor(row / block).cast("int"), F.floor(col / block).cast("int")


def segment_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Share along the segment (0 to 1) of the nearest place to (px, py), and that place."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return t, ax + t * dx, ay + t * dy


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
