"""WGS84 geodesy by closed formulas; angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, let, norm, once, scale, subtract, times_vector, transposed, vector

# Fixed values of the ellipsoid, its normal gravity and the Earth's rotation.
SEMI_MAJOR = 6378137.0
SEMI_MINOR = 6356752.314245
EQUATOR_GRAVITY = 9.7803253359
POLE_GRAVITY = 9.8321849378
GRAVITATIONAL_CONSTANT = 3.986004418e14
EARTH_ROTATION = 2 * math.pi / 86400 * (1 + 1 / 365.2425)

_A2, _B2 = SEMI_MAJOR**2, SEMI_MINOR**2
_E2, _EP2 = (_A2 - _B2) / _A2, (_A2 - _B2) / _B2


@once
def geographic(p: Column) -> Column:
    """Earth-centred position (3) to latitude, longitude and height."""

    def of_psi(psi: Column) -> Column:
        flat = F.sqrt(p[0] * p[0] + p[1] * p[1])
        lat = F.atan2(p[2] + _EP2 * SEMI_MINOR * F.pow(F.sin(psi), F.lit(3.0)), flat - _E2 * SEMI_MAJOR * F.pow(F.cos(psi), F.lit(3.0)))
        radius = lambda a: _A2 / F.sqrt(_A2 * F.cos(a) * F.cos(a) + _B2 * F.sin(a) * F.sin(a))
        return let(lat, lambda a: F.array(F.degrees(a), F.degrees(F.atan2(p[1], p[0])), flat / F.cos(a) - radius(a)))

    return let(F.atan2(SEMI_MAJOR * p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]) * SEMI_MINOR), of_psi)


def earth_centred(lat: Column, lon: Column, height: Column) -> Column:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = _A2 / F.sqrt(_A2 * c * c + _B2 * s * s)
    return F.array((n + height) * c * F.cos(F.radians(lon)), (n + height) * c * F.sin(F.radians(lon)), (_B2 / _A2 * n + height) * s)


@once
def gravity(p: Column) -> Column:
    """Normal gravity at an Earth-centred position, as a vector that points outward.

    Somigliana's formula with the series in height to second order; its Earth rate is that of the stars.
    """
    f = (SEMI_MAJOR - SEMI_MINOR) / SEMI_MAJOR
    k = SEMI_MINOR * POLE_GRAVITY / (SEMI_MAJOR * EQUATOR_GRAVITY) - 1
    m = EARTH_ROTATION**2 * _A2 * SEMI_MINOR / GRAVITATIONAL_CONSTANT

    def at(g: Column) -> Column:
        lat, lon, h = F.radians(g[0]), F.radians(g[1]), g[2]
        s2 = F.sin(lat) * F.sin(lat)
        size = EQUATOR_GRAVITY * (1 + k * s2) / F.sqrt(1 - _E2 * s2) * (1 - 2 / SEMI_MAJOR * (1 + f + m - 2 * f * s2) * h + 3 / _A2 * h * h)
        return F.array(F.cos(lat) * F.cos(lon) * size, F.cos(lat) * F.sin(lon) * size, F.sin(lat) * size)

    return let(geographic(p), at)


def local_axes(lat: Column, lon: Column, convention: Column | str = "NED") -> Column:
    """Matrix from a local frame (NED, ENU or NWU) to Earth-centred axes."""
    s, c, sl, cl = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    north, east, down = (-s * cl, -s * sl, c), (-sl, cl, F.lit(0.0)), (-c * cl, -c * sl, -s)
    minus = lambda v: tuple(-x for x in v)
    columns = {"NED": (north, east, down), "ENU": (east, north, minus(down)), "NWU": (north, minus(east), minus(down))}
    made = {k: F.array(*[v[j][i] for i in range(3) for j in range(3)]) for k, v in columns.items()}
    if isinstance(convention, str):
        return made[convention]
    return F.when(convention == "NED", made["NED"]).when(convention == "ENU", made["ENU"]).when(convention == "NWU", made["NWU"])


def local_axes_at(p: Column, convention: Column | str = "NED") -> Column:
    return let(geographic(p), lambda g: local_axes(g[0], g[1], convention))


def frame_on_sphere(mean: Column, radius: Column) -> Column:
    """STRUCT<R, t> that takes Earth-centred points to a frame (east, north, up) on the sphere below `mean`.

    With longitude l and latitude b of `mean` on the sphere, R is the product of two turns: by l about z and by b in the meridian. At a pole,
    where l is free, it is taken as -90 degrees, so that east is x there.
    """

    def of(d: Column) -> Column:
        flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
        around = F.when(flat * radius < 1, F.array(F.lit(0.0), F.lit(-1.0))).otherwise(F.array(d[0] / flat, d[1] / flat))
        turned = lambda c: F.array(-c[1], c[0], F.lit(0.0), -d[2] * c[0], -d[2] * c[1], flat, flat * c[0], flat * c[1], d[2])
        # The point itself lies on the third axis, at the radius.
        return F.struct(let(around, turned).alias("R"), F.array(F.lit(0.0), F.lit(0.0), -radius).alias("t"))

    return let(scale(mean, 1 / norm(mean)), of)


def to_frame(rotation: Column, translation: Column, p: Column) -> Column:
    """R p + t."""
    return F.zip_with(times_vector(rotation, p), translation, lambda a, b: a + b)


def inverse_affine(rotation: Column, translation: Column) -> Column:
    """(R^-1, -R^-1 t) of a rotation R."""
    back = transposed(rotation)
    return F.struct(back.alias("R"), scale(times_vector(back, translation), -1.0).alias("t"))


def earth_rate(rotation: Column) -> Column:
    """The Earth's rotation in a local frame, from the frame's matrix to Earth-centred axes."""
    return times_vector(transposed(rotation), vector(0, 0, EARTH_ROTATION))


def to_earth_centred(x: Column, y: Column, z: Column, crs: Column) -> Column:
    """Points of EPSG:4978 (as they are) and EPSG:4979 (latitude, longitude, height); null for other systems."""
    return F.when(crs == "EPSG:4978", F.array(x, y, z)).when(crs == "EPSG:4979", earth_centred(x, y, z))


def position_constraint(x: Column, y: Column, z: Column, crs: Column, rotation: Column, translation: Column) -> Column:
    """Where a point must be in the local frame: itself if its system is "local" (in any case), else by way of Earth-centred axes; null for unknown systems."""
    return F.when(F.lower(crs) == "local", F.array(x, y, z)).otherwise(to_frame(rotation, translation, to_earth_centred(x, y, z, crs)))


def horizontal_constraint(lat: Column, lon: Column, low: Column, high: Column) -> Column:
    """STRUCT<P, d>: a point that lies on the vertical through (lat, lon) has P p = d.

    The vertical is the line through the positions at two heights; P's two rows (6 numbers) are the unit vectors across it, north and east.
    """

    @once
    def of(a: Column, b: Column, axes: Column) -> Column:
        east = F.array(axes[1], axes[4], axes[7])
        return let(subtract(b, a), lambda v: let(1 / norm(v), lambda k: let(scale(v, k), lambda line: let(east, lambda e: across(a, line, e)))))

    def across(a: Column, line: Column, east: Column) -> Column:
        north = F.array(line[1] * east[2] - line[2] * east[1], line[2] * east[0] - line[0] * east[2], line[0] * east[1] - line[1] * east[0])
        return let(north, lambda n: F.struct(F.concat(n, east).alias("P"), F.array(dot(n, a), dot(east, a)).alias("d")))

    return of(earth_centred(lat, lon, low), earth_centred(lat, lon, high), local_axes(lat, lon, "NED"))


def geotransform(g: Column, i: Column, j: Column) -> Column:
    """Map position of row i and column j by a 2x3 affine transform (6 numbers)."""
    return F.array(g[0] * j + g[1] * i + g[2], g[3] * j + g[4] * i + g[5])


def inverse_geotransform(g: Column, x: Column, y: Column) -> Column:
    """(i, j) of a map position."""
    det = g[0] * g[4] - g[1] * g[3]
    dx, dy = x - g[2], y - g[5]
    return F.array((g[0] * dy - g[3] * dx) / det, (g[4] * dx - g[1] * dy) / det)


def world_file(g: Column) -> Column:
    """The six lines of a world file: x per column, y per column, x per row, y per row, x and y of the first cell."""
    return F.array(g[0], g[3], g[1], g[4], g[2], g[5])
