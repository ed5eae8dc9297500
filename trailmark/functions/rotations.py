"""Rotations and rigid transforms, by the usual published formulas.

A rotation is an axis-angle vector r (3), a unit quaternion (w, x, y, z) or a 3x3 matrix; a pose is a rotation vector r and a translation t,
taking p to R p + t.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import add, let, norm, once, scale, times_vector, transposed, vector


@once
def quaternion_of_vector(r: Column) -> Column:
    def made(a: Column) -> Column:
        half = F.when(a < 1e-8, 0.5 - a * a / 48).otherwise(F.sin(a / 2) / a)
        return F.array(F.cos(a / 2), r[0] * half, r[1] * half, r[2] * half)

    return let(norm(r), made)


@once
def vector_of_quaternion(q: Column) -> Column:
    """The rotation vector, of at most half a turn."""

    def made(v: Column) -> Column:
        w, s = F.abs(q[0]), F.when(q[0] < 0, -1.0).otherwise(1.0)
        k = F.when(v < 1e-12, 2.0 / F.greatest(w, F.lit(1e-12))).otherwise(2 * F.atan2(v, w) / v) * s
        return F.array(q[1] * k, q[2] * k, q[3] * k)

    return let(F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), made)


@once
def times_quaternion(a: Column, b: Column) -> Column:
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


@once
def matrix_of_quaternion(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


@once
def quaternion_of_matrix(m: Column) -> Column:
    """By the largest of the four squares, which keeps the division safe."""
    trace = m[0] + m[4] + m[8]

    def case(s: Column, parts) -> Column:
        return let(F.sqrt(F.greatest(s, F.lit(0.0))) * 2, lambda k: F.array(*parts(k)))

    by_w = case(trace + 1, lambda k: (k / 4, (m[7] - m[5]) / k, (m[2] - m[6]) / k, (m[3] - m[1]) / k))
    by_x = case(1 + m[0] - m[4] - m[8], lambda k: ((m[7] - m[5]) / k, k / 4, (m[1] + m[3]) / k, (m[2] + m[6]) / k))
    by_y = case(1 + m[4] - m[0] - m[8], lambda k: ((m[2] - m[6]) / k, (m[1] + m[3]) / k, k / 4, (m[5] + m[7]) / k))
    by_z = case(1 + m[8] - m[0] - m[4], lambda k: ((m[3] - m[1]) / k, (m[2] + m[6]) / k, (m[5] + m[7]) / k, k / 4))
    return F.when(trace > 0, by_w).when((m[0] > m[4]) & (m[0] > m[8]), by_x).when(m[4] > m[8], by_y).otherwise(by_z)


def rotation_matrix(r: Column) -> Column:
    """exp: rotation vector to matrix."""
    return let(quaternion_of_vector(r), matrix_of_quaternion)


def rotation_vector(m: Column) -> Column:
    """log: matrix to rotation vector."""
    return let(quaternion_of_matrix(m), vector_of_quaternion)


def _about(axis: int, angle: Column) -> Column:
    parts = [F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    parts[1 + axis] = F.sin(angle / 2)
    return F.array(*parts)


def vector_of_euler(x: Column, y: Column, z: Column, order: str = "zyx") -> Column:
    """Rotation vector of Rz Ry Rx ("zyx") or Rx Ry Rz ("xyz"), angles in radians."""
    turns = {"x": _about(0, x), "y": _about(1, y), "z": _about(2, z)}
    first, second, third = (turns[c] for c in order)
    return let(times_quaternion(times_quaternion(first, second), third), vector_of_quaternion)


def euler_degrees(m: Column, order: str = "zyx") -> Column:
    """Angles about x, y, z in degrees of a matrix, the inverse of vector_of_euler."""
    limit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    if order == "zyx":
        x, y, z = F.atan2(m[7], m[8]), -F.asin(limit(m[6])), F.atan2(m[3], m[0])
    else:
        x, y, z = F.atan2(-m[5], m[8]), F.asin(limit(m[2])), F.atan2(-m[1], m[0])
    return F.array(F.degrees(x), F.degrees(y), F.degrees(z))


def vector_of_components(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation vector of a quaternion given by components of any length; the angle counts, not only the axis."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    return let(F.array(w / n, x / n, y / n, z / n), vector_of_quaternion)


def rotate(r: Column, v: Column) -> Column:
    return times_vector(rotation_matrix(r), v)


def compose(r1: Column, t1: Column, r2: Column, t2: Column) -> Column:
    """The pose that applies the second one first, as STRUCT<r, t>."""
    q = times_quaternion(quaternion_of_vector(r1), quaternion_of_vector(r2))
    return F.struct(let(q, vector_of_quaternion).alias("r"), add(rotate(r1, t2), t1).alias("t"))


def inverse(r: Column, t: Column) -> Column:
    return F.struct(scale(r, -1.0).alias("r"), scale(times_vector(transposed(rotation_matrix(r)), t), -1.0).alias("t"))


def interpolate(r1: Column, t1: Column, r2: Column, t2: Column, w: Column) -> Column:
    """The pose a share w of the way from the first to the second: the relative rotation's vector and the translation are scaled by w."""
    between = let(times_quaternion(quaternion_of_vector(scale(r1, -1.0)), quaternion_of_vector(r2)), vector_of_quaternion)
    turned = let(times_quaternion(quaternion_of_vector(r1), quaternion_of_vector(scale(between, w))), vector_of_quaternion)
    return F.struct(turned.alias("r"), F.zip_with(t1, t2, lambda a, b: a + (b - a) * w).alias("t"))


IDENTITY = (0.0, 0.0, 0.0)


def identity() -> Column:
    return F.struct(vector(*IDENTITY).alias("r"), vector(*IDENTITY).alias("t"))
