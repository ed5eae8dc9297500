"""Camera models, colour quantizers and uncertain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let


def _radial(x: Column, y: Column, k: Column) -> tuple[Column, Column]:
    r2 = x * x + y * y
    d = k[0] * r2 + k[1] * r2 * r2 + k[2] * r2 * r2 * r2
    return x * d, y * d


def _tangential(x: Column, y: Column, t: Column) -> tuple[Column, Column]:
    r2 = x * x + y * y
    return 2 * t[0] * x * y + t[1] * (r2 + 2 * x * x), t[0] * (r2 + 2 * y * y) + 2 * t[1] * x * y


def pinhole_direction(u: Column, v: Column, f: Column, pp: Column, k: Column, t: Column, b: Column) -> Column:
    """Direction (3) of a pixel: skew undone, then radial (k1..k3) and tangential (t1, t2) corrections; scaled by f.

    Skew (b1, b2) is u = f x (1 + b1) + f y b2 + pp; its own coefficients are used.
    """
    y = (v - pp[1]) / f
    x = ((u - pp[0]) / f - b[1] * y) / (1 + b[0])
    (rx, ry), (tx, ty) = _radial(x, y, k), _tangential(x, y, t)
    return F.array((x + rx + tx) * f, (y + ry + ty) * f, f)


def undistorted(x: Column, y: Column, k: Column, t: Column, rounds: int = 8) -> Column:
    """(x, y) whose radially and tangentially distorted position is the given one, by fixed-point rounds."""

    def step(p: Column) -> Column:
        (rx, ry), (tx, ty) = _radial(p[0], p[1], k), _tangential(p[0], p[1], t)
        return F.array(x - rx - tx, y - ry - ty)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(x, y), lambda p, _: step(p))


def pushbroom_direction(u: Column, v: Column, f: Column, pp: Column, a: Column, b: Column, width) -> Column:
    """Direction (3) of a line sensor's pixel; a and b are polynomials of degree 5 in the centred position."""

    def of(s: Column) -> Column:
        poly = lambda c: c[0] + s * (c[1] + s * (c[2] + s * (c[3] + s * (c[4] + s * c[5]))))
        return F.array(u - pp[0] + poly(a), v + poly(b), f)

    return let((u - width / 2) / width, of)


def view_angles(direction: Column) -> Column:
    """Angles across and along track of a direction."""
    return F.array(F.atan(direction[0] / direction[2]), F.atan(direction[1] / direction[2]))


def reprojection(p: Column, f: Column, pp: Column) -> Column:
    """Pixel of a point in camera axes; NaN behind the camera."""
    nan = F.lit(float("nan"))
    at = lambda i: F.when(p[2] < 0, nan).otherwise(f * p[i] / p[2] + pp[i])
    return F.array(at(0), at(1))


def quantized(value: Column, gamma, bits: int = 8) -> Column:
    """Below 0 to 0; else value^(1/gamma) times 2^bits, rounded down, at most 2^bits - 1."""
    top = (1 << bits) - 1
    return F.when(value < 0, F.lit(0)).otherwise(F.least(F.floor(F.pow(F.greatest(value, F.lit(0.0)), F.lit(1.0) / gamma) * (1 << bits)), F.lit(top))).cast("int")


def display_colour(value: Column, scale=255.0) -> Column:
    return F.floor(scale * F.pow(F.greatest(value, F.lit(0.0)), F.lit(1 / 2.2)) + 0.5).cast("int")


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")).cast("long")


def depth(baseline, disparity: Column, offset) -> Column:
    """z = baseline / (disparity - offset), null where that is not positive."""
    return F.when(disparity - offset > 0, baseline / (disparity - offset))


# ---- uncertain numbers: STRUCT<value, stddev>, a null value is unset, a null stddev exact ----------


def uncertain(value: Column, stddev: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), stddev.cast("double").alias("stddev"))


def _both(a: Column, b: Column, value: Column, stddev: Column) -> Column:
    """An unset right operand is ignored; a result is exact only where both are."""
    made = uncertain(value, F.when(a["stddev"].isNull() & b["stddev"].isNull(), None).otherwise(stddev))
    return F.when(b["value"].isNull(), a).otherwise(made)


def _sd(x: Column) -> Column:
    return F.coalesce(x["stddev"], F.lit(0.0))


def plus(a: Column, b: Column) -> Column:
    return _both(a, b, a["value"] + b["value"], _sd(a) + _sd(b))


def minus(a: Column, b: Column) -> Column:
    return _both(a, b, a["value"] - b["value"], _sd(a) + _sd(b))


def times(a: Column, b: Column) -> Column:
    va, vb = a["value"], b["value"]
    return _both(a, b, va * vb, F.sqrt(_sd(b) * _sd(b) * va * va + _sd(a) * _sd(a) * vb * vb))


def divided(a: Column, b: Column) -> Column:
    va, vb = a["value"], b["value"]
    return _both(a, b, va / vb, F.sqrt(_sd(b) * _sd(b) * va * va / (vb * vb * vb * vb) + _sd(a) * _sd(a) / (vb * vb)))


def scaled(a: Column, k) -> Column:
    return uncertain(a["value"] * k, a["stddev"] * F.abs(F.lit(k) if not isinstance(k, Column) else k))


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-4, relative: bool = False) -> Column:
    """Within the tolerance: absolute for single numbers, relative to the larger for those of a group."""
    if relative:
        return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= tolerance


# ---- robust losses -----------------------------------------------------------------------------


def robust_loss(s: Column, kind: Column | str) -> Column:
    """rho of a squared residual, scale 1: huber, cauchy, arctan; else the square itself."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(kind == "huber", F.when(s <= 1, s).otherwise(2 * F.sqrt(s) - 1)).when(kind == "cauchy", F.log1p(s)).when(kind == "arctan", F.atan(s)).otherwise(s)
