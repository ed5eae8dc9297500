"""Sensor text: rows of numbers by column position, with comments, time and axis corrections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rotations
from ..functions.notation import number
from ..functions.vectors import let

ANGLES = {"rad": 1.0, "deg": 0.017453292519943295, "gon": 0.015707963267948967}  # fixed: pi/180, pi/200


@dataclass
class Layout:
    """Where a sensor's values are in a line. A position of -1 means that the value isn't there."""

    time: int = 0
    values: tuple[int, ...] = (1, 2, 3)
    separators: tuple[str, ...] = (",",)
    comment: str = "#"
    time_scale: float = 1.0
    time_delta: float = 0.0
    signs: tuple[float, ...] = (1.0, 1.0, 1.0)
    angle: str = "axis"  # axis, zyx, xyz, quaternion
    units: str = "rad"
    groups: dict[str, tuple[int, ...]] = field(default_factory=dict)


def _words(line: Column, layout: Layout) -> Column:
    escaped = "|".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in layout.separators)
    return F.filter(F.transform(F.split(line, escaped), lambda x: F.trim(x)), lambda x: x != "")


def _kept(rows: DataFrame, rest: list[str], value: Column, keep: Callable[[Column], Column], name: str) -> DataFrame:
    """The columns of rest and the value, of rows that are to be kept: exploded, as a filter on a computed column would compute it anew for each use of it."""
    some = let(value, lambda x: F.when(keep(x), F.array(x)).otherwise(F.array().cast("array<array<double>>")))
    return rows.select(*rest, F.explode(some).alias(name))


def numbers(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    """t and the array v of a layout's values; comments, short lines and lines with a word that is no number are dropped."""
    places = (layout.time, *layout.values)
    rest = [c for c in lines.columns if c != line]
    read = lambda words: F.when(F.size(words) > max(places), F.transform(F.array(*[F.get(words, F.lit(p)) for p in places]), number))
    words = let(_words(F.col(line), layout), read)
    good = _kept(lines.where(~F.ltrim(line).startswith(layout.comment)), rest, words, lambda n: n.isNotNull() & ~F.exists(n, lambda x: x.isNull()), "_n")
    return good.select(*rest, (F.col("_n")[0] * layout.time_scale + layout.time_delta).alias("t"), F.slice("_n", 2, len(layout.values)).alias("v"))


def _finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def accelerometer(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    return numbers(lines, layout, line)


def position(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    """As the accelerometer; rows that aren't finite are dropped."""
    return numbers(lines, layout, line).where(_finite(F.col("v")))


def angular(lines: DataFrame, layout: Layout, line: str = "value", finite: bool = False) -> DataFrame:
    """Rotation vectors of gyro or orientation rows: units, axis signs, then the angles' representation."""
    rows = numbers(lines, layout, line)
    k = ANGLES[layout.units]
    if layout.angle == "quaternion":
        w, x, y, z = (F.col("v")[i] for i in range(4))
        v = rotations.vector_of_components(w, x * layout.signs[0], y * layout.signs[1], z * layout.signs[2])
    else:
        x, y, z = (F.col("v")[i] * (k * s) for i, s in enumerate(layout.signs))
        v = F.array(x, y, z) if layout.angle == "axis" else rotations.vector_of_euler(x, y, z, layout.angle)
    return _kept(rows, [c for c in rows.columns if c != "v"], v, _finite, "v") if finite else rows.withColumn("v", v)


def gps(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    """t, position, velocity and their 3x3 covariances, each null where its group isn't laid out.

    groups: position, velocity, position_variance, position_covariance (xy, yz, zx), velocity_variance, velocity_covariance. All three
    places of a group are needed; each variance is read from its own column. Neither position nor velocity is an error.
    """
    have = {k: v for k, v in layout.groups.items() if len(v) == 3 and min(v) >= 0}
    if not {"position", "velocity"} & set(have):
        raise ValueError("neither position nor velocity is laid out")
    order = [p for k in sorted(have) for p in have[k]]
    whole = Layout(**{**layout.__dict__, "values": tuple(order)})
    rows = numbers(lines, whole, line)
    at = {k: 3 * i for i, k in enumerate(sorted(have))}
    none = F.lit(None).cast("array<double>")
    take = lambda k: F.slice("v", at[k] + 1, 3) if k in at else none

    def covariance(kind: str) -> Column:
        if f"{kind}_variance" not in at:
            return none
        d, c = take(f"{kind}_variance"), take(f"{kind}_covariance") if f"{kind}_covariance" in at else F.array(*[F.lit(0.0)] * 3)
        return F.array(d[0], c[0], c[2], c[0], d[1], c[1], c[2], c[1], d[2])

    rest = [c for c in rows.columns if c not in ("v", "t")]
    return rows.select(*rest, "t", take("position").alias("position"), take("velocity").alias("velocity"), covariance("position").alias("position_covariance"), covariance("velocity").alias("velocity_covariance"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def generated(spark: SparkSession, start: float, end: float, step: float, value) -> DataFrame:
    """Samples (t, v) of a function of time, at a fixed step and padded evenly at both ends."""
    n = int((end - start) // step) + 1
    pad = (end - start - (n - 1) * step) / 2
    t = F.lit(start + pad) + F.col("id") * step
    return spark.range(n).select(t.alias("t"), value(t).alias("v"))
