"""Trajectories: poses over time, inertial pre-integration, comparison and consistency.

A product of rotations has an order, so it isn't a mergeable aggregate; each interval's pieces are bounded by its length, and are
put in order and multiplied within the row by array functions. What runs greedily along a trajectory reads it as a stream, in order of time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotations as R
from ..functions.vectors import add, scale, subtract, times_vector, vector
from .timeseq import integrals, neighbours, regular_grid


def gyro_rotation(gyro: DataFrame, intervals: DataFrame, by: list[str], width: float) -> DataFrame:
    """Rotation vector of each interval (k, t0, tf): the ordered product of exp(omega dt) over its pieces."""
    pieces = integrals(gyro.withColumn("value", F.struct("t", "value")), intervals, by, width)
    ordered = pieces.groupBy(*by, "k", "t0", "tf").agg(F.sort_array(F.collect_list(F.struct(F.col("value.t").alias("t"), F.col("value.value").alias("w"), "dt"))).alias("p"))
    forward = F.when(F.col("t0") <= F.col("tf"), F.col("p")).otherwise(F.reverse("p"))
    q = F.aggregate(forward, vector(1, 0, 0, 0), lambda q, x: R.times_quaternion(q, R.quaternion_of_vector(scale(x["w"], x["dt"]))))
    return ordered.withColumn("q", q).select(*by, "k", "t0", "tf", R.vector_of_quaternion(F.col("q")).alias("r"))


def mounted(samples: DataFrame, mountings: DataFrame, by: list[str]) -> DataFrame:
    """samples with their vectors v turned by the mounting (a matrix, row by row) of their sensor; those without one stay as they are."""
    turned = F.when(F.col("mounting").isNull(), F.col("v")).otherwise(times_vector(F.col("mounting"), F.col("v")))
    return samples.join(mountings.select(*by, "mounting"), by, "left").withColumn("v", turned).drop("mounting")


def pose_at(poses: DataFrame, probes: DataFrame, by: list[str], bucket: float | None = None) -> DataFrame:
    """probes with the interpolated pose: the relative rotation's vector and the translation scaled by the time's share."""
    n = neighbours(poses.withColumnRenamed("pose", "value"), probes, by, bucket)
    lower, upper = F.coalesce("lower.value", "upper.value"), F.coalesce("upper.value", "lower.value")
    span = F.col("upper.t") - F.col("lower.t")
    w = F.when(span.isNull() | (span == 0), 0.0).otherwise((F.col("t") - F.col("lower.t")) / span)
    n = n.withColumn("_a", lower).withColumn("_b", upper).withColumn("_w", w)
    return n.withColumn("pose", R.interpolate(F.col("_a.r"), F.col("_a.t"), F.col("_b.r"), F.col("_b.t"), F.col("_w"))).drop("lower", "upper", "_a", "_b", "_w")


def zip_by_row(position: DataFrame, orientation: DataFrame, by: list[str]) -> DataFrame:
    """Poses of position and orientation rows in order of time, paired by place; an error where a group's counts differ."""
    w = Window.partitionBy(*by).orderBy("t")
    p = position.select(*by, "t", F.col("v").alias("p"), F.row_number().over(w).alias("_i"))
    o = orientation.select(*by, F.col("v").alias("o"), F.row_number().over(w).alias("_i"))
    both = p.join(o, [*by, "_i"], "full")
    checked = F.when(F.col("p").isNull() | F.col("o").isNull(), F.raise_error(F.lit("position and orientation differ in size"))).otherwise(F.struct(F.col("o").alias("r"), F.col("p").alias("t")))
    return both.select(*by, "t", checked.alias("pose"))


def compare(a: DataFrame, b: DataFrame, by: list[str], points: int) -> DataFrame:
    """Differences of two trajectories at uniform times of the first: position by axis and rotation of one relative to the other."""
    grid = regular_grid(a, by, points)
    pa, pb = pose_at(a, grid, by), pose_at(b, grid, by).select(*by, "k", F.col("pose").alias("other"))
    both = pa.join(pb, [*by, "k"])
    relative = R.vector_of_quaternion(R.times_quaternion(R.quaternion_of_vector(scale(F.col("pose.r"), -1.0)), R.quaternion_of_vector(F.col("other.r"))))
    return both.select(*by, "k", "t", subtract(F.col("other.t"), F.col("pose.t")).alias("dp"), relative.alias("dr"))


def guided_subsample(coarse: DataFrame, guide: DataFrame, by: list[str]) -> DataFrame:
    """Coarse poses and, between two of them, the guide's poses, moved so that the guide hits both ends.

    The correction at a node takes the guide's pose to the coarse one; between two nodes it is their interpolation by time.
    """
    at_nodes = pose_at(guide, coarse.select(*by, "t"), by).select(*by, "t", F.col("pose").alias("g"))
    nodes = coarse.join(at_nodes, [*by, "t"])
    back = R.inverse(F.col("g.r"), F.col("g.t"))
    nodes = nodes.withColumn("_i", back).select(*by, "t", R.compose(F.col("pose.r"), F.col("pose.t"), F.col("_i.r"), F.col("_i.t")).alias("pose"))
    ends = coarse.groupBy(*by).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    inner = guide.join(ends, by).where("t > a and t < b").join(coarse.select(*by, "t"), [*by, "t"], "left_anti").select(*by, "t", F.col("pose").alias("g"))
    moved = pose_at(nodes, inner, by)
    moved = moved.select(*by, "t", R.compose(F.col("pose.r"), F.col("pose.t"), F.col("g.r"), F.col("g.t")).alias("pose"), F.lit(True).alias("inserted"))
    return coarse.select(*by, "t", "pose", F.lit(False).alias("inserted")).unionByName(moved)


def _exp(r: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(r)
    k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]])
    if a < 1e-8:
        return np.eye(3) + k
    return np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * (k @ k)


def _exps(r: np.ndarray) -> np.ndarray:
    """The same of many (n, 3)."""
    a = np.linalg.norm(r, axis=1)[:, None, None]
    k = np.cross(np.eye(3)[None], r[:, None]).transpose(0, 2, 1) * -1.0
    small = a < 1e-8
    safe = np.where(small, 1.0, a)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * k + np.where(small, 0.0, (1 - np.cos(safe)) / safe**2) * (k @ k)


def _log(m: np.ndarray) -> np.ndarray:
    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
    s, c = np.linalg.norm(v) / 2, (np.trace(m) - 1) / 2
    a = np.arctan2(s, c)
    if s > 1e-9:
        return v / (2 * s) * a
    if c > 0:
        return v / 2
    axis = np.sqrt(np.maximum(np.diag(m) + 1, 0) / 2)
    i = int(np.argmax(axis))
    return a * np.sign(m[i] + m[:, i] + 1e-300) * axis


def accelerometer_velocity(gyro: DataFrame, acc: DataFrame, intervals: DataFrame, by: list[str], width: float) -> DataFrame:
    """Velocity change (dv) in the axes of each interval's start: accelerations turned by the rotation so far and summed over
    segments that both sensors' samples cut; a segment's acceleration is the one at its midpoint."""
    g = integrals(gyro.withColumn("value", F.struct(F.col("t").alias("at"), "value")), intervals, by, width).select(*by, "k", "t0", "tf", F.lit("g").alias("kind"), "dt", F.col("value.at").alias("at"), F.col("value.value").alias("v"))
    a = integrals(acc.withColumn("value", F.struct(F.col("t").alias("at"), "value")), intervals, by, width).select(*by, "k", "t0", "tf", F.lit("a").alias("kind"), "dt", F.col("value.at").alias("at"), F.col("value.value").alias("v"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ga, aa = (pdf[pdf["kind"] == x].sort_values("at") for x in "ga")
        tg, ta = np.cumsum(ga["dt"].to_numpy()), np.cumsum(aa["dt"].to_numpy())
        cuts = np.unique(np.concatenate(([0.0], tg, ta)))
        long, mid = np.diff(cuts), (cuts[:-1] + cuts[1:]) / 2
        met = lambda rows, until: np.array(rows["v"].tolist(), float).reshape(len(rows), 3)[np.minimum(np.searchsorted(until, mid), len(rows) - 1)]
        turn, dv = np.eye(3), np.zeros(3)
        if len(mid):
            w, pushes = met(ga, tg), met(aa, ta) * long[:, None]
            # Turns are made of all segments at once; only their product is taken one by one.
            whole, turns = _exps(w * long[:, None]), np.empty((len(mid) + 1, 3, 3))
            turns[0] = turn
            for n, m in enumerate(whole):
                turns[n + 1] = turns[n] @ m
            turn, dv = turns[-1], np.einsum("nij,njk,nk->i", turns[:-1], _exps(w * long[:, None] / 2), pushes, optimize=True)
        first = pdf.iloc[[0]][[*by, "k", "t0", "tf"]].copy()
        first["dv"] = [dv.tolist()]
        first["r"] = [_log(turn).tolist()]
        return first

    ddl = g.unionByName(a)
    schema = ", ".join(f"`{c}` {ddl.schema[c].dataType.simpleString()}" for c in (*by, "k", "t0", "tf")) + ", dv array<double>, r array<double>"
    # Pieces are small in bytes and long in time, so as many tasks as there may be take them.
    return ddl.repartition(int(acc.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "k").groupBy(*by, "k").applyInPandas(one, schema)


def _segment_starts(batches):
    """Rows come series by series in order of t, _i counting from 1: those that begin a segment. From batch to batch only a time is held over."""
    until = 0.0
    for b in batches:
        t, least, place = (b.column(c).to_numpy() for c in ("t", "_least", "_i"))
        mark = np.zeros(len(t), bool)
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(place == 1), [len(t)])))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            k = lo if place[lo] == 1 else lo + int(np.searchsorted(t[lo:hi], until))
            while k < hi:
                mark[k] = True
                until = t[k] + least[k]
                k += 1 + int(np.searchsorted(t[k + 1 : hi], until))
        yield b.filter(pa.array(mark))


def _in_order(poses: DataFrame, by: list[str], *more) -> DataFrame:
    timed = poses.where("t is not null and not isnan(t)")
    return timed.select(*by, "t", "pose", *more).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("t")).cast("long"))


def segments(poses: DataFrame, by: list[str], least: Column) -> DataFrame:
    """Greedy segments: each begins where the last one ended and ends at the first pose that is `least` seconds later at least.

    by, k (place of its first pose), steps (poses that it spans), t0, tf and the poses a and b. The scan reads a series as a stream and holds one time.
    """
    ranked = _in_order(poses, by, least.cast("double").alias("_least"))
    starts = ranked.mapInArrow(_segment_starts, ranked.schema)
    after = lambda c: F.lead(c).over(Window.partitionBy(*by).orderBy("_i"))
    both = starts.select(*by, F.col("_i").alias("k"), (after("_i") - F.col("_i")).alias("steps"), F.col("t").alias("t0"), after("t").alias("tf"), F.col("pose").alias("a"), after("pose").alias("b"))
    return both.where("tf > t0")


def consistency(poses: DataFrame, gyro: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Greedy segments of at least `least` seconds of each trajectory with the gyro's rotation error (err, 3) against the poses'."""
    s = segments(poses, by, F.lit(least))
    turned = gyro_rotation(gyro, s.select(*by, "k", "t0", "tf"), by, least).select(*by, "k", "r")
    q = lambda r: R.quaternion_of_vector(r)
    error = R.times_quaternion(R.times_quaternion(q(scale(F.col("b.r"), -1.0)), q(F.col("a.r"))), q(F.col("r")))
    return s.join(turned, [*by, "k"]).withColumn("_q", error).select(*by, "t0", "tf", R.vector_of_quaternion(F.col("_q")).alias("err"))


def alignment(poses: DataFrame, gyro: DataFrame, acc: DataFrame, by: list[str], width: float = 1.0) -> DataFrame:
    """What sensors and poses say of each greedy segment of 0.1 s, or a hundredth of the trajectory if that is shorter.

    by, k, t0, tf; rot_gyro and rot_poses, rotation vectors of the segment; m0 and m1, the middles of the segment and of as many poses after it, and
    acc_sensor and acc_poses between these, in the axes at m0, without gravity (9.81 along z). These four are null where the trajectory ends before.
    """
    spans = poses.groupBy(*by).agg(F.least(F.lit(0.1), (F.max("t") - F.min("t")) / 100).alias("_span"))
    s = segments(poses.join(spans, by), by, F.col("_span"))
    third = _in_order(poses, by).select(*by, (F.col("_i")).alias("_j"), F.col("t").alias("t3"), F.col("pose").alias("c"))
    s = s.withColumn("_j", F.col("k") + 2 * F.col("steps")).join(third, [*by, "_j"], "left").drop("_j")
    relative = lambda p: R.compose(F.col("_back.r"), F.col("_back.t"), F.col(f"{p}.r"), F.col(f"{p}.t"))
    s = s.withColumn("_back", R.inverse(F.col("a.r"), F.col("a.t"))).withColumn("_b", relative("b")).withColumn("_c", relative("c"))
    s = s.withColumn("m0", F.when(F.col("t3") > F.col("tf"), (F.col("t0") + F.col("tf")) / 2)).withColumn("m1", F.when(F.col("t3") > F.col("tf"), (F.col("tf") + F.col("t3")) / 2))
    half = scale(F.col("_b.r"), -0.5)
    gravity = R.rotate(half, R.rotate(F.col("_back.r"), vector(0, 0, 9.81)))
    per_second = lambda v, d: scale(v, 1 / F.nullif(d, F.lit(0.0)))
    gain = subtract(per_second(subtract(F.col("_c.t"), F.col("_b.t")), F.col("t3") - F.col("tf")), per_second(F.col("_b.t"), F.col("tf") - F.col("t0")))
    s = s.withColumn("_g", gravity).withColumn("_v", R.rotate(half, gain)).withColumn("acc_poses", F.when(F.col("m0").isNotNull(), per_second(F.col("_v"), F.col("m1") - F.col("m0"))))
    turned = gyro_rotation(gyro, s.select(*by, "k", "t0", "tf"), by, width).select(*by, "k", F.col("r").alias("rot_gyro"))
    middles = s.where("m0 is not null").select(*by, "k", F.col("m0").alias("t0"), F.col("m1").alias("tf"))
    pushed = accelerometer_velocity(gyro, acc, middles, by, width).select(*by, "k", "dv")
    both = s.join(turned, [*by, "k"], "left").join(pushed, [*by, "k"], "left")
    sensed = subtract(per_second(F.col("dv"), F.col("m1") - F.col("m0")), F.col("_g"))
    return both.select(*by, "k", "t0", "tf", "rot_gyro", F.col("_b.r").alias("rot_poses"), "m0", "m1", sensed.alias("acc_sensor"), "acc_poses")


def error_statistics(errors: DataFrame, by: list[str]) -> DataFrame:
    """Of vectors err: mean and largest value by sign for each axis, root mean square and largest norm, mean and variance of the norm."""
    n2 = F.aggregate("err", F.lit(0.0), lambda s, x: s + x * x)
    axes = [f(F.col("err")[i]).alias(f"{name}{i}") for i in range(3) for name, f in (("mean", F.avg), ("maxabs", lambda c: F.max_by(c, F.abs(c))))]
    return errors.groupBy(*by).agg(*axes, F.sqrt(F.avg(n2)).alias("rms"), F.sqrt(F.max(n2)).alias("max_norm"), F.avg(F.sqrt(n2)).alias("mean_norm"), F.var_pop(F.sqrt(n2)).alias("var_norm"))


def centred(poses: DataFrame, by: list[str]) -> DataFrame:
    """Positions less their mean."""
    mean = poses.groupBy(*by).agg(*[F.avg(F.col("pose.t")[i]).alias(f"_m{i}") for i in range(3)])
    shift = F.array(*[-F.col(f"_m{i}") for i in range(3)])
    return poses.join(mean, by).withColumn("pose", F.struct(F.col("pose.r").alias("r"), add(F.col("pose.t"), shift).alias("t"))).drop("_m0", "_m1", "_m2")
