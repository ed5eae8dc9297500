"""Estimation: residuals as columns, least squares from distributed normal equations, alignment and resection for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotations as R
from ..functions.camera import reprojection
from ..functions.vectors import add, dot, norm, scale, subtract, times_vector, transposed
from .trajectories import _exp, _log

Residuals = Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def gauss_newton(rows: DataFrame, start: np.ndarray, residuals: Residuals, steps: int = 20, damping: float = 1e-6, near: float = 1e-10) -> dict:
    """Levenberg-Marquardt over all rows. Each step every task sums its rows' normal equations; only p * p numbers of a task come to the driver,
    p being the number of parameters (some hundreds at most). Returns x, the covariance block (J^T J)^-1 and the cost."""
    p = len(start)

    def normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, g, c = np.zeros((p, p)), np.zeros(p), 0.0
            for f in frames:
                if len(f):
                    r, j = residuals(x, f)
                    a, g, c = a + j.T @ j, g + j.T @ r, c + float(r @ r)
            yield pd.DataFrame({"k": np.arange(p * p + p + 1), "v": np.concatenate([a.ravel(), g, [c]])})

        v = np.zeros(p * p + p + 1)
        for row in rows.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            v[row["k"]] = row["v"]
        return v[: p * p].reshape(p, p), v[p * p : -1], v[-1]

    x, lam = np.array(start, float), damping
    a, g, cost = normal(x)
    for _ in range(steps):
        move = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
        a2, g2, cost2 = normal(x + move)
        if cost2 <= cost:
            done = np.linalg.norm(move) <= near * (1 + np.linalg.norm(x)) or cost - cost2 <= 1e-15 * cost
            x, a, g, cost, lam = x + move, a2, g2, cost2, lam / 10
            if done:
                break
        else:
            lam *= 10
    return {"x": x, "covariance": np.linalg.pinv(a), "cost": cost}


def distance_residual(p1: Column, p2: Column, d: Column) -> Column:
    return norm(subtract(p1, p2)) - d


def angle_residual(a: Column, apex: Column, b: Column, angle: Column) -> Column:
    """Differences of cosine and sine of the angle at apex; zeros where a side has no length."""
    u, v = subtract(a, apex), subtract(b, apex)
    size = norm(u) * norm(v)
    c = dot(u, v) / size
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    return F.when(size == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(c - F.cos(angle), s - F.sin(angle)))


def prior_residual(x: Column, mean: Column, weight: Column) -> Column:
    """L (x - mu) of a diagonal weight."""
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), weight.alias("w")), lambda e: e["w"] * (e["x"] - e["m"]))


def lever_arm_residual(pose_r: Column, pose_t: Column, arm: Column, measured: Column, sigma: Column) -> Column:
    """(R arm + t - measured) / sigma."""
    return scale(subtract(add(R.rotate(pose_r, arm), pose_t), measured), 1 / sigma)


def projection_residual(pose_r: Column, pose_t: Column, point: Column, f: Column, pp: Column, uv: Column) -> Column:
    """Reprojection less observation; the pose takes camera to world."""
    inside = times_vector(transposed(R.rotation_matrix(pose_r)), subtract(point, pose_t))
    return F.zip_with(reprojection(inside, f, pp), uv, lambda a, b: a - b)


def weighted(residual: Column, weight: Column) -> Column:
    return F.transform(residual, lambda x: x * weight)


def kabsch(pairs: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Rigid transform (r, t, rms) of each group that takes a to b; groups of fewer than `least` complete pairs are left out.

    Sums and products are aggregated first, so a group comes to a task as 16 numbers whatever its size.
    """
    whole = pairs.where(~F.exists("a", lambda x: x.isNull()) & ~F.exists("b", lambda x: x.isNull()))
    s = [F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in "ab" for i in range(3)]
    m = [F.sum(F.col("a")[i] * F.col("b")[j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    q = [F.sum(dot(F.col(k), F.col(k))).alias(f"q{k}") for k in "ab"]
    sums = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *s, *m, *q).where(F.col("n") >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, g in f.iterrows():
                n = g["n"]
                ca, cb = (np.array([g[f"{k}{i}"] for i in range(3)]) / n for k in "ab")
                h = np.array([[g[f"m{i}{j}"] for j in range(3)] for i in range(3)]) - n * np.outer(ca, cb)
                u, d, vt = np.linalg.svd(h)
                sign = np.sign(np.linalg.det(vt.T @ u.T))
                rot = vt.T @ np.diag([1, 1, sign]) @ u.T
                square = (g["qa"] - n * ca @ ca) + (g["qb"] - n * cb @ cb) - 2 * (d[0] + d[1] + sign * d[2])
                out.append((*[g[c] for c in by], int(n), _log(rot).tolist(), (cb - rot @ ca).tolist(), float(np.sqrt(max(0.0, square) / n))))
            yield pd.DataFrame(out, columns=[*by, "n", "r", "t", "rms"])

    schema = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by) + ", n long, r array<double>, t array<double>, rms double"
    return sums.mapInPandas(solve, schema)


def resection(observations: DataFrame, by: list[str], least: int = 4, steps: int = 60) -> DataFrame:
    """Pose (r, t, camera to world; rms) of each image from its landmarks (p, uv, f, pp): a start along the view axis, then damped Gauss-Newton."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, uv = np.array(pdf["p"].tolist()), np.array(pdf["uv"].tolist())
        f, pp = float(pdf["f"].iloc[0]), np.array(pdf["pp"].iloc[0])
        out = {c: [pdf[c].iloc[0]] for c in by}
        if len(p) < least:
            return pd.DataFrame(out | {"r": [None], "t": [None], "rms": [None]})
        centre, size = p.mean(0), max(1e-6, np.abs(p - p.mean(0)).max())

        def misfit(x: np.ndarray) -> np.ndarray:
            q = p @ _exp(x[:3]).T + x[3:]
            z = np.where(q[:, 2:] > 1e-9, q[:, 2:], 1e-9)
            return (f * q[:, :2] / z + pp - uv).ravel()

        best = None
        for turn in ([0, 0, 0], [0, np.pi, 0], [0, np.pi / 2, 0], [0, -np.pi / 2, 0], [np.pi / 2, 0, 0], [-np.pi / 2, 0, 0]):
            x = np.concatenate([turn, np.array([0, 0, 4 * size]) - _exp(np.array(turn, float)) @ centre])
            r, lam = misfit(x), 1e-3
            for _ in range(steps):
                j = np.stack([(misfit(x + e) - r) / 1e-6 for e in np.eye(6) * 1e-6], axis=1)
                move = np.linalg.lstsq(j.T @ j + lam * np.diag(np.diag(j.T @ j) + 1e-9), -j.T @ r, rcond=None)[0]
                r2 = misfit(x + move)
                x, r, lam = (x + move, r2, lam / 5) if r2 @ r2 < r @ r else (x, r, lam * 5)
                if lam > 1e12:
                    break
            if best is None or r @ r < best[0]:
                best = (r @ r, x)
        rot = _exp(best[1][:3])
        return pd.DataFrame(out | {"r": [_log(rot.T).tolist()], "t": [(-rot.T @ best[1][3:]).tolist()], "rms": [float(np.sqrt(best[0] / len(p)))]})

    schema = ", ".join(f"`{c}` {observations.schema[c].dataType.simpleString()}" for c in by) + ", r array<double>, t array<double>, rms double"
    return observations.groupBy(*by).applyInPandas(one, schema)


def triangulate(rays: DataFrame, by: list[str]) -> DataFrame:
    """Point nearest to all rays (o, d unit) of each landmark: the 3x3 normal equations are sums over the rays, solved by Cramer's rule."""
    eye = lambda i, j: 1.0 if i == j else 0.0
    d = F.col("d")
    a = {(i, j): F.sum(F.lit(eye(i, j)) - d[i] * d[j]) for i in range(3) for j in range(i, 3)}
    b = [F.sum(sum(((F.lit(eye(i, j)) - d[i] * d[j]) * F.col("o")[j] for j in range(1, 3)), (F.lit(eye(i, 0)) - d[i] * d[0]) * F.col("o")[0])) for i in range(3)]
    s = rays.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"a{i}{j}") for (i, j), v in a.items()], *[v.alias(f"b{i}") for i, v in enumerate(b)])
    m = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")

    def det(col: int | None) -> Column:
        e = lambda i, j: F.col(f"b{i}") if j == col else m(i, j)
        return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))

    whole = det(None)
    return s.where(F.col("n") >= 2).select(*by, "n", F.when(F.abs(whole) > 1e-12, F.array(det(0) / whole, det(1) / whole, det(2) / whole)).alias("p"))


def landmark_report(observations: DataFrame) -> DataFrame:
    """Per landmark: images, mean and largest reprojection error and position; observations have image_id, u, v, pose, p, f, pp.

    The residual is that of projection_residual, in steps over plain columns, each of which is computed once for a row in compiled code.
    """
    three = lambda c, n: [c[i].cast("double").alias(f"{n}{i}") for i in range(3)]
    o = observations.select("landmark_id", "image_id", *three(F.col("pose.r"), "r"), *three(F.col("pose.t"), "t"), *three(F.col("p"), "p"), F.col("f").alias("f"), F.col("pp")[0].alias("c0"), F.col("pp")[1].alias("c1"), "u", "v")
    o = o.withColumn("angle", F.expr("sqrt(r0 * r0 + r1 * r1 + r2 * r2)"))
    o = o.withColumn("half", F.expr("CASE WHEN angle < 1e-8D THEN 0.5D - angle * angle / 48 ELSE sin(angle / 2) / angle END"))
    o = o.withColumns({"w": F.cos(F.col("angle") / 2), "x": F.expr("r0 * half"), "y": F.expr("r1 * half"), "z": F.expr("r2 * half"), "d0": F.expr("p0 - t0"), "d1": F.expr("p1 - t1"), "d2": F.expr("p2 - t2")})
    o = o.withColumns({
        "i0": F.expr("(1 - 2 * (y * y + z * z)) * d0 + 2 * (x * y + w * z) * d1 + 2 * (x * z - w * y) * d2"),
        "i1": F.expr("2 * (x * y - w * z) * d0 + (1 - 2 * (x * x + z * z)) * d1 + 2 * (y * z + w * x) * d2"),
        "i2": F.expr("2 * (x * z + w * y) * d0 + 2 * (y * z - w * x) * d1 + (1 - 2 * (x * x + y * y)) * d2"),
    })
    nan = "CASE WHEN i2 < 0 THEN double('NaN') ELSE"
    o = o.withColumns({"e0": F.expr(f"{nan} f * i0 / i2 + c0 END - u"), "e1": F.expr(f"{nan} f * i1 / i2 + c1 END - v")})
    o = o.select("landmark_id", "image_id", F.expr("sqrt(e0 * e0 + e1 * e1)").alias("size"))
    return o.groupBy("landmark_id").agg(F.countDistinct("image_id").alias("n_images"), F.avg("size").alias("mean_error"), F.max("size").alias("max_error"))
