"""Robust filtering of matches between image pairs: seeded samples, models of samples, counted inliers, and a second pass by neighbours.

A pair of images is never one task's work: places in the order of matches are dealt by ranges, a sample is a few rows, and inliers are counted for chunks of
matches against the pair's models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import nearest_in_plane
from .rounds import joined, placed, shared_folder, written

#: Matches that a model needs: four for a perspective transform, eight for epipolar geometry.
NEEDED = {"perspective": 4, "epipolar": 8}
CHUNK = 1024


def perspective(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3x3 transform that takes points a to b, least squares over normalised points; None where points are too alike to tell."""
    m, told = perspectives(a[None], b[None])
    return m[0] if told[0] else None


def perspectives(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of many sets of equally many points (k, n, 2): transforms (k, 3, 3), and which of them can be told."""
    (na, ca, sa), (nb, cb, sb) = _normalised(a), _normalised(b)
    x, y, u, v = na[..., 0], na[..., 1], nb[..., 0], nb[..., 1]
    o, l = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, l, o, o, o, -u * x, -u * y, -u], 2), np.stack([o, o, o, x, y, l, -v * x, -v * y, -v], 2)], 1)
    m = _back(cb, sb) @ np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3) @ _there(ca, sa)
    with np.errstate(all="ignore"):
        det = np.abs(np.linalg.det(m / np.sqrt((m * m).sum((1, 2), keepdims=True))))
    return m, (sa > 0) & (sb > 0) & np.isfinite(m).all((1, 2)) & (det > 1e-12)


def epipolar(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The 3x3 matrix of rank two with b^T m a = 0, least squares over normalised points."""
    m, told = epipolars(a[None], b[None])
    return m[0] if told[0] else None


def epipolars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of many sets of equally many points."""
    (na, ca, sa), (nb, cb, sb) = _normalised(a), _normalised(b)
    x, y, u, v = na[..., 0], na[..., 1], nb[..., 0], nb[..., 1]
    rows = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, np.ones_like(x)], 2)
    u_, s, vt = np.linalg.svd(np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3))
    s[:, 2] = 0
    m = _there(cb, sb).transpose(0, 2, 1) @ (u_ * s[:, None] @ vt) @ _there(ca, sa)
    return m, (sa > 0) & (sb > 0) & np.isfinite(m).all((1, 2))


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of points (k, n, 2) around 0 and of one size, their centres, and by what they were multiplied: 0, with points all 0, where they are too alike or not finite."""
    centre = p.mean(1)
    with np.errstate(all="ignore"):
        size = np.sqrt(((p - centre[:, None]) ** 2).sum(2).mean(1))
        s = np.where(np.isfinite(size) & (size >= 1e-12), np.sqrt(2) / size, 0.0)
    good = s[:, None] > 0
    return np.where(good[..., None], (p - centre[:, None]) * s[:, None, None], 0.0), np.where(good, centre, 0.0), s


def _there(centre: np.ndarray, s: np.ndarray) -> np.ndarray:
    t = np.zeros((len(s), 3, 3))
    t[:, 0, 0], t[:, 1, 1], t[:, 2, 2] = s, s, 1
    t[:, :2, 2] = -s[:, None] * centre
    return t


def _back(centre: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The inverse of `_there`."""
    t = np.zeros((len(s), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = 1 / np.where(s > 0, s, 1)
    t[:, 2, 2] = 1
    t[:, :2, 2] = centre
    return t


def error(model: str, m: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of (x2, y2) to where the transform takes (x1, y1), or to the epipolar line of (x1, y1)."""
    p = [m[3 * i] * x1 + m[3 * i + 1] * y1 + m[3 * i + 2] for i in range(3)]
    if model == "perspective":
        dx, dy = p[0] / p[2] - x2, p[1] / p[2] - y2
        return F.when(p[2] != 0, F.sqrt(dx * dx + dy * dy))
    size = F.sqrt(p[0] * p[0] + p[1] * p[1])
    return F.when(size > 0, F.abs(x2 * p[0] + y2 * p[1] + p[2]) / size)


def _errors(model: str, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same of matches x (n, 4) under models m (k, 9): (k, n)."""
    p = m.reshape(-1, 3, 3) @ np.stack([x[:, 0], x[:, 1], np.ones(len(x))])
    with np.errstate(all="ignore"):
        if model == "perspective":
            e = np.hypot(p[:, 0] / p[:, 2] - x[:, 2], p[:, 1] / p[:, 2] - x[:, 3])
        else:
            e = np.abs(x[:, 2] * p[:, 0] + x[:, 3] * p[:, 1] + p[:, 2]) / np.hypot(p[:, 0], p[:, 1])
    return np.where(np.isfinite(e), e, np.inf)


def _fit(model: str, kept: list[str]):
    solve = {"perspective": perspectives, "epipolar": epipolars}[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p")  # lists of points (x1, y1, x2, y2)
            sizes = np.diff(p.offsets.to_numpy())
            x = p.flatten().flatten().to_numpy().reshape(-1, 4)
            starts = np.cumsum(sizes) - sizes
            models, told = np.zeros((len(sizes), 9)), np.zeros(len(sizes), bool)
            for n in np.unique(sizes):
                own = np.nonzero(sizes == n)[0]
                sets = x[starts[own, None] + np.arange(n)]
                m, told[own] = solve(sets[..., :2], sets[..., 2:])
                models[own] = m.reshape(-1, 9)
            at, models = np.nonzero(told)[0], models[told]
            m = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 9), pa.array(models.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in kept), m], names=[*kept, "m"])

    return run


def _counted(model: str, by: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = b.column("p")[r].values.flatten().to_numpy().reshape(-1, 4)
                models = b.column("models")[r].values
                m = np.array(models.field("m").to_pylist(), float)
                n = (_errors(model, m, x) <= threshold).sum(1)
                at = pa.array(np.full(len(n), r))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in by), models.field("round"), pa.array(n.astype(np.int64))], names=[*by, "round", "n"])

    return run


def samples(sizes: DataFrame, by: list[str], need: int, rounds: int, seed: int) -> DataFrame:
    """(by, round, places): `need` different places below n of each group (by, n), the same for one seed; a place k is drawn about in proportion to 1 / (k + 1)."""
    r = sizes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    even = lambda d: (F.xxhash64(*by, "round", F.lit(d), F.lit(seed)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    drawn = [F.least(F.floor(F.exp(even(d) * F.log(F.col("n") + 1.0))).cast("long") - 1, F.col("n") - 1) for d in range(need)]
    # A place that is taken gives way to the next free one.
    free = lambda acc, x: F.concat(acc, F.array(F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(need).cast("long")), lambda s: (x + s) % F.col("n")), lambda y: ~F.array_contains(acc, y))[0]))
    return r.select(*by, "round", F.aggregate(F.array(*drawn), F.array().cast("array<long>"), free).alias("places"))


def robust(matches: DataFrame, by: list[str], model: str, threshold: float, rounds: int = 200, seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """matches (x1, y1, x2, y2, match_id) with `inlier`: whether they are within the threshold of the model of most inliers among `rounds` samples.

    model: perspective (transfer error) or epipolar (distance to the line). Groups with fewer matches than a model needs are kept whole. Earlier
    matches, in `order` (match_id unless given), are drawn more often. Of models with equally many inliers the first counts.
    """
    path, need = shared_folder(matches.sparkSession, "robust"), NEEDED[model]
    xy = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    at = placed(matches.select(*by, "match_id", xy.alias("p"), *[o.alias(f"o{i}") for i, o in enumerate(order or [])]), by, [*[F.col(f"o{i}") for i in range(len(order or []))], F.col("match_id")], "place", f"{path}/dealt")
    at = written(at.select(*by, "match_id", "p", "place"), f"{path}/placed")
    sizes = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    drawn = samples(sizes.where(F.col("n") >= need), by, need, rounds, seed).select(*by, "round", F.explode("places").alias("place"))
    sets = joined(drawn, at.select(*by, "place", "p"), [*by, "place"]).groupBy(*by, "round").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("s")).select(*by, "round", F.col("s.p").alias("p"))
    kinds = "".join(f"`{b}` {at.schema[b].dataType.simpleString()}, " for b in by)
    models = written(sets.mapInArrow(_fit(model, [*by, "round"]), f"{kinds}round int, m array<double>"), f"{path}/models")
    every = models.groupBy(*by).agg(F.collect_list(F.struct("round", "m")).alias("models"))  # `rounds` of a group
    chunks = at.groupBy(*by, F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.collect_list("p").alias("p"))
    counts = joined(chunks, every, by).select(*by, "p", "models").mapInArrow(_counted(model, by, threshold), f"{kinds}round int, n long")
    best = counts.groupBy(*by, "round").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.max(F.struct("n", (-F.col("round")).alias("first"))).alias("b"))
    best = written(joined(models, best, by).where(F.col("round") == -F.col("b.first")).select(*by, "m"), f"{path}/best")
    few = sizes.where(F.col("n") < need).select(*by, F.lit(True).alias("few"))
    told = joined(joined(matches, best, by, "left"), few, by, "left")
    e = error(model, F.col("m"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    return told.withColumn("inlier", F.coalesce(F.col("few"), e <= threshold, F.lit(False))).drop("m", "few")


def by_neighbours(inliers: DataFrame, by: list[str], threshold: float, neighbours: int = NEEDED["perspective"] + 3) -> DataFrame:
    """Of inliers (match_id, x1, y1, x2, y2) those within the threshold of the perspective transform of their nearest other inliers in the first image.

    With fewer than four others there is no such transform, and an inlier goes.
    """
    near = nearest_in_plane(inliers.select(*by, F.col("match_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")), by, neighbours)
    there = inliers.select(*by, F.col("match_id").alias("other"), F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("p"))
    sets = joined(near, there, [*by, "other"], wide=True).groupBy(*by, "id").agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("s")).where(F.size("s") >= NEEDED["perspective"])
    kinds = "".join(f"`{b}` {inliers.schema[b].dataType.simpleString()}, " for b in by)
    models = sets.select(*by, F.col("id").alias("match_id"), F.col("s.p").alias("p")).mapInArrow(_fit("perspective", [*by, "match_id"]), f"{kinds}match_id {inliers.schema['match_id'].dataType.simpleString()}, m array<double>")
    e = error("perspective", F.col("m"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    return joined(inliers, models, [*by, "match_id"], wide=True).where(e <= threshold).drop("m")
