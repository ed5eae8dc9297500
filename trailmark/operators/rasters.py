"""Rasters as rows (i, j, v), rays, and the pyramid of cell ranges that prunes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import geotransform
from ..functions.vectors import cross, dot, subtract
from .rounds import shared_folder, written

#: Share of the numbers in it by which a comparison may be off.
SLACK = 1e-9


def valid(v: Column) -> Column:
    """The height, null where it is nodata: below -9000 or not finite."""
    return F.when((v >= -9000) & (F.abs(v) < float("inf")) & ~F.isnan(v), v)


def lattice(raster: DataFrame, transform: Column) -> DataFrame:
    """Map positions (x, y, z) of the cells, less their mean."""
    at = raster.withColumn("_p", geotransform(transform, F.col("i"), F.col("j"))).select(*[c for c in raster.columns if c != "v"], F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), valid(F.col("v")).alias("z"))
    mean = at.agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    return at.crossJoin(F.broadcast(mean)).select(*[c for c in at.columns if c not in "xyz"], *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"])


def corner_ranges(raster: DataFrame) -> DataFrame:
    """Least and largest valid value of the four corners of each cell between lattice points (level 0)."""
    ends = raster.agg(F.max("i").alias("ni"), F.max("j").alias("nj"))
    near = F.array(*[F.struct((F.col("i") - di).alias("ci"), (F.col("j") - dj).alias("cj")) for di in (0, 1) for dj in (0, 1)])
    spread = raster.select(valid(F.col("v")).alias("v"), F.explode(near).alias("c")).select("v", "c.ci", "c.cj").crossJoin(F.broadcast(ends))
    inside = spread.where("ci >= 0 and cj >= 0 and ci < ni and cj < nj")
    return inside.groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def pyramid(raster: DataFrame, levels: int) -> DataFrame:
    """(level, i, j, low, high): level 0 the cells, each next one halves both axes, rounding up.

    A level's cell covers 2^level cells of level 0, so all levels come from one aggregation over level 0.
    """
    base = corner_ranges(raster)
    each = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    half = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    return each.groupBy("level", half("i").alias("i"), half("j").alias("j")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def slab(origin: Column, direction: Column, low: Column, high: Column) -> Column:
    """STRUCT<near, far> of a ray in a box, null where it misses; forward only."""
    along = [F.when(direction[k] != 0, direction[k]) for k in range(3)]
    ends = [((low[k] - origin[k]) / along[k], (high[k] - origin[k]) / along[k]) for k in range(3)]
    inf = F.lit(float("inf"))
    flat = [direction[k] == 0 for k in range(3)]
    outside = [(origin[k] < low[k]) | (origin[k] > high[k]) for k in range(3)]
    near = F.greatest(*[F.when(flat[k], F.when(outside[k], inf).otherwise(-inf)).otherwise(F.least(*ends[k])) for k in range(3)])
    far = F.least(*[F.when(flat[k], F.when(outside[k], -inf).otherwise(inf)).otherwise(F.greatest(*ends[k])) for k in range(3)])
    return F.when((near <= far) & (far >= 0), F.struct(F.greatest(near, F.lit(0.0)).alias("near"), far.alias("far")))


def triangle_hit(origin: Column, direction: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance along a ray to a triangle (Moeller and Trumbore), null where it misses or lies behind."""
    e1, e2 = subtract(b, a), subtract(c, a)
    p = cross(direction, e2)
    det = dot(e1, p)
    det = F.when(F.abs(det) > 1e-12, det)
    s = subtract(origin, a)
    q = cross(s, e1)
    u, v, t = dot(s, p) / det, dot(direction, q) / det, dot(e2, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def levels_of(raster: DataFrame, path: str) -> list[DataFrame]:
    """Written levels (i, j, low, high) of the pyramid, each made of the one below, up to a single cell; an empty raster has none."""
    level = written(corner_ranges(raster), f"{path}/level0")
    out = []
    while True:
        ni, nj = level.agg(F.max("i"), F.max("j")).first()
        if ni is None:
            return out
        out.append(level)
        if ni == 0 and nj == 0:
            return out
        half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
        level = written(level.groupBy(half("i"), half("j")).agg(F.min("low").alias("low"), F.max("high").alias("high")), f"{path}/level{len(out)}")


def _entered(nodes: DataFrame, level: DataFrame, size: float) -> DataFrame:
    """nodes (ray_id, origin, direction, i, j) of a level with `near`, where the ray comes into the box of the cell; those that it misses go.

    A box is wider than its cell by `SLACK` of the numbers that it is met by, so that rounding loses no ray along a border.
    """
    ends = [(F.col("j") * size, (F.col("j") + 1) * size), (F.col("i") * size, (F.col("i") + 1) * size), (F.col("low").cast("double"), F.col("high").cast("double"))]
    slack = [(F.abs(F.col("origin")[k]) + F.abs(a) + F.abs(b) + 1) * SLACK for k, (a, b) in enumerate(ends)]
    low, high = (F.array(*[e[n] + (2 * n - 1) * s for e, s in zip(ends, slack, strict=True)]) for n in (0, 1))
    met = nodes.join(level.where("low is not null"), ["i", "j"]).withColumn("near", slab(F.col("origin"), F.col("direction"), low, high)["near"])
    return met.where("near is not null").select("ray_id", "origin", "direction", "i", "j", "near")


def _children(nodes: DataFrame) -> DataFrame:
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    return nodes.withColumn("c", F.explode(four)).select("ray_id", "origin", "direction", (F.col("i") * 2 + F.col("c.a")).alias("i"), (F.col("j") * 2 + F.col("c.b")).alias("j"))


def _struck(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(ray_id, distance, i, j): hits of rays on the two triangles of level 0 cells."""
    corner = lambda di, dj: F.array((F.col("j") + dj).cast("double"), (F.col("i") + di).cast("double"), F.col(f"v{di}{dj}").cast("double"))
    o, d = F.col("origin"), F.col("direction")
    hit = F.least(triangle_hit(o, d, corner(0, 0), corner(0, 1), corner(1, 0)), triangle_hit(o, d, corner(1, 1), corner(1, 0), corner(0, 1)))
    return nodes.join(cells, ["i", "j"]).withColumn("distance", hit).where("distance is not null").select("ray_id", "distance", "i", "j")


def ray_hits(raster: DataFrame, rays: DataFrame, beam: int = 2) -> DataFrame:
    """Nearest hit (ray_id, distance, i, j) of rays (ray_id, origin, direction) on the surface of a raster with unit cells, however far; without one, distance is NaN.

    Rays go down the pyramid from its one top cell, level by level: a cell's four children are met by equal places, and only those whose box
    of place and height range a ray comes into go on. A first descent follows each ray's `beam` nearest cells and so finds a hit of most rays that have one; the
    second one takes all cells, but none that a ray comes into beyond that hit. So the cells tested are those along the rays near the
    surface, up to the hit. Cells without a whole triangle of valid heights have none. ray_id tells rays apart.
    """
    path = shared_folder(raster.sparkSession, "rays")
    levels = levels_of(raster, path)
    z = raster.select("i", "j", valid(F.col("v")).alias("v"))
    at = lambda di, dj, name: z.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("v").alias(name))
    cells = at(0, 0, "v00").join(at(0, 1, "v01"), ["i", "j"]).join(at(1, 0, "v10"), ["i", "j"]).join(at(1, 1, "v11"), ["i", "j"])
    nan = F.lit(float("nan"))
    if not levels:
        return rays.select("ray_id", nan.alias("distance"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"))
    cells = written(cells, f"{path}/cells")
    top = len(levels) - 1
    start = rays.select("ray_id", F.col("origin").cast("array<double>").alias("origin"), F.col("direction").cast("array<double>").alias("direction"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    start = written(_entered(start, levels[top], float(2**top)), f"{path}/start")

    first = start
    for k in range(top - 1, -1, -1):
        first = _entered(_children(first), levels[k], float(2**k))
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("ray_id").orderBy("near", "i", "j"))).where(F.col("rank") <= beam).drop("rank")
        first = written(first, f"{path}/first{k}")
    bound = written(_struck(first, cells).groupBy("ray_id").agg(F.min("distance").alias("bound")), f"{path}/bound")
    every = written(start.join(bound, "ray_id", "left"), f"{path}/bounded")
    for k in range(top - 1, -1, -1):
        limits = every.select("ray_id", "bound").distinct()
        every = _entered(_children(every), levels[k], float(2**k)).join(limits, "ray_id").where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + SLACK)))
        every = written(every, f"{path}/every{k}")
    hits = _struck(every, cells).groupBy("ray_id").agg(F.min(F.struct("distance", "i", "j")).alias("h"))
    return rays.select("ray_id").join(hits, "ray_id", "left").select("ray_id", F.coalesce("h.distance", nan).alias("distance"), F.col("h.i").alias("i"), F.col("h.j").alias("j"))


def coverage(raster: DataFrame, points: DataFrame) -> DataFrame:
    """raster with `seen`, whether a point (y, x in cells) rounds to the cell."""
    marks = points.select(F.floor(F.col("y") + 0.5).alias("i"), F.floor(F.col("x") + 0.5).alias("j")).distinct().withColumn("_m", F.lit(True))
    return raster.join(marks, ["i", "j"], "left").withColumn("seen", F.coalesce("_m", F.lit(False))).drop("_m")


def validity(raster: DataFrame, shown: int = 15) -> DataFrame:
    """Counts, statistics of valid cells and the first bad cells by place."""
    v = valid(F.col("v"))
    bad = F.when(v.isNull(), F.struct("i", "j"))
    first = raster.where(v.isNull()).select("i", "j").orderBy("i", "j").limit(shown).agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("bad"))
    return raster.agg(F.count(F.lit(1)).alias("n"), F.count(bad).alias("n_bad"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean")).crossJoin(first)


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def max_normalised(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """pixels with value divided by the largest one of its raster, or by 1 where that is below 1; values that aren't numbers count for nothing."""
    top = pixels.where(~F.isnan(value)).groupBy(*by).agg(F.greatest(F.max(value), F.lit(1.0)).alias("top"))
    return pixels.join(top, by, "left").withColumn(value, F.col(value) / F.coalesce("top", F.lit(1.0))).drop("top")
