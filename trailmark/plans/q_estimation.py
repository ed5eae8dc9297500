"""Estimation in rounds over made scenes: SQL has the scene as it was before it was disturbed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import rotations as R
from ..functions.vectors import subtract, times_vector, transposed, vector
from ..operators.bundle import Scene
from ..operators.forest import spanning_poses
from .common import Registry, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded


@_R.add(
    "estimation_spanning_poses",
    f"""WITH p AS (SELECT c_custkey AS id, c_custkey % 5 AS g, c_custkey * 37 % 61 * 0.1::DOUBLE AS h, c_custkey * 13 % 101 AS x, c_custkey * 7 % 89 AS y, c_custkey % 17 AS z FROM customer),
    o AS (SELECT g, min_by(struct_pack(id := id, h := h, x := x, y := y, z := z), id) AS o FROM p GROUP BY g)
    SELECT id, o.id AS root, {sr('cos(o.h) * (x - o.x) + sin(o.h) * (y - o.y)', 4)} AS x, {sr('cos(o.h) * (y - o.y) - sin(o.h) * (x - o.x)', 4)} AS y, {sr('(z - o.z)::DOUBLE', 4)} AS z, {sr('cos(h - o.h)', 4)} AS heading FROM p JOIN o USING (g)""",
)
def estimation_spanning_poses(spark, d):
    """Poses of images from relative poses of pairs, in five groups that no pair connects."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k % 5).alias("g"), vector(F.lit(0.0), F.lit(0.0), k * 37 % 61 * 0.1).alias("r"), vector(k * 13 % 101, k * 7 % 89, k % 17).alias("t"))
    pairs = p.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 5, F.col("id") + 35, F.floor(F.col("id") / 15) * 5 + F.col("g")).cast("array<long>")).alias("b")).where("a <> b")
    side = lambda c: p.select(F.col("id").alias(c), F.struct("r", "t").alias(f"p{c}"))
    met = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("back", R.inverse(F.col("pa.r"), F.col("pa.t")))
    edges = met.select("a", "b", ((F.col("a") * 31 + F.col("b")) % 17).alias("weight"), R.compose(F.col("back.r"), F.col("back.t"), F.col("pb.r"), F.col("pb.t")).alias("pose"))
    out = spanning_poses(p.select("id"), edges)[0]
    return out.select("id", "root", *[r(F.col("pose.t")[i], 4).alias(c) for i, c in enumerate("xyz")], r(F.cos(F.col("pose.r")[2]), 4).alias("heading"))


_SPOT = "p_partkey % (n - 3) * 1.0 + 1.5 + p_partkey * 37 % 100 / 50.0::DOUBLE AS x, p_partkey * 53 % 100 / 40.0::DOUBLE - 1.2 AS y, 8 + p_partkey * 71 % 100 / 25.0::DOUBLE AS z"


@_R.add(
    "estimation_bundle",
    f"""WITH s AS (SELECT count(*) AS n FROM supplier), a AS (SELECT 'camera' AS kind, s_suppkey AS id, s_suppkey * 1.0::DOUBLE AS x, s_suppkey % 3 * 0.5::DOUBLE AS y, 0.0::DOUBLE AS z FROM supplier UNION ALL SELECT 'landmark', p_partkey, {_SPOT} FROM part, s)
    SELECT kind, id, {sr('x', 3)} AS x, {sr('y', 3)} AS y, {sr('z', 3)} AS z FROM a""",
)
def estimation_bundle(spark, d):
    """Cameras along a line, landmarks before them, each seen by four cameras in a row; all start disturbed and come back to where they were."""
    n, k, c = table(spark, d, "supplier").count(), F.col("p_partkey"), F.col("s_suppkey")
    true = table(spark, d, "supplier").select(c.alias("id"), vector(F.lit(0.0), (c % 5 - 2) * 0.02, F.lit(0.0)).alias("r"), vector(c, c % 3 * 0.5, F.lit(0.0)).alias("t"))
    spots = table(spark, d, "part").select(k.alias("id"), vector(k % (n - 3) + 1.5 + k * 37 % 100 / 50.0, k * 53 % 100 / 40.0 - 1.2, 8 + k * 71 % 100 / 25.0).alias("p"))
    cameras = true.select("id", F.transform("r", lambda x: x + (F.col("id") % 3 - 1) * 0.001).alias("r"), F.transform("t", lambda x: x + (F.col("id") % 4 - 1.5) * 0.01).alias("t"), F.lit(1000.0).alias("f"), vector(640, 480).alias("pp"), F.lit(False).alias("fixed"), F.col("t").alias("prior"), F.lit(200.0).alias("weight"))
    points = spots.select("id", F.transform("p", lambda x: x + (F.col("id") % 7 - 3) * 0.01).alias("p"))
    seen = spots.select(F.col("id").alias("point"), "p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("id") % (n - 3) + 1 + i).cast("array<long>")).alias("camera"))
    inside = times_vector(transposed(R.rotation_matrix(F.col("r"))), subtract(F.col("p"), F.col("t")))
    at = seen.join(true.withColumnRenamed("id", "camera"), "camera").withColumn("uv", cam.reprojection(inside, F.lit(1000.0), vector(640, 480)))
    scene = Scene(cameras, points, at.select("camera", "point", F.col("uv")[0].alias("u"), F.col("uv")[1].alias("v"), F.lit(1.0).alias("sigma")))
    scene.adjust(rounds=3, damping=1e-6, near=1e-2, enough=1e-4)
    out = scene.cameras.select(F.lit("camera").alias("kind"), "id", F.col("t").alias("p")).unionAll(scene.points.select(F.lit("landmark"), "id", "p"))
    return out.select("kind", "id", *[r(F.col("p")[i], 3).alias(x) for i, x in enumerate("xyz")])


QUERIES, ORACLES = _R.queries, _R.oracles
