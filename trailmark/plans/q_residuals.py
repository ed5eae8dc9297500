"""Residuals of correspondences by pair of kinds, pose decorators and lever arms, on sides made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import vector
from ..operators import residuals as rs
from .common import Registry, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded


#: What each pair of kinds compares, and the kinds, in the order that has a formula.
PAIRS = [
    ("prior", "PRIOR", "XYZ"), ("place_world", "PRIORID", "GEOXYZ"), ("place_map", "PRIORID", "GEOXY"), ("point_point", "XYZ", "XYZ"), ("point_world", "XYZ", "GEOXYZ"), ("point_map", "XYZ", "GEOXY"), ("point_place", "XYZ", "PRIORID"),
    ("point_point", "XYZT", "XYZ"), ("point_point", "XYZT", "XYZT"), ("rays", "UV", "UV"), ("seen_point", "UV", "XYZ"), ("seen_world", "UV", "GEOXYZ"), ("seen_point", "UV", "XYZT"), ("rays", "UVT", "UV"), ("rays", "UVT", "UVT"),
    ("seen_point", "UVT", "XYZ"), ("seen_world", "UVT", "GEOXYZ"), ("seen_point", "UVT", "XYZT"), ("none", "XYZ", "LINE3D"), ("none", "UV", "GEOXY"),
]


def _of_pair(values):
    return F.array(*[F.lit(v) for v in values])[(F.col("p_partkey") % len(PAIRS)).cast("int")]


def _pairs(spark, d):
    """All pairs of kinds by key, with sigmas on both sides, one or none; every other round of keys has its sides in the order that has no formula."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    what, kind_a, kind_b = (_of_pair(v) for v in zip(*PAIRS, strict=True))
    x, q = F.col("p_size").cast("double"), (k % 7).cast("double")
    nothing = F.lit(None).cast("array<double>")
    image = lambda kind: kind.isin("UV", "UVT")
    pose_a = F.when(image(kind_a), rs.pose(vector(0, 0, 0), vector(0, 0, -20))).otherwise(rs.pose(vector(F.lit(0.0), F.lit(0.0), x * 0.01), vector(10, 0, 0)))
    pose_b = F.when(image(kind_b), rs.pose(vector(0, 0, 0), vector(5, 0, -20))).otherwise(rs.pose(vector(0, 0, 0), vector(0, 5, 0)))
    side = lambda kind, vals, sigmas: F.struct(kind.alias("kind"), vals.alias("vals"), sigmas.alias("sigmas"))
    a = side(kind_a, F.when(image(kind_a), vector(x, F.lit(3.0))).otherwise(vector(x, F.lit(1.0), F.lit(2.0))), F.when(k % 3 != 0, F.when(image(kind_a), F.array(F.lit(0.5), F.when(k % 2 == 0, 0.25))).otherwise(vector(2, 3, 4))).otherwise(nothing))
    b = side(kind_b, F.when(image(kind_b), vector(F.lit(1.0), q)).otherwise(vector(F.lit(3.0), q, F.lit(1.0))), F.when(k % 4 != 0, F.when(kind_b == "GEOXY", vector(0.5, 2)).otherwise(vector(1, 1, 2))).otherwise(nothing))
    back = F.floor(k / len(PAIRS)) % 2 == 1
    either = lambda one, two: [F.when(back, two).otherwise(one), F.when(back, one).otherwise(two)]
    columns = {"": (a, b), "_pose": (pose_a, pose_b), "_block": (k % 11, F.when(k % 13 == 0, k % 11).otherwise(k % 11 + 1))}
    sides = p.select("p_partkey", *[c.alias(f"{s}{n}") for n, (one, two) in columns.items() for s, c in zip("ab", either(one, two), strict=True)], *[c.alias(f"{s}_{n}") for s in "ab" for n, c in (("f", F.lit(100.0)), ("pp", vector(0, 0)), ("world", vector(1, 2, 3)), ("projector", vector(1, 0, 0, 0, 0.5, -0.5)), ("target", vector(0, 1)))])
    return rs.correspondence_residuals(sides, 2.0).withColumn("what", what)


_LIST = ", ".join(f"({i}, '{w}', '{a}', '{b}')" for i, (w, a, b) in enumerate(PAIRS))
_SQL = f"""WITH l(i, what, a, b) AS (VALUES {_LIST}),
p AS (SELECT p_partkey, what, a, b, p_partkey // {len(PAIRS)} % 2 = 1 AS back, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS q, a IN ('UV', 'UVT') AND b IN ('UV', 'UVT') AND p_partkey % 13 = 0 AS same,
    CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN a IN ('UV', 'UVT') THEN [0.5, CASE WHEN p_partkey % 2 = 0 THEN 0.25 END]::DOUBLE[] ELSE [2.0, 3.0, 4.0]::DOUBLE[] END END AS sa, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN b = 'GEOXY' THEN [0.5, 2.0]::DOUBLE[] ELSE [1.0, 1.0, 2.0]::DOUBLE[] END END AS sb FROM part JOIN l ON i = p_partkey % {len(PAIRS)}),
w AS (SELECT *, cos(x * 0.01) * x - sin(x * 0.01) + 10 AS wx, sin(x * 0.01) * x + cos(x * 0.01) AS wy FROM p),
e AS (SELECT *, CASE what WHEN 'prior' THEN [-3, 5 - q, -1] WHEN 'place_world' THEN [9, -2, -3] WHEN 'place_map' THEN [10, -1] WHEN 'point_point' THEN CASE WHEN back AND a = b THEN [3 - wx, q + 5 - wy, -1] ELSE [wx - 3, wy - q - 5, 1] END WHEN 'point_world' THEN [wx - 1, wy - 2, -1] WHEN 'point_map' THEN [wx, wy * 0.5 - 2]
    WHEN 'point_place' THEN [wx, wy - 5, 2] WHEN 'rays' THEN [(0.03 - q / 100) / (sqrt(x * x / 10000 + 0.0009 + 1) * sqrt(0.0001 + q * q / 10000 + 1))] WHEN 'seen_point' THEN [300 / 21.0::DOUBLE - x, 100 * (q + 5) / 21.0::DOUBLE - 3] WHEN 'seen_world' THEN [100 / 23.0::DOUBLE - x, 200 / 23.0::DOUBLE - 3] END::DOUBLE[] AS e,
    CASE WHEN what = 'rays' THEN [1.0]::DOUBLE[] WHEN what IN ('seen_point', 'seen_world') THEN [coalesce(sa[1], 0.5), coalesce(sa[2], 0.5)]::DOUBLE[] WHEN what IN ('place_map', 'point_map') THEN CASE WHEN sa IS NULL AND sb IS NULL THEN [0.5, 0.5]::DOUBLE[] ELSE [coalesce(sa[1], 0) + coalesce(sb[1], 0), coalesce(sa[2] * 0.5 + sa[3] * 0.5, 0) + coalesce(sb[2], 0)] END
    WHEN sa IS NULL AND sb IS NULL THEN [0.5, 0.5, 0.5]::DOUBLE[] ELSE [coalesce(sa[1], 0) + coalesce(sb[1], 0), coalesce(sa[2], 0) + coalesce(sb[2], 0), coalesce(sa[3], 0) + coalesce(sb[3], 0)] END AS s FROM w),
z AS (SELECT p_partkey, CASE WHEN back AND what = 'none' AND b = 'GEOXY' THEN b ELSE a END AS kind_a, CASE WHEN back AND what = 'none' AND b = 'GEOXY' THEN a ELSE b END AS kind_b, CASE WHEN same THEN 'same' WHEN what <> 'none' THEN 'used' WHEN b = 'LINE3D' THEN 'unsupported' ELSE 'unknown' END AS state, CASE WHEN NOT same THEN list_transform(range(1, len(e) + 1), lambda i: e[i] / (2 * s[i])) END AS e FROM e)"""


@_R.add("residuals_by_kind", f"{_SQL} SELECT p_partkey, kind_a, kind_b, state, {sr('e[1]')} AS r0, {sr('e[2]')} AS r1, {sr('e[3]')} AS r2 FROM z")
def residuals_by_kind(spark, d):
    e = _pairs(spark, d)
    return e.select("p_partkey", F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b"), "state", *[r(F.get("residual", F.lit(i))).alias(f"r{i}") for i in range(3)])


@_R.add("residual_counts", f"{_SQL} SELECT kind_a, kind_b, state, count(*) AS n, {sr('sqrt(avg(list_sum(list_transform(e, lambda v: v * v))))')} AS rms FROM z GROUP BY ALL")
def residual_counts(spark, d):
    return rs.residual_counts(_pairs(spark, d)).select("kind_a", "kind_b", "state", "n", r(F.col("rms")).alias("rms"))


_TURN = "t AS (SELECT p_partkey AS id, cos(p_size * 0.05::DOUBLE) AS c, sin(p_size * 0.05::DOUBLE) AS s, p_size::DOUBLE AS x FROM part)"


def _turned(spark, d):
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), rs.pose(vector(F.lit(0.0), F.lit(0.0), x * 0.05), vector(x, F.lit(2.0), F.lit(-1.0))).alias("p"))


@_R.add("residual_lever_arms", f"WITH {_TURN} SELECT id, {sr('c * 0.5 - s * 0.25 + x - 1')} AS px, {sr('s * 0.5 + c * 0.25 + 2 - 1')} AS py, {sr('3 - 0.1 * (s * 0.5 + c * 0.25)')} AS vx, {sr('0.1 * (c * 0.5 - s * 0.25)')} AS vy, {sr('sqrt(pow(c * 0.5 - s * 0.25 + x, 2) + pow(s * 0.5 + c * 0.25 + 2, 2)) - 7')} AS far, 0.0::DOUBLE AS same FROM t")
def residual_lever_arms(spark, d):
    p, arm = F.col("p"), vector(0.5, 0.25, 1)
    t = _turned(spark, d).withColumn("at", rs.lever_arm_position(p, arm, vector(1, 1, 0)))
    t = t.withColumn("v", rs.lever_arm_velocity(vector(3, 0, 0), p, vector(0, 0, 0.1), arm, vector(0, 0, 0)))
    far = rs.lever_arm_distance(p, arm, vector(0, 0, 0), F.lit(7.0))[0]
    q = rs.with_boresight(rs.with_lever_arm(p, arm), vector(0.1, 0, 0.2))
    t = t.withColumn("far", far).withColumn("six", rs.lever_arm_pose(p, q, vector(0.1, 0, 0.2), arm))
    same = F.aggregate("six", F.lit(0.0), lambda s, x: s + F.abs(x))
    return t.select("id", r(F.col("at")[0]).alias("px"), r(F.col("at")[1]).alias("py"), r(F.col("v")[0]).alias("vx"), r(F.col("v")[1]).alias("vy"), r(F.col("far")).alias("far"), r(same).alias("same"))


@_R.add("residual_pose_decorators", f"WITH {_TURN} SELECT id, {sr('c * 1 - s * 2 + x')} AS cx, {sr('s * 1 + c * 2 + 2')} AS cy, {sr('-c * x - s * 2')} AS ix, {sr('s * x - c * 2')} AS iy, {sr('x / 2 + 0.5')} AS hx, {sr('x * 0.025')} AS hr, {sr('x + 1')} AS ox FROM t")
def residual_pose_decorators(spark, d):
    p = F.col("p")
    start = rs.pose(vector(0, 0, 0), vector(1, 2, -1))
    t = _turned(spark, d).withColumn("c", rs.composed(p, start)).withColumn("i", rs.inverted(p)).withColumn("h", rs.interpolated(start, p, F.lit(0.5))).withColumn("o", rs.with_offset(p, vector(1, 0, 0)))
    return t.select("id", r(F.col("c.t")[0]).alias("cx"), r(F.col("c.t")[1]).alias("cy"), r(F.col("i.t")[0]).alias("ix"), r(F.col("i.t")[1]).alias("iy"), r(F.col("h.t")[0]).alias("hx"), r(F.col("h.r")[2]).alias("hr"), r(F.col("o.t")[0]).alias("ox"))


@_R.add("residual_gravity", f"WITH {_TURN} SELECT id, {sr('1 - c * 0.5 + s * 0.25')} AS vx, {sr('-s * 0.5 - c * 0.25')} AS vy, {sr('x + 9.81 * 0.5 - 0.1')} AS vz, {sr('x + 9.81 * 0.125 - 2 * 0.5')} AS xz, {sr('1 - c * 0.5 + s * 0.25 - 2 * 0.01 * 3 * 0.5')} AS coriolis FROM t")
def residual_gravity(spark, d):
    p, g, dt, dv = F.col("p"), vector(0, 0, -9.81), F.lit(0.5), vector(0.5, 0.25, 0.1)
    v0, v1 = vector(2, 3, 0), vector(F.lit(3.0), F.lit(3.0), F.col("x"))
    t = _turned(spark, d).withColumn("v", rs.velocity_change(dv, p, v0, v1, g, dt)).withColumn("w", rs.velocity_change(dv, p, v0, v1, g, dt, vector(0, 0, 0.01)))
    t = t.withColumn("q", rs.position_change(vector(0, 0, 0), p, vector(0, 0, 0), vector(0, 0, 2), vector(F.lit(0.0), F.lit(0.0), F.col("x")), g, dt))
    return t.select("id", r(F.col("v")[0]).alias("vx"), r(F.col("v")[1]).alias("vy"), r(F.col("v")[2]).alias("vz"), r(F.col("q")[2]).alias("xz"), r(F.col("w")[0]).alias("coriolis"))


QUERIES, ORACLES = _R.queries, _R.oracles
