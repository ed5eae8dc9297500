"""Geodesy, rotations, cameras, rasters, matching and estimation. Positions are made from keys."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geodesy as geo
from ..functions import rotations as R
from ..functions.vectors import dot, rotated_covariance, vector
from ..operators import estimation as est
from ..operators import rasters as ra
from ..operators.cameras import view_table
from .common import Registry, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded

# ---- geodesy -----------------------------------------------------------------------------------

_A, _B = f"{geo.SEMI_MAJOR}::DOUBLE", f"{geo.SEMI_MINOR}::DOUBLE"
PLACE = "pl AS (SELECT c_custkey AS id, (c_custkey * 37 % 17900) / 100.0::DOUBLE - 89.0 AS lat, (c_custkey * 71 % 36000) / 100.0::DOUBLE - 180.0 AS lon, c_acctbal AS h FROM customer)"
ECEF = f"""en AS (SELECT *, {_A} * {_A} / sqrt({_A} * {_A} * cos(radians(lat)) * cos(radians(lat)) + {_B} * {_B} * sin(radians(lat)) * sin(radians(lat))) AS n FROM pl),
    ec AS (SELECT id, lat, lon, h, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, ({_B} * {_B} / ({_A} * {_A}) * n + h) * sin(radians(lat)) AS z FROM en)"""


def _places(spark, d):
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 17900) / 100.0 - 89.0).alias("lat"), ((F.col("c_custkey") * 71 % 36000) / 100.0 - 180.0).alias("lon"), F.col("c_acctbal").alias("h"))
    return p.withColumn("p", geo.earth_centred(F.col("lat"), F.col("lon"), F.col("h")))


def _components(column, names, digits=6):
    return [r(F.col(column)[i], digits).alias(n) for i, n in enumerate(names)]


@_R.add("geodesy_earth_centred", f"WITH {PLACE}, {ECEF} SELECT id, {sr('x', 3)} AS x, {sr('y', 3)} AS y, {sr('z', 3)} AS z FROM ec")
def geodesy_earth_centred(spark, d):
    return _places(spark, d).select("id", *_components("p", "xyz", 3))


@_R.add("geodesy_geographic", f"WITH {PLACE} SELECT id, {sr('lat')} AS lat, {sr('lon')} AS lon, {sr('h', 2)} AS h FROM pl")
def geodesy_geographic(spark, d):
    g = _places(spark, d).withColumn("g", geo.geographic(F.col("p")))
    return g.select("id", r(F.col("g")[0]).alias("lat"), r(F.col("g")[1]).alias("lon"), r(F.col("g")[2], 2).alias("h"))


_K = geo.SEMI_MINOR * geo.POLE_GRAVITY / (geo.SEMI_MAJOR * geo.EQUATOR_GRAVITY) - 1
_M = geo.EARTH_ROTATION**2 * geo.SEMI_MAJOR**2 * geo.SEMI_MINOR / geo.GRAVITATIONAL_CONSTANT
_FL = (geo.SEMI_MAJOR - geo.SEMI_MINOR) / geo.SEMI_MAJOR


@_R.add(
    "geodesy_gravity",
    f"""WITH {PLACE}, s AS (SELECT *, sin(radians(lat)) * sin(radians(lat)) AS s2 FROM pl),
    g AS (SELECT *, {geo.EQUATOR_GRAVITY}::DOUBLE * (1 + {_K!r}::DOUBLE * s2) / sqrt(1 - {geo._E2!r}::DOUBLE * s2) * (1 - 2 / {_A} * ({1 + _FL + _M!r}::DOUBLE - {2 * _FL!r}::DOUBLE * s2) * h + 3 / ({_A} * {_A}) * h * h) AS g FROM s)
    SELECT id, {sr('cos(radians(lat)) * cos(radians(lon)) * g')} AS gx, {sr('cos(radians(lat)) * sin(radians(lon)) * g')} AS gy, {sr('sin(radians(lat)) * g')} AS gz FROM g""",
)
def geodesy_gravity(spark, d):
    return _places(spark, d).withColumn("g", geo.gravity(F.col("p"))).select("id", *_components("g", ("gx", "gy", "gz")))


@_R.add(
    "geodesy_local_axes",
    f"""WITH {PLACE}, t AS (SELECT *, sin(radians(lat)) AS s, cos(radians(lat)) AS c, sin(radians(lon)) AS sl, cos(radians(lon)) AS cl, ['NED', 'ENU', 'NWU'][(id % 3 + 1)::INT] AS f FROM pl)
    SELECT id, f AS frame, {sr("CASE WHEN f = 'ENU' THEN -sl ELSE -s * cl END")} AS m00, {sr("CASE f WHEN 'NED' THEN -sl WHEN 'ENU' THEN -s * cl ELSE sl END")} AS m01, {sr("CASE f WHEN 'NED' THEN -c * cl ELSE c * cl END")} AS m02, {sr("CASE f WHEN 'NED' THEN -s ELSE s END")} AS m22 FROM t""",
)
def geodesy_local_axes(spark, d):
    p = _places(spark, d).withColumn("frame", F.array(F.lit("NED"), F.lit("ENU"), F.lit("NWU"))[(F.col("id") % 3).cast("int")]).withColumn("m", geo.local_axes_at(F.col("p"), F.col("frame")))
    return p.select("id", "frame", *[r(F.col("m")[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (2, "m02"), (8, "m22"))])


@_R.add("geodesy_frame_on_sphere", f"WITH {PLACE}, {ECEF}, n AS (SELECT id, z, sqrt(x * x + y * y + z * z) AS n FROM ec) SELECT id, 0.0::DOUBLE AS east, 0.0::DOUBLE AS north, {sr('n - 6371000.0', 2)} AS up, 1.0::DOUBLE AS det FROM n")
def geodesy_frame_on_sphere(spark, d):
    p = _places(spark, d).withColumn("f", geo.frame_on_sphere(F.col("p"), F.lit(6371000.0))).withColumn("q", geo.to_frame(F.col("f.R"), F.col("f.t"), F.col("p")))
    m = F.col("f.R")
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return p.select("id", *_components("q", ("east", "north", "up"), 2), r(det).alias("det"))


@_R.add("geodesy_project_frame", f"WITH {PLACE}, {ECEF} SELECT count(*) AS n, {sr('avg(x)', 2)} AS mx, {sr('avg(y)', 2)} AS my, {sr('avg(z)', 2)} AS mz, {sr('min(sqrt(x * x + y * y + z * z))', 2)} AS min_norm FROM ec")
def geodesy_project_frame(spark, d):
    p = F.col("p")
    return _places(spark, d).agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(p[i]), 2).alias(f"m{c}") for i, c in enumerate("xyz")], r(F.min(F.sqrt(dot(p, p))), 2).alias("min_norm"))


@_R.add("geodesy_horizontal_constraint", f"WITH {PLACE} SELECT id, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1 FROM pl")
def geodesy_horizontal_constraint(spark, d):
    c = _places(spark, d).withColumn("c", geo.horizontal_constraint(F.col("lat"), F.col("lon"), F.lit(-100.0), F.lit(1000.0)))
    row = lambda k: dot(F.slice("c.P", 3 * k + 1, 3), F.col("p")) - F.col("c.d")[k]
    return c.select("id", r(row(0), 3).alias("e0"), r(row(1), 3).alias("e1"))


@_R.add("geodesy_earth_rate", f"WITH {PLACE} SELECT id, {sr(f'cos(radians(lat)) * {geo.EARTH_ROTATION!r}::DOUBLE * 1e5')} AS north, {sr(f'-sin(radians(lat)) * {geo.EARTH_ROTATION!r}::DOUBLE * 1e5')} AS down FROM pl")
def geodesy_earth_rate(spark, d):
    w = _places(spark, d).withColumn("w", geo.earth_rate(geo.local_axes(F.col("lat"), F.col("lon"))))
    return w.select("id", r(F.col("w")[0] * 1e5).alias("north"), r(F.col("w")[2] * 1e5).alias("down"))


_GT = (0.5, 0.1, 1000.0, -0.2, -0.5, 2000.0)


@_R.add("geodesy_geotransform", f"SELECT p_partkey, {sr('0.5 * j + 0.1 * i + 1000.0', 4)} AS x, {sr('-0.2 * j - 0.5 * i + 2000.0', 4)} AS y, i::DOUBLE AS i, j::DOUBLE AS j FROM (SELECT p_partkey, p_partkey % 50 AS i, p_size AS j FROM part)")
def geodesy_geotransform(spark, d):
    g = vector(*_GT)
    p = table(spark, d, "part").select("p_partkey", geo.geotransform(g, F.col("p_partkey") % 50, F.col("p_size")).alias("m"))
    p = p.withColumn("b", geo.inverse_geotransform(g, F.col("m")[0], F.col("m")[1]))
    return p.select("p_partkey", *_components("m", "xy", 4), *_components("b", "ij"))


# ---- rotations ---------------------------------------------------------------------------------

_ANGLES = "an AS (SELECT p_partkey AS id, p_size * 0.03::DOUBLE - 0.7 AS x, (p_partkey % 50) * 0.02::DOUBLE - 0.5 AS y, (p_partkey % 40) * 0.07::DOUBLE - 1.3 AS z FROM part)"


def _angles(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 0.03 - 0.7).alias("x"), ((F.col("p_partkey") % 50) * 0.02 - 0.5).alias("y"), ((F.col("p_partkey") % 40) * 0.07 - 1.3).alias("z"))


@_R.add(
    "rotation_euler",
    f"WITH {_ANGLES} SELECT id, {sr('cos(y) * cos(z)')} AS m00, {sr('sin(x) * sin(y) * cos(z) - cos(x) * sin(z)')} AS m01, {sr('cos(y) * sin(z)')} AS m10, {sr('-sin(y)')} AS m20, {sr('degrees(x)', 4)} AS ex, {sr('degrees(y)', 4)} AS ey, {sr('degrees(z)', 4)} AS ez FROM an",
)
def rotation_euler(spark, d):
    m = _angles(spark, d).withColumn("r", R.vector_of_euler(F.col("x"), F.col("y"), F.col("z"), "zyx")).withColumn("m", R.rotation_matrix(F.col("r"))).withColumn("e", R.euler_degrees(F.col("m"), "zyx"))
    return m.select("id", *[r(F.col("m")[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m10"), (6, "m20"))], *_components("e", ("ex", "ey", "ez"), 4))


@_R.add("rotation_round_trip", f"WITH {_ANGLES} SELECT id, {sr('x')} AS x, {sr('y')} AS y, {sr('z')} AS z, 0.0::DOUBLE AS back FROM an")
def rotation_round_trip(spark, d):
    a = _angles(spark, d).withColumn("r", F.array("x", "y", "z")).withColumn("l", R.rotation_vector(R.rotation_matrix(F.col("r")))).withColumn("t", vector(1, 2, 3))
    a = a.withColumn("i", R.inverse(F.col("r"), F.col("t"))).withColumn("c", R.compose(F.col("r"), F.col("t"), F.col("i.r"), F.col("i.t")))
    c = F.col("c")
    return a.select("id", *_components("l", "xyz"), r(F.sqrt(dot(c["r"], c["r"]) + dot(c["t"], c["t"]))).alias("back"))


@_R.add("rotation_covariance", f"WITH {_ANGLES} SELECT id, {sr('4 * cos(z) * cos(z) + 9 * sin(z) * sin(z)')} AS c00, {sr('(4 - 9) * cos(z) * sin(z)')} AS c01, 1.0::DOUBLE AS c22 FROM an")
def rotation_covariance(spark, d):
    s = rotated_covariance(R.rotation_matrix(F.array(F.lit(0.0), F.lit(0.0), F.col("z"))), vector(4, 0, 0, 0, 9, 0, 0, 0, 1))
    return _angles(spark, d).withColumn("s", s).select("id", r(F.col("s")[0]).alias("c00"), r(F.col("s")[1]).alias("c01"), r(F.col("s")[8]).alias("c22"))


# ---- cameras and numbers -----------------------------------------------------------------------


@_R.add(
    "camera_pinhole",
    f"""WITH p AS (SELECT p_partkey AS id, (p_size * 12.0::DOUBLE - 320) / 800 AS x0, (p_partkey % 480 - 240.0::DOUBLE) / 800 AS y FROM part), q AS (SELECT id, (x0 - 0.002 * y) / 1.001 AS x, y FROM p), c AS (SELECT *, x * x + y * y AS r2 FROM q),
    f AS (SELECT *, -0.1 * r2 + 0.02 * r2 * r2 + 0.001 * r2 * r2 * r2 AS k FROM c)
    SELECT id, {sr('(x + x * k + 2 * 0.001 * x * y - 0.0005 * (r2 + 2 * x * x)) * 800')} AS dx, {sr('(y + y * k + 0.001 * (r2 + 2 * y * y) - 2 * 0.0005 * x * y) * 800')} AS dy FROM f""",
)
def camera_pinhole(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 12.0).alias("u"), (F.col("p_partkey") % 480).cast("double").alias("v"))
    x = cam.pinhole_direction(F.col("u"), F.col("v"), F.lit(800.0), vector(320, 240), vector(-0.1, 0.02, 0.001), vector(0.001, -0.0005), vector(0.001, 0.002))
    return p.withColumn("d", x).select("id", *_components("d", ("dx", "dy")))


@_R.add("camera_undistort", f"SELECT p_partkey AS id, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM part")
def camera_undistort(spark, d):
    k, t = vector(-0.1, 0.02, 0.001), vector(0.001, -0.0005)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 100.0 - 0.25).alias("x"), ((F.col("p_partkey") % 50) / 100.0 - 0.25).alias("y"))
    p = p.withColumn("q", cam.undistorted(F.col("x"), F.col("y"), k, t, 30))
    (rx, ry), (tx, ty) = cam._radial(F.col("q")[0], F.col("q")[1], k), cam._tangential(F.col("q")[0], F.col("q")[1], t)
    return p.select("id", r(F.col("q")[0] + rx + tx - F.col("x")).alias("ex"), r(F.col("q")[1] + ry + ty - F.col("y")).alias("ey"))


@_R.add("camera_pushbroom", f"WITH p AS (SELECT s_suppkey AS id, k, (k * 10 - 500) / 1000.0::DOUBLE AS s FROM supplier, range(100) g(k)), q AS (SELECT id, k, k * 10.0 - 500.0 + 0.1 + 0.2 * s + 0.3 * s * s AS x, 0.5 * s * s * s AS y FROM p) SELECT id, k, {sr('atan(x / 900.0)')} AS across, {sr('atan(y / 900.0)')} AS along FROM q")
def camera_pushbroom(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("k"))
    direction = cam.pushbroom_direction(F.col("k") * 10.0, F.lit(0.0), F.lit(900.0), vector(500, 0), vector(0.1, 0.2, 0.3, 0, 0, 0), vector(0, 0, 0, 0.5, 0, 0), 1000.0)
    return s.withColumn("a", cam.view_angles(direction)).select("id", "k", *_components("a", ("across", "along")))


@_R.add("camera_reprojection", f"SELECT p_partkey AS id, z < 0 AS behind, CASE WHEN z < 0 THEN -1.0 ELSE {sr('900 * x / z + 320')} END::DOUBLE AS u, CASE WHEN z < 0 THEN -1.0 ELSE {sr('900 * y / z + 240')} END::DOUBLE AS v FROM (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 30)::DOUBLE AS y, (p_partkey % 21 - 5.5::DOUBLE) AS z FROM part)")
def camera_reprojection(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 30).cast("double"), F.col("p_partkey") % 21 - 5.5).alias("p"))
    p = p.withColumn("q", cam.reprojection(F.col("p"), F.lit(900.0), vector(320, 240)))
    return p.select("id", F.isnan(F.col("q")[0]).alias("behind"), *[F.when(F.isnan(F.col("q")[i]), -1.0).otherwise(r(F.col("q")[i])).alias(n) for i, n in enumerate("uv")])


@_R.add("camera_quantizers", "SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN 0 ELSE least(floor(sqrt(v) * 256), 255) END::INT AS q8, CASE WHEN v < 0 THEN 0 ELSE least(floor(sqrt(v) * 65536), 65535) END::INT AS q16 FROM (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.06 AS v FROM lineitem)")
def camera_quantizers(spark, d):
    v = F.col("l_discount") * 12 - 0.06
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cam.quantized(v, F.lit(2.0), 8).alias("q8"), cam.quantized(v, F.lit(2.0), 16).alias("q16"))


@_R.add("camera_depth", f"SELECT p_partkey, CASE WHEN p_size - 10.5 > 0 THEN {sr('120.0::DOUBLE / (p_size - 10.5)')} END AS z, p_size::BIGINT * 65536 + (p_partkey % 256) * 256 + 7 AS rgb FROM part")
def camera_depth(spark, d):
    return table(spark, d, "part").select("p_partkey", r(cam.depth(120.0, F.col("p_size"), 10.5)).alias("z"), cam.packed_rgb(F.col("p_size"), F.col("p_partkey") % 256, F.lit(7)).alias("rgb"))


@_R.add(
    "uncertain_numbers",
    f"""WITH u AS (SELECT p_partkey AS id, p_retailprice AS a, 2.0::DOUBLE AS sa, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS b, 0.5::DOUBLE AS sb FROM part)
    SELECT id, {sr('coalesce(a + b, a)')} AS plus, {sr('coalesce(a * b, a)')} AS times, {sr('CASE WHEN b IS NULL THEN sa ELSE sa + sb END')} AS plus_sd, {sr('CASE WHEN b IS NULL THEN sa ELSE sqrt(sb * sb * a * a + sa * sa * b * b) END')} AS times_sd, {sr('coalesce(a / b, a)')} AS ratio, {sr('CASE WHEN b IS NULL THEN sa ELSE sqrt(sb * sb * a * a / (b * b * b * b) + sa * sa / (b * b)) END')} AS ratio_sd, {sr('sa * 3')} AS scaled_sd FROM u""",
)
def uncertain_numbers(spark, d):
    a = cam.uncertain(F.col("p_retailprice"), F.lit(2.0))
    b = cam.uncertain(F.when(F.col("p_size") % 5 != 0, F.col("p_size")), F.lit(0.5))
    u = table(spark, d, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    u = u.select("id", cam.plus(a, b).alias("p"), cam.times(a, b).alias("t"), cam.divided(a, b).alias("q"), cam.scaled(a, -3.0).alias("s"))
    return u.select("id", r(F.col("p.value")).alias("plus"), r(F.col("t.value")).alias("times"), r(F.col("p.stddev")).alias("plus_sd"), r(F.col("t.stddev")).alias("times_sd"), r(F.col("q.value")).alias("ratio"), r(F.col("q.stddev")).alias("ratio_sd"), r(F.col("s.stddev")).alias("scaled_sd"))


# ---- rasters -----------------------------------------------------------------------------------

RASTER = "rb AS (SELECT (l_orderkey % 33)::BIGINT AS i, (l_partkey % 33)::BIGINT AS j, max(l_quantity) AS q FROM lineitem GROUP BY ALL), ra AS (SELECT i, j, CASE WHEN (i + j) % 29 = 0 THEN -9999.0 ELSE q END::DOUBLE AS v FROM rb)"


def _raster(spark, d):
    cell = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 33).alias("i"), (F.col("l_partkey") % 33).alias("j")).agg(F.max("l_quantity").alias("q"))
    return cell.select("i", "j", F.when((F.col("i") + F.col("j")) % 29 == 0, -9999.0).otherwise(F.col("q")).alias("v"))


@_R.add(
    "raster_pyramid",
    f"""WITH {RASTER}, c AS (SELECT i - di AS i, j - dj AS j, CASE WHEN v >= -9000 THEN v END AS v FROM ra, range(2) a(di), range(2) b(dj)),
    z AS (SELECT i, j, min(v) AS low, max(v) AS high FROM c WHERE i >= 0 AND j >= 0 AND i < (SELECT max(i) FROM ra) AND j < (SELECT max(j) FROM ra) GROUP BY ALL)
    SELECT level::INT AS level, floor(i / pow(2, level))::BIGINT AS i, floor(j / pow(2, level))::BIGINT AS j, min(low) AS low, max(high) AS high FROM z, range(6) l(level) GROUP BY ALL""",
)
def raster_pyramid(spark, d):
    return ra.pyramid(_raster(spark, d), 6)


@_R.add("raster_validity", f"WITH {RASTER} SELECT count(*) AS n, count(*) FILTER (v < -9000) AS n_bad, min(v) FILTER (v >= -9000) AS low, max(v) FILTER (v >= -9000) AS high, {sr('avg(v) FILTER (v >= -9000)')} AS mean FROM ra")
def raster_validity(spark, d):
    v = ra.validity(_raster(spark, d))
    return v.select("n", "n_bad", "low", "high", r(F.col("mean")).alias("mean"))


@_R.add("raster_coverage", f"WITH {RASTER}, p AS (SELECT DISTINCT floor((p_partkey % 330) / 10.0::DOUBLE + 0.5)::BIGINT AS i, floor(p_size / 2.0::DOUBLE + 0.5)::BIGINT AS j FROM part) SELECT i, j, v, p.i IS NOT NULL AS seen FROM ra LEFT JOIN p USING (i, j)")
def raster_coverage(spark, d):
    p = table(spark, d, "part").select(((F.col("p_partkey") % 330) / 10.0).alias("y"), (F.col("p_size") / 2.0).alias("x"))
    return ra.coverage(_raster(spark, d), p)


@_R.add("raster_lattice", f"WITH {RASTER}, m AS (SELECT i, j, 0.5 * j + 0.1 * i + 1000.0 AS x, CASE WHEN v >= -9000 THEN v END AS z FROM ra) SELECT i, j, {sr('x - avg(x) OVER ()')} AS x, {sr('z - avg(z) OVER ()')} AS z FROM m")
def raster_lattice(spark, d):
    return ra.lattice(_raster(spark, d), vector(*_GT)).select("i", "j", r(F.col("x")).alias("x"), r(F.col("z")).alias("z"))


def _hit_sql(a, b, c):
    """Distance to the triangle of corners (i, j, height) along a ray from (ox, oy, oz) in direction (dx, dy, dz)."""
    at = lambda p: (f"(j + {p[1]})", f"(i + {p[0]})", f"v{p[0]}{p[1]}")
    minus = lambda p, q: [f"({x} - {y})" for x, y in zip(p, q, strict=True)]
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    dot = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")"
    d, o = ("dx", "dy", "dz"), ("ox", "oy", "oz")
    e1, e2, s = minus(at(b), at(a)), minus(at(c), at(a)), minus(o, at(a))
    p, q = cross(d, e2), cross(s, e1)
    det = dot(e1, p)
    u, v, t = f"{dot(s, p)} / {det}", f"{dot(d, q)} / {det}", f"{dot(e2, q)} / {det}"
    return f"CASE WHEN abs({det}) > 1e-12 AND {u} >= 0 AND {v} >= 0 AND {u} + {v} <= 1 AND {t} >= 0 THEN {t} END"


@_R.add(
    "raster_ray_hits",
    f"""WITH {RASTER}, z AS (SELECT i, j, CASE WHEN v >= -9000 THEN v END AS v FROM ra),
    c AS (SELECT a.i, a.j, a.v AS v00, b.v AS v01, c.v AS v10, d.v AS v11 FROM z a JOIN z b ON b.i = a.i AND b.j = a.j + 1 JOIN z c ON c.i = a.i + 1 AND c.j = a.j JOIN z d ON d.i = a.i + 1 AND d.j = a.j + 1),
    r AS (SELECT p_partkey AS ray_id, p_partkey % 37 - 2.7::DOUBLE AS ox, p_partkey % 31 + 0.4::DOUBLE AS oy, 20.0 + p_size * 3 AS oz, (p_partkey % 7 - 3) * 0.11::DOUBLE AS dx, (p_partkey % 5 - 2) * 0.13::DOUBLE AS dy, p_partkey % 11 * 0.1::DOUBLE - 0.95 AS dz FROM part),
    h AS (SELECT ray_id, i, j, least({_hit_sql((0, 0), (0, 1), (1, 0))}, {_hit_sql((1, 1), (1, 0), (0, 1))}) AS t FROM r, c),
    n AS (SELECT ray_id, min(struct_pack(t := t, i := i, j := j)) AS h FROM h WHERE t IS NOT NULL GROUP BY 1)
    SELECT ray_id, h IS NULL AS missed, {sr('h.t')} AS distance, h.i AS i, h.j AS j FROM r LEFT JOIN n USING (ray_id)""",
)
def raster_ray_hits(spark, d):
    k = F.col("p_partkey")
    origin = vector(k % 37 - 2.7, k % 31 + 0.4, 20.0 + F.col("p_size") * 3)
    direction = vector((k % 7 - 3) * 0.11, (k % 5 - 2) * 0.13, k % 11 * 0.1 - 0.95)
    rays = table(spark, d, "part").select(k.alias("ray_id"), origin.alias("origin"), direction.alias("direction"))
    return ra.ray_hits(_raster(spark, d), rays).select("ray_id", F.isnan("distance").alias("missed"), F.when(~F.isnan("distance"), r(F.col("distance"))).alias("distance"), "i", "j")


@_R.add("raster_bounding_box", f"WITH {PLACE}, {ECEF} SELECT id % 10 AS g, {sr('min(x)', 2)} AS min_x, {sr('max(x)', 2)} AS max_x, {sr('min(z)', 2)} AS min_z, {sr('max(z)', 2)} AS max_z FROM ec GROUP BY 1")
def raster_bounding_box(spark, d):
    p = _places(spark, d).select((F.col("id") % 10).alias("g"), *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])
    b = ra.bounding_box(p, ["g"])
    return b.select("g", *[r(F.col(c), 2).alias(c) for c in ("min_x", "max_x", "min_z", "max_z")])


# ---- estimation --------------------------------------------------------------------------------


@_R.add("estimation_losses", f"SELECT l_orderkey, l_linenumber, {sr('CASE WHEN s <= 1 THEN s ELSE 2 * sqrt(s) - 1 END')} AS huber, {sr('ln(1 + s)')} AS cauchy, {sr('atan(s)')} AS arctan FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS s FROM lineitem)")
def estimation_losses(spark, d):
    s = F.col("l_quantity") * F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r(cam.robust_loss(s, k)).alias(k) for k in ("huber", "cauchy", "arctan")])


@_R.add("estimation_edges", f"SELECT p_partkey AS id, {sr('sqrt(pow(p_size - 3, 2) + 16.0) - 5.0')} AS distance, {sr('p_size / sqrt(p_size * p_size + 1.0::DOUBLE) - cos(0.3)')} AS angle_cos, {sr('1 / sqrt(p_size * p_size + 1.0::DOUBLE) - sin(0.3)')} AS angle_sin, {sr('(p_size - 10.0) * 0.5')} AS prior FROM part")
def estimation_edges(spark, d):
    x = F.col("p_size").cast("double")
    p = table(spark, d, "part").withColumn("_g", est.angle_residual(F.array(x, F.lit(1.0), F.lit(0.0)), vector(0, 0, 0), vector(1, 0, 0), F.lit(0.3)))
    distance = est.distance_residual(F.array(x, F.lit(4.0), F.lit(0.0)), vector(3, 0, 0), F.lit(5.0))
    prior = est.prior_residual(F.array(x), F.array(F.lit(10.0)), F.array(F.lit(0.5)))[0]
    return p.select(F.col("p_partkey").alias("id"), r(distance).alias("distance"), r(F.col("_g")[0]).alias("angle_cos"), r(F.col("_g")[1]).alias("angle_sin"), r(prior).alias("prior"))


@_R.add("estimation_line_fit", f"SELECT {sr('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept, {sr('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope FROM lineitem")
def estimation_line_fit(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))

    def residuals(x, f):
        q = f["q"].to_numpy()
        return x[0] + x[1] * q - f["p"].to_numpy(), np.stack([np.ones(len(q)), q], axis=1)

    x = est.gauss_newton(rows, np.zeros(2), residuals)["x"]
    return spark.createDataFrame([(float(x[0]), float(x[1]))], "intercept double, slope double").select(r(F.col("intercept"), 2).alias("intercept"), r(F.col("slope"), 3).alias("slope"))


@_R.add("estimation_alignment", f"SELECT g, count(*) AS n, 0.3::DOUBLE AS rz, 5.0::DOUBLE AS tx, -2.0::DOUBLE AS ty, 0.0::DOUBLE AS rms FROM (SELECT p_partkey % 8 AS g FROM part) GROUP BY g HAVING count(*) >= 5")
def estimation_alignment(spark, d):
    a = F.array((F.col("p_partkey") % 13).cast("double"), (F.col("p_partkey") % 7).cast("double"), F.col("p_size").cast("double"))
    p = table(spark, d, "part").select((F.col("p_partkey") % 8).alias("g"), a.alias("a"))
    p = p.withColumn("b", geo.to_frame(R.rotation_matrix(vector(0, 0, 0.3)), vector(5, -2, 1), F.col("a")))
    k = est.kabsch(p, ["g"])
    return k.select("g", "n", r(F.col("r")[2], 4).alias("rz"), r(F.col("t")[0], 4).alias("tx"), r(F.col("t")[1], 4).alias("ty"), r(F.col("rms"), 3).alias("rms"))


@_R.add("estimation_triangulation", f"SELECT p_partkey AS id, 3::BIGINT AS n, {sr('p_size::DOUBLE', 4)} AS x, 2.0::DOUBLE AS y, 50.0::DOUBLE AS z FROM part")
def estimation_triangulation(spark, d):
    o = F.explode(F.array(vector(0, 0, 0), vector(10, 0, 0), vector(0, 10, 5))).alias("o")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), vector(F.col("p_size"), F.lit(2.0), F.lit(50.0)).alias("p"), o)
    v = F.zip_with("p", "o", lambda a, b: a - b)
    p = p.withColumn("v", v).withColumn("d", F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))))
    t = est.triangulate(p, ["id"])
    return t.select("id", "n", *_components("p", "xyz", 4))


@_R.add("estimation_resection")
def estimation_resection(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("image"), vector(F.col("s_suppkey") % 7 - 3, F.col("s_suppkey") % 5 - 2, F.col("s_suppkey") % 3 + 8).alias("p"))
    s = s.withColumn("f", F.lit(500.0)).withColumn("pp", vector(320, 240)).withColumn("uv", cam.reprojection(F.col("p"), F.lit(500.0), vector(320, 240)))
    return est.resection(s, ["image"]).select("image", r(F.col("rms"), 3).alias("rms"))


@_R.add("estimation_landmark_report", f"SELECT l_partkey AS landmark_id, count(DISTINCT l_orderkey) AS n_images, 5.0::DOUBLE AS mean_error, 5.0::DOUBLE AS max_error FROM lineitem GROUP BY 1")
def estimation_landmark_report(spark, d):
    p = vector((F.col("l_partkey") % 10).cast("double"), F.lit(1.0), F.lit(20.0))
    zero = F.struct(vector(0, 0, 0).alias("r"), vector(0, 0, 0).alias("t")).alias("pose")
    o = table(spark, d, "lineitem").select(F.col("l_partkey").alias("landmark_id"), F.col("l_orderkey").alias("image_id"), zero, p.alias("p"), F.lit(100.0).alias("f"), vector(0, 0).alias("pp"))
    o = o.withColumn("u", F.col("p")[0] * 5 + 3).withColumn("v", F.lit(5.0) + 4)
    rep = est.landmark_report(o)
    return rep.select("landmark_id", "n_images", r(F.col("mean_error")).alias("mean_error"), r(F.col("max_error")).alias("max_error"))


@_R.add("raster_max_normalised", f"WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS g, p_size / CASE WHEN p_partkey % 9 = 0 THEN 100.0::DOUBLE ELSE 20 END AS v FROM part) SELECT id, g, {sr('v / greatest(max(v) OVER (PARTITION BY g), 1)')} AS value FROM p")
def raster_max_normalised(spark, d):
    g = F.col("p_partkey") % 9
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), g.alias("g"), (F.col("p_size") / F.when(g == 0, 100.0).otherwise(20.0)).alias("value"))
    return ra.max_normalised(p, ["g"]).withColumn("value", r(F.col("value")))


@_R.add(
    "geodesy_position_constraint",
    f"""WITH {PLACE}, {ECEF}, q AS (SELECT id, id % 4 AS k, CASE id % 4 WHEN 0 THEN lat WHEN 1 THEN 1 - lon WHEN 2 THEN 1 - y END AS a, CASE id % 4 WHEN 0 THEN lon WHEN 1 THEN lat + 2 WHEN 2 THEN x + 2 END AS b, CASE id % 4 WHEN 0 THEN h WHEN 1 THEN h + 3 WHEN 2 THEN z + 3 END AS c FROM ec)
    SELECT id, {sr('a', 3)} AS x, {sr('b', 3)} AS y, {sr('c', 3)} AS z FROM q""",
)
def geodesy_position_constraint(spark, d):
    crs = F.array(*[F.lit(c) for c in ("Local", "EPSG:4978", "EPSG:4979", "EPSG:1")])[(F.col("id") % 4).cast("int")]
    c = geo.position_constraint(F.col("lat"), F.col("lon"), F.col("h").cast("double"), crs, vector(0, -1, 0, 1, 0, 0, 0, 0, 1), vector(1, 2, 3))
    return _places(spark, d).withColumn("c", c).select("id", *_components("c", "xyz", 3))


@_R.add(
    "camera_view_table",
    f"""WITH c AS (SELECT s_suppkey AS id, s_suppkey % 20 + 1 AS n, s_suppkey AS k FROM supplier), p AS (SELECT *, unnest(range(n)) AS u FROM c), s AS (SELECT *, (u - n / 2.0::DOUBLE) / n AS s FROM p)
    SELECT id, u, {sr('u - CASE WHEN k % 4 = 0 THEN n / 2.0::DOUBLE ELSE 7 END + CASE WHEN k % 2 = 0 THEN 0 ELSE 0.1 + 0.2 * s - 0.3 * s * s END')} AS dx, {sr('0.5 * s * s * s * s * s')} AS dy,
    CASE WHEN k % 5 = 0 THEN 120.0::DOUBLE WHEN k % 3 = 0 THEN n::DOUBLE ELSE 100.0::DOUBLE END AS dz FROM s""",
)
def camera_view_table(spark, d):
    k, none = F.col("s_suppkey"), F.lit(None)
    c = table(spark, d, "supplier").select(
        k.alias("id"), (k % 20 + 0.5).cast("double").alias("width"), F.when(k % 3 != 0, 100.0).alias("f"), F.when(k % 4 != 0, 7.0).alias("pp"),
        F.when(k % 2 != 0, F.array(F.lit(0.1), F.lit(0.2), F.lit(-0.3), none.cast("double"), F.lit(0.0), F.lit(0.0))).alias("a"), vector(0, 0, 0, 0, 0, 0.5).alias("b"),
        F.when(k % 5 == 0, 120.0).alias("opt_f"), none.cast("double").alias("opt_pp"), none.cast("array<double>").alias("opt_a"), none.cast("array<double>").alias("opt_b"),
    )
    t = view_table(c, ["id"], optimized=True)
    return t.select("id", F.col("u").cast("long").alias("u"), *_components("direction", ("dx", "dy", "dz")))


QUERIES, ORACLES = _R.queries, _R.oracles
