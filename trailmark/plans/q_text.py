"""Formats and correspondences. Lines are made from rows, by the same text functions in both languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy as geo
from ..functions import notation as no
from ..functions.rotations import rotation_vector
from ..functions.vectors import times_matrix
from ..sources import exchange as ex
from ..sources import sensors as se
from ..sources import tables as tb
from . import actions
from .common import EV, Registry, events, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded
s = lambda c: F.col(c).cast("string")


def _pairs(spark, d):
    k, i = F.col("l_linenumber"), s("l_orderkey")
    a = F.when(k == 1, F.concat(F.lit("UV "), i, F.lit(" 10.5 20.25"))).when(k == 2, F.concat(F.lit("uvt "), i, F.lit(" 1 2 3"))).when(k == 3, F.concat(F.lit("XYZ "), i, F.lit(" 1 2 3 0.1 0.2 0.3"))).when(k == 4, F.concat(F.lit("XYZ "), i, F.lit(" 1 2"))).when(k == 5, F.lit("GEOXYZ EPSG:4979 45 7 300")).otherwise(F.lit("NOPE 1 2"))
    b = F.concat(F.lit("XYZ "), s("l_partkey"), F.lit(" 4 5 6"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(a, F.lit(", "), b, F.when(k == 7, ", PRIOR").otherwise("")).alias("value"))


_KIND = "CASE l_linenumber WHEN 1 THEN 'UV' WHEN 2 THEN 'UVT' WHEN 3 THEN 'XYZ' WHEN 5 THEN 'GEOXYZ' END"


@_R.add(
    "text_parse_pairs",
    f"SELECT l_orderkey, l_linenumber, {_KIND} AS kind, CASE WHEN l_linenumber = 5 THEN -1 ELSE l_orderkey END AS id, CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 3 END::INT AS n_vals, l_linenumber = 3 AS has_sigmas, l_partkey AS id2 FROM lineitem WHERE l_linenumber IN (1, 2, 3, 5)",
)
def text_parse_pairs(spark, d):
    p = _pairs(spark, d).withColumn("pair", no.parse_pair(F.col("value"))).where(no.is_valid(F.col("pair")))
    a, b = F.col("pair")[0], F.col("pair")[1]
    return p.select("l_orderkey", "l_linenumber", a["kind"].alias("kind"), no.id_of(a).alias("id"), F.size(a["vals"]).alias("n_vals"), a["sigmas"].isNotNull().alias("has_sigmas"), no.id_of(b).alias("id2"))


@_R.add("text_pair_kinds", f"SELECT CASE WHEN l_linenumber = 5 THEN 'GEOXYZ' WHEN l_linenumber = 3 THEN 'XYZ' WHEN l_linenumber = 2 THEN 'UVT' ELSE 'UV' END AS kind1, 'XYZ' AS kind2, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 3, 5) GROUP BY 1")
def text_pair_kinds(spark, d):
    p = _pairs(spark, d).withColumn("pair", no.parse_pair(F.col("value"))).where(no.is_valid(F.col("pair"))).withColumn("pair", no.normalized(F.col("pair")))
    return p.groupBy(F.col("pair")[0]["kind"].alias("kind1"), F.col("pair")[1]["kind"].alias("kind2")).agg(F.count(F.lit(1)).alias("n"))


@_R.add("text_write_pairs", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'UV ' || l_orderkey || ' 10.50 20.25' WHEN 2 THEN 'UVT ' || l_orderkey || ' 1.00 2.00 3.00' WHEN 3 THEN 'XYZ ' || l_orderkey || ' 1 2 3 0.1 0.2 0.3' ELSE 'GEOXYZ EPSG:4979 45 7 300' END || ', XYZ ' || l_partkey || ' 4 5 6' AS value FROM lineitem WHERE l_linenumber IN (1, 2, 3, 5)")
def text_write_pairs(spark, d):
    p = _pairs(spark, d).withColumn("pair", no.parse_pair(F.col("value"))).where(no.is_valid(F.col("pair")))
    return p.select("l_orderkey", "l_linenumber", no.pair_text(F.col("pair")).alias("value"))


@_R.add("text_import_by_name", "SELECT s_suppkey AS k, s_suppkey AS id1, n_nationkey::BIGINT AS id2 FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def text_import_by_name(spark, d):
    n = table(spark, d, "nation")
    line = F.concat(F.lit("UV "), s("s_suppkey"), F.lit(" 1 2, XYZ "), F.col("n_name"), F.lit(" 3 4 5"))
    lines = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), line.alias("value"))
    got = ex.import_correspondences(lines, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return got.select("k", no.id_of(F.col("pair")[0]).alias("id1"), no.id_of(F.col("pair")[1]).alias("id2"))


@_R.add("text_import_counts", "SELECT count(*) FILTER (l_linenumber <> 6) AS n_lines, count(*) FILTER (l_linenumber IN (1, 2, 3, 5)) AS n_imported FROM lineitem")
def text_import_counts(spark, d):
    lines = _pairs(spark, d).withColumn("value", F.when(F.col("l_linenumber") == 6, F.concat(F.lit(" # "), "value")).otherwise(F.col("value")))
    return ex.import_counts(lines, spark.createDataFrame([], "id bigint, name string"))


@_R.add("text_table_cells", "SELECT n_nationkey, n_name AS b, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE ' ' || n_regionkey END AS c FROM nation")
def text_table_cells(spark, d):
    line = F.concat(s("n_nationkey"), F.lit(","), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit(", "), s("n_regionkey"), F.lit(",more"))))
    t = tb.cells_of_lines(table(spark, d, "nation").select(line.alias("value")), ["a", "b", "c"])
    return t.select(F.col("a").cast("int").alias("n_nationkey"), "b", "c")


@_R.add("text_table_lines", "SELECT n_nationkey AS _row, n_name || ',' || n_nationkey || ',' || coalesce(CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR END, '') AS line FROM nation")
def text_table_lines(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("_row"), F.col("n_name").alias("a"), F.col("n_nationkey").alias("b"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("c"))
    return t.select("_row", tb.csv_line(t).alias("line"))


@_R.add("text_table_json", "SELECT o_orderkey AS id, i::INT AS _row, x AS cell FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS x, unnest([0, 1]) AS i FROM orders)")
def text_table_json(spark, d):
    j = F.to_json(F.struct(F.array("o_orderstatus", "o_orderpriority").alias("a"), F.lit("no array").alias("b")))
    return tb.rows_of_json(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), j.alias("json"))).select("id", "_row", "cell")


def _sensor_lines(spark, d):
    p = F.col("p_partkey")
    line = F.when(p % 5 == 0, F.concat(F.lit("# "), s("p_partkey"))).when(p % 5 == 1, F.concat(s("p_partkey"), F.lit(",1"))).when(p % 5 == 2, F.concat(s("p_partkey"), F.lit(",x,1,2"))).otherwise(F.concat(s("p_partkey"), F.lit(",,"), s("p_size"), F.lit(", 2.5,90,")))
    return table(spark, d, "part").select(line.alias("value"))


@_R.add("text_sensor_rows", f"SELECT {sr('p_partkey * 0.5 + 100')} AS t, p_size::DOUBLE AS v0, 2.5::DOUBLE AS v1, 90.0::DOUBLE AS v2 FROM part WHERE p_partkey % 5 > 2")
def text_sensor_rows(spark, d):
    a = se.accelerometer(_sensor_lines(spark, d), se.Layout(time_scale=0.5, time_delta=100.0))
    return a.select("t", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


@_R.add("text_gyro_rows", f"SELECT p_partkey::DOUBLE AS t, {sr('-radians(p_size)')} AS v0, {sr('radians(90)')} AS v2 FROM part WHERE p_partkey % 5 > 2")
def text_gyro_rows(spark, d):
    g = se.angular(_sensor_lines(spark, d), se.Layout(units="deg", signs=(-1.0, 1.0, 1.0)))
    return g.select("t", r(F.col("v")[0]).alias("v0"), r(F.col("v")[2]).alias("v2"))


@_R.add("text_gps_rows", "SELECT c_custkey::DOUBLE AS t, c_acctbal AS x, 4.0::DOUBLE AS var_x, 9.0::DOUBLE AS var_y, 0.5::DOUBLE AS cov_xy, true AS no_velocity FROM customer")
def text_gps_rows(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws(" ", s("c_custkey"), s("c_acctbal"), F.lit("2 3 4 9 16 0.5 0.25 0.125")).alias("value"))
    g = se.gps(lines, se.Layout(separators=(" ", ";"), groups={"position": (1, 2, 3), "position_variance": (4, 5, 6), "position_covariance": (7, 8, 9), "velocity": (-1, -1, -1)}))
    c = F.col("position_covariance")
    return g.select("t", F.col("position")[0].alias("x"), c[0].alias("var_x"), c[4].alias("var_y"), c[1].alias("cov_xy"), F.col("velocity").isNull().alias("no_velocity"))


@_R.add("text_image_times", "SELECT n_nationkey AS id, n_nationkey + 0.5::DOUBLE AS t FROM nation WHERE n_nationkey % 4 <> 3")
def text_image_times(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    name = F.regexp_replace("n_name", " ", "_")
    line = F.when(k % 4 == 0, F.concat(name, F.lit(" "), s("n_nationkey"), F.lit(".5"))).when(k % 4 == 1, F.concat(s("n_nationkey"), F.lit(".5;"), name, F.lit(" # late"))).when(k % 4 == 2, F.concat(name, F.lit(", "), s("n_nationkey"), F.lit(".5 // x"))).otherwise(F.concat(name, F.lit(" 1 2")))
    return ex.image_times(n.select(line.alias("value")), n.select(k.alias("id"), name.alias("name")))


@_R.add("text_trajectory_lines", f"WITH {EV} SELECT event_id, printf('%.6f,%.3f,%.3f,%.3f,%.6f,%.6f,%.6f', t, value, value * 2, 1.0, 0.0, 0.0, 0.25) AS value FROM ev")
def text_trajectory_lines(spark, d):
    zero = F.lit(0.0)
    pose = F.struct(F.array(zero, zero, F.lit(0.25)).alias("r"), F.array(F.col("value"), F.col("value") * 2, F.lit(1.0)).alias("t"))
    return ex.trajectory_lines(events(spark, d).select("event_id", "t", pose.alias("pose"))).select("event_id", "value")


@_R.add("text_landmark_lines", "SELECT c_custkey AS id, c_name || ',' || CASE WHEN c_custkey % 3 = 0 THEN ' , , ' ELSE printf('%.2f,%.2f,%.2f', c_acctbal, 1.5, -2.25) END AS value FROM customer")
def text_landmark_lines(spark, d):
    x = lambda c: F.when(F.col("c_custkey") % 3 != 0, c)
    return ex.landmark_lines(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), x(F.col("c_acctbal")).alias("x"), x(F.lit(1.5)).alias("y"), x(F.lit(-2.25)).alias("z")))


@_R.add("text_point_cloud", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'nan nan nan 0' ELSE printf('%.6f %.6f %.6f', p_retailprice, 0.5, -1.0) || ' ' || (10 * 65536 + 20 * 256 + p_size) END AS value FROM part")
def text_point_cloud(spark, d):
    b = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size"))
    return ex.pcd_lines(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.lit(0.5).alias("y"), F.lit(-1.0).alias("z"), F.lit(10).alias("r"), F.lit(20).alias("g"), b.alias("b")))


@_R.add("text_match_lines", "SELECT p_partkey AS match_id, side, side || ' ' || CASE side WHEN 1 THEN p_size || ' 3' ELSE '4 ' || p_size END || ' ' || p_partkey || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS value FROM part, (SELECT unnest([1, 2])::INT AS side)")
def text_match_lines(spark, d):
    return ex.match_lines(table(spark, d, "part").select(F.col("p_partkey").alias("match_id"), F.col("p_size").alias("x1"), F.lit(3).alias("y1"), F.lit(4).alias("x2"), F.col("p_size").alias("y2"), (F.col("p_partkey") % 2 == 0).alias("inlier")))


@_R.add("text_block_paths", "SELECT o_orderkey, o_custkey || '/' || o_orderkey AS path, o_orderkey AS last FROM orders")
def text_block_paths(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", no.block_path(F.array("o_custkey", "o_orderkey")).alias("path"))
    return p.withColumn("last", F.element_at(no.path_ids(F.col("path")), -1))


@_R.add("text_position_rows", f"SELECT p_partkey::DOUBLE AS t, p_size::DOUBLE AS x, {sr('p_retailprice::DOUBLE')} AS z FROM part WHERE p_partkey % 4 > 1")
def text_position_rows(spark, d):
    """Positions of a log; values beyond all numbers are no positions."""
    k = F.col("p_partkey")
    z = F.when(k % 4 == 0, "1e999").when(k % 4 == 1, "-1e999").otherwise(s("p_retailprice"))
    lines = table(spark, d, "part").select(F.concat_ws(";", s("p_partkey"), s("p_size"), F.lit("2"), z).alias("value"))
    got = se.position(lines, se.Layout(separators=(";",)))
    return got.select("t", F.col("v")[0].alias("x"), r(F.col("v")[2]).alias("z"))


@_R.add(
    "text_orientation_rows",
    f"""WITH p AS (SELECT p_partkey, p_size * 0.05::DOUBLE AS h FROM part), a AS (SELECT *, atan2(sin(h), cos(h)) AS w FROM p)
    SELECT p_partkey::DOUBLE AS t, form, {sr('w')} AS z FROM a, (SELECT unnest(['euler', 'gon', 'quaternion']) AS form)""",
)
def text_orientation_rows(spark, d):
    """Headings given as quaternions of any length, as Euler angles in degrees and as rotation vectors in gon."""
    h, k = F.col("p_size") * 0.05, s("p_partkey")
    turn = F.atan2(F.sin(h), F.cos(h))
    out = None
    for form, words, layout in (
        ("quaternion", [F.cos(h / 2) * 3, F.lit(0), F.lit(0), F.sin(h / 2) * 3], se.Layout(values=(1, 2, 3, 4), angle="quaternion")),
        ("euler", [F.lit(0), F.lit(0), F.degrees(turn)], se.Layout(angle="zyx", units="deg")),
        ("gon", [F.lit(0), F.lit(0), turn * (200 / 3.141592653589793)], se.Layout(units="gon")),
    ):
        lines = table(spark, d, "part").select(F.concat_ws(",", k, *[F.format_string("%.12f", w.cast("double")) for w in words]).alias("value"))
        rows = se.angular(lines, layout, finite=True).select("t", F.lit(form).alias("form"), r(F.col("v")[2]).alias("z"))
        out = rows if out is None else out.unionAll(rows)
    return out


@_R.add("text_trajectory_geographic", f"SELECT c_custkey AS id, {sr('(c_custkey * 37 % 17900) / 100.0::DOUBLE - 89')} AS lat, {sr('(c_custkey * 71 % 35900) / 100.0::DOUBLE - 179')} AS lon, {sr('c_acctbal::DOUBLE', 3)} AS height, {sr('degrees(atan2(sin(c_custkey * 0.05), cos(c_custkey * 0.05)))', 2)} AS heading FROM customer")
def text_trajectory_geographic(spark, d):
    """Geographic lines of poses that head so far from north, read again."""
    k = F.col("c_custkey")
    lat, lon, turn = k * 37 % 17900 / 100.0 - 89, k * 71 % 35900 / 100.0 - 179, k * 0.05
    heading = F.array(F.cos(turn), -F.sin(turn), F.lit(0.0), F.sin(turn), F.cos(turn), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    c = table(spark, d, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"), F.col("c_acctbal").cast("double").alias("h"), heading.alias("m"))
    pose = F.struct(rotation_vector(times_matrix(geo.local_axes(F.col("lat"), F.col("lon")), F.col("m"))).alias("r"), geo.earth_centred(F.col("lat"), F.col("lon"), F.col("h")).alias("t"))
    w = F.split(F.col("value"), ",")
    lines = ex.geographic_lines(c.select("id", F.lit(1.0).alias("t"), pose.alias("pose")))
    return lines.select("id", *[r(w[i].cast("double"), n).alias(name) for i, n, name in ((1, 6, "lat"), (2, 6, "lon"), (3, 3, "height"), (6, 2, "heading"))])


@_R.add("text_named_pairs", "SELECT s_suppkey AS k, 'UV ' || s_suppkey || ' 1.00 2.50, XYZ ' || coalesce(n_name, (s_nationkey + 20)::VARCHAR) || ' 3 4.5 5' AS value FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 20")
def text_named_pairs(spark, d):
    """Exported pairs: points that have a name go by it, others and images by their id."""
    line = F.concat(F.lit("uv "), s("s_suppkey"), F.lit(" 1 2.5, xyz "), (F.col("s_nationkey") + 20).cast("string"), F.lit(" 3 4.5 5"))
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), no.parse_pair(line).alias("pair"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("XYZ").alias("kind"))
    return ex.correspondence_lines(pairs, names)


@_R.add("text_rig_json", f"SELECT s_suppkey AS id, 100.5::DOUBLE AS f1, {sr('cos(s_nationkey * 0.1)')} AS r0, {sr('-sin(s_nationkey * 0.1)')} AS r1, s_nationkey::DOUBLE AS t0 FROM supplier")
def text_rig_json(spark, d):
    """Stereo rigs as JSON, read again."""
    n, zero = F.col("s_nationkey"), F.lit(0.0)
    rigs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(100.5).alias("f1"), F.array(zero, zero).alias("pp1"), F.lit(200.0).alias("f2"), F.array(zero, zero).alias("pp2"), F.array(zero, zero, n * 0.1).alias("r"), F.array(n.cast("double"), zero, zero).alias("t"))
    j = F.from_json("value", "f1 double, pp1 array<double>, f2 double, pp2 array<double>, R array<double>, t array<double>")
    return ex.rig_json(rigs).select("id", j.alias("j")).select("id", "j.f1", r(F.col("j.R")[0]).alias("r0"), r(F.col("j.R")[1]).alias("r1"), F.col("j.t")[0].alias("t0"))


@_R.add("text_one_image", "SELECT 'Image' || o_orderkey AS \"Image\", 'Point' || l_partkey AS \"Landmark\", l_linenumber AS u, l_suppkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders)")
def text_one_image(spark, d):
    """The observation table of one image."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Image"), s("o_orderkey")).alias("name"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Point"), s("p_partkey")).alias("name"))
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("landmark_id"), F.col("l_linenumber").alias("u"), F.col("l_suppkey").alias("v"))
    return ex.observation_table(seen, parts, orders, orders.agg(F.min("id")).first()[0])


@_R.add("text_project_json")
def text_project(spark, d):
    o = table(spark, d, "nation").select(F.lit("Image").alias("class"), F.col("n_nationkey").alias("position"), F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))
    c = table(spark, d, "region").select(F.lit("Camera").alias("class"), F.col("r_regionkey").alias("position"), F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))
    return ex.project_json(o.unionByName(c), {"defaultProjectCRS": '"EPSG:4978"'})


actions.register("Catalog", "pairs", lambda spark, path: _pairs(spark, path))


@_R.add("actions_available", "SELECT 'Catalog.pairs' AS name")
def actions_available(spark, d):
    return spark.createDataFrame([(x,) for x in actions.available()], "name string")


QUERIES, ORACLES = _R.queries, _R.oracles
