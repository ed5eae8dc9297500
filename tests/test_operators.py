"""Properties that SQL doesn't show: bounds, invariants, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import geodesy, notation, rotations
from trailmark.functions.vectors import vector
from trailmark.operators import catalog, estimation, graphs, rasters, timeseq, trajectories
from trailmark.sources import exchange, sensors, tables


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(1, float(i), float(i)) for i in range(10)], "s int, t double, value double")


def test_value_at_clamps_and_interpolates(spark, line):
    probes = spark.createDataFrame([(1, k, t) for k, t in enumerate([-1.0, 0.0, 0.25, 3.0, 8.75, 9.0, 12.0])], "s int, k int, t double")
    for bucket in (None, 2.5):
        got = {r["k"]: r for r in timeseq.value_at(line, probes, ["s"], bucket).collect()}
        assert [round(got[k]["interp"], 9) for k in range(7)] == [0.0, 0.0, 0.25, 3.0, 8.75, 9.0, 9.0]
        assert (got[0]["w_lower"], got[0]["w_upper"]) == (0.0, 1.0) and (got[5]["w_lower"], got[5]["w_upper"]) == (1.0, 0.0)


def test_integrals_cover_their_intervals(spark, line):
    spans = [(-2.5, 1.5), (2.5, 6.5), (7.5, 11.5), (2.5, -1.5), (4.5, 1.5), (12.5, 8.5)]
    q = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(spans)], "s int, k int, t0 double, tf double")
    got = {r["k"]: r["d"] for r in timeseq.integrals(line, q, ["s"], 3.0).groupBy("k").agg(F.sum("dt").alias("d")).collect()}
    assert [round(got[k], 9) for k in range(6)] == [b - a for a, b in spans]


def test_guided_subsample_hits_the_coarse_nodes(spark):
    rng = np.random.default_rng(3)
    pose = lambda i, d: (1, float(i), (rng.normal(size=3).tolist() if d is None else d[0], rng.normal(size=3).tolist() if d is None else d[1]))
    ddl = "s int, t double, pose struct<r:array<double>,t:array<double>>"
    guide = [pose(i, None) for i in range(12)]
    coarse = [guide[1], guide[10]]
    out = trajectories.guided_subsample(spark.createDataFrame(coarse, ddl), spark.createDataFrame(guide, ddl), ["s"]).orderBy("t").collect()
    assert len(out) == 10
    for row, want in zip(out, guide[1:11], strict=True):
        assert np.allclose(row["pose"]["t"], want[2][1], atol=1e-6)


def test_gyro_of_constant_rate(spark):
    g = spark.createDataFrame([(1, i / 100, [0.0, 0.3, 0.0]) for i in range(101)], "s int, t double, value array<double>")
    q = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 0.0)], "s int, k int, t0 double, tf double")
    got = {r["k"]: r["r"] for r in trajectories.gyro_rotation(g, q, ["s"], 0.5).collect()}
    assert np.allclose(got[0], [0, 0.3, 0], atol=1e-9) and np.allclose(got[1], [0, -0.3, 0], atol=1e-9)
    a = spark.createDataFrame([(1, i / 100, [1.0, 0.0, 9.81]) for i in range(101)], "s int, t double, value array<double>")
    still = g.withColumn("value", vector(0, 0, 0))
    v = trajectories.accelerometer_velocity(still, a, q.where("k = 0"), ["s"], 0.5).first()
    assert np.allclose(v["dv"], [1, 0, 9.81], atol=1e-6)


def _turning(spark, w=0.8, force=(0.5, -0.25, 1.0), n=240, step=0.01):
    """Poses, gyro and accelerometer of a body that turns about z and is pushed by a constant force."""
    turn = lambda x: np.array([[np.cos(x), -np.sin(x), 0], [np.sin(x), np.cos(x), 0], [0, 0, 1.0]])
    at = [i * step for i in range(n)]
    poses = [(1, t, ([0.0, 0.0, w * t], (0.5 * np.array(force) * t * t).tolist())) for t in at]
    acc = [(1, t, (turn(w * (t + step / 2)).T @ (np.array(force) + [0, 0, 9.81])).tolist()) for t in at]
    series = lambda rows: spark.createDataFrame(rows, "s int, t double, value array<double>")
    return spark.createDataFrame(poses, "s int, t double, pose struct<r:array<double>,t:array<double>>"), series([(1, t, [0.0, 0.0, w]) for t in at]), series(acc)


def test_alignment_of_a_turning_body(spark):
    poses, gyro, acc = _turning(spark)
    rows = trajectories.alignment(poses, gyro, acc, ["s"], 0.5).orderBy("k").collect()
    assert len(rows) > 70 and all(a["tf"] == b["t0"] for a, b in zip(rows[:-1], rows[1:], strict=True))
    for row in rows:
        assert np.allclose(row["rot_gyro"], row["rot_poses"], atol=1e-6) and np.isclose(row["rot_poses"][2], 0.8 * (row["tf"] - row["t0"]))
    full = [r for r in rows if r["m0"] is not None]
    assert 0 < len(rows) - len(full) <= 2
    for row in full:
        x = 0.8 * row["m0"]
        want = [0.5 * np.cos(x) - 0.25 * np.sin(x), -0.5 * np.sin(x) - 0.25 * np.cos(x), 1.0]
        assert np.allclose(row["acc_poses"], want, atol=1e-6) and np.allclose(row["acc_sensor"], want, atol=0.02)


def test_segments_by_a_slow_scan(spark):
    rng = np.random.default_rng(5)
    times = {s: np.sort(np.round(rng.uniform(0, 20, 300), 1)) for s in range(4)} | {9: np.zeros(5)}
    rows = [(s, float(t), ([0.0, 0.0, 0.0], [float(t), 0.0, 0.0])) for s, ts in times.items() for t in ts] + [(1, None, None), (1, float("nan"), None)]
    got = trajectories.segments(spark.createDataFrame(rows, "s int, t double, pose struct<r:array<double>,t:array<double>>"), ["s"], F.lit(0.75)).collect()
    want = []
    for s, ts in times.items():
        at = ts[0]
        for t in ts:
            if t >= at + 0.75:
                want.append((s, at, t))
                at = t
    assert sorted((r["s"], r["t0"], r["tf"]) for r in got) == want and all(r["b"]["t"][0] == r["tf"] for r in got)


def test_rotation_of_half_a_turn(spark):
    df = spark.range(1).select(rotations.rotation_vector(rotations.rotation_matrix(vector(0, np.pi, 0))).alias("r"), rotations.vector_of_components(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("q"))
    r = df.first()
    assert np.allclose(np.abs(r["r"]), [0, np.pi, 0]) and np.allclose(r["q"], [0, 0, np.pi])


def test_peel_is_a_fixpoint(spark):
    nodes = spark.createDataFrame([(i, 2) for i in range(6)], "id long, dof int")
    obs = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (5, 5, 9), (7, 1, 3)], "id1 long, id2 long, n int")
    kept = graphs.constrained(nodes, graphs.build_edges(obs, nodes))
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    assert graphs.constrained(nodes.limit(0), graphs.build_edges(obs, nodes.limit(0))).count() == 0


def test_flat_raster_is_hit_at_its_height(spark):
    raster = spark.createDataFrame([(i, j, 0.0) for i in range(40) for j in range(40)], "i long, j long, v double")
    rays = spark.createDataFrame([(k, [20.0, 20.0, 10.0], [0.1 * k, 0.05 * k, -1.0]) for k in range(8)] + [(9, [20.0, 20.0, 10.0], [0.0, 0.0, 1.0])], "ray_id int, origin array<double>, direction array<double>")
    got = {r["ray_id"]: r["distance"] for r in rasters.ray_hits(raster, rays).collect()}
    assert all(abs(got[k] - 10.0) < 1e-9 for k in range(8)) and np.isnan(got[9])


def test_rays_reach_far_and_meet_few_cells(spark, tmp_path, monkeypatch):
    """A hit lies as far as it lies, and the cells entered grow with the hits and not with the raster."""
    tested = []
    entered = rasters._entered
    monkeypatch.setattr(rasters, "_entered", lambda *a: tested.append(entered(*a)) or tested[-1])
    for n in (32, 128):
        raster = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"), (F.col("id") * 7 % 5).cast("double").alias("v"))
        rays = spark.createDataFrame([(1, [3.3, 3.4, 1000.0], [0.01, 0.02, -1.0]), (2, [-500.2, 10.3, 302.0], [5.1, 0.01, -3.0]), (3, [5.5, 5.5, 50.0], [0.0, 0.0, -1.0]), (4, [5.0, 5.0, 50.0], [1.0, 0.0, 0.0])], "ray_id int, origin array<double>, direction array<double>")
        tested.clear()
        got = {r["ray_id"]: r["distance"] for r in rasters.ray_hits(raster, rays).collect()}
        assert 995 < got[1] < 1001 and 98 < got[2] < 101 and 45 < got[3] <= 50 and np.isnan(got[4])
        assert sum(t.count() for t in tested) < 4 * 3 * 16 * np.log2(n)
    assert rasters.ray_hits(raster.limit(0), rays).where("isnan(distance)").count() == 4


def test_resection_finds_the_pose(spark):
    rng = np.random.default_rng(2)
    world = rng.uniform(-3, 3, size=(12, 3)) + [0, 0, 10]
    uv = 500 * (world[:, :2] - [0.5, -0.2]) / (world[:, 2:] + 1) + [320, 240]
    df = spark.createDataFrame([(1, w.tolist(), o.tolist(), 500.0, [320.0, 240.0]) for w, o in zip(world, uv, strict=True)], "image int, p array<double>, uv array<double>, f double, pp array<double>")
    r = estimation.resection(df, ["image"]).first()
    assert np.allclose(r["t"], [0.5, -0.2, -1], atol=1e-3) and r["rms"] < 1e-3


def test_next_id_fills_the_first_gap(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    assert catalog.next_id(ids([0, 1, 3])).first()[0] == 2
    assert catalog.next_id(ids([5])).first()[0] == 0
    assert catalog.next_id(ids(range(65536))).first()[0] == 65536
    assert catalog.next_id(ids([])).first()[0] == 0


def test_table_files_round_trip(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("b , a\n1,2\n3\n4,5,6")
    t = tables.read_table(spark, str(f))
    assert tables.columns(t) == ["a", "b"]
    assert [(r["b"], r["a"]) for r in t.orderBy("_row").collect()] == [("1", "2"), ("3", None), ("4", "5")]
    assert tables.cell(t, "nope", 0).first()[0] is None and tables.cell(t, "b", 1).first()[0] == "3"
    tables.write_table(t, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() >= 4


def test_sides_that_are_no_correspondence(spark):
    texts = ["UV 3 1 2", "uv x 1 2", "UV 3 1", "UV 3 1 2 3", "XYZ 1 1 2 nan", "PRIOR", "GEOXY EPSG:4979 1 2", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(notation.parse_side(F.col("t"))["kind"]).collect()]
    assert got == ["UV", "INVALID", "INVALID", "INVALID", "INVALID", "PRIOR", "GEOXY", "INVALID"]


def test_paths_and_gps_layout(spark):
    assert exchange.relative_path("/a/b/c", "/a") == "b/c" and exchange.absolute_path("b", "/a") == "/a/b" and exchange.project_path("x") == "x.json"
    with pytest.raises(ValueError):
        sensors.gps(spark.createDataFrame([("1",)], "value string"), sensors.Layout(groups={"position": (1, -1, 2)}))


def test_running_integral_streams(spark, tmp_path):
    from trailmark.streaming.integrals import running_integral

    d = tmp_path / "in"
    spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 0.0)], "series long, t double, value double").coalesce(1).write.parquet(str(d))
    s = spark.readStream.schema("series long, t double, value double").parquet(str(d))
    q = running_integral(s).writeStream.format("memory").queryName("integral").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("integral").orderBy(F.desc("n")).first()["integral"] == 8.0


def test_running_integral_of_late_samples(spark, tmp_path):
    import os

    from trailmark.streaming.integrals import running_integral

    ddl, d = "series long, t double, value double", tmp_path / "in"
    d.mkdir()
    # 2 comes a batch late, 0.5 later than the watermark that 40 sets.
    for k, rows in enumerate([[(1, 0.0, 2.0), (1, 3.0, 5.0)], [(1, 2.0, 1.0), (1, 40.0, 4.0)], [(1, 41.0, 0.0)], [(1, 0.5, 9.0), (1, 43.0, 0.0)]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        f = next((tmp_path / f"b{k}").glob("part-*.parquet"))
        f.rename(d / f"{k}.parquet")
        os.utime(d / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(d))
    q = running_integral(s, "10 seconds").writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = [tuple(r) for r in spark.table("late").orderBy("t_last", "n").collect()]
    assert out == [(1, 2, 3.0, 6.0, 0), (1, 4, 40.0, 190.0, 0), (1, 5, 41.0, 194.0, 0), (1, 6, 43.0, 194.0, 1)]


def test_entry_imports_without_a_session():
    """Queries and SQL are listed before there is a session."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.endswith("[]\n"), said.stderr


def test_names_are_for_their_kind_of_block_only(spark):
    pairs = spark.createDataFrame([(1, "UV 20 1 2, XYZ 20 3 4 5"), (2, "UV 7 1 2, XYZ 8 3 4 5"), (3, None)], "k int, value string").select("k", notation.parse_pair(F.col("value")).alias("pair"))
    names = spark.createDataFrame([(20, "a b", "XYZ"), (7, "c", "XYZ")], "id long, name string, kind string")
    got = dict(map(tuple, exchange.correspondence_lines(pairs, names).collect()))
    assert got == {1: "UV 20 1.00 2.00, XYZ a b 3 4 5", 2: "UV 7 1.00 2.00, XYZ 8 3 4 5", 3: None}
    got = dict(map(tuple, exchange.correspondence_lines(pairs, names.drop("kind")).collect()))
    assert got == {1: "UV a b 1.00 2.00, XYZ a b 3 4 5", 2: "UV c 1.00 2.00, XYZ 8 3 4 5", 3: None}


def test_words_of_a_line_are_split_once(spark):
    lines = spark.createDataFrame([("1,2,0,0,0",), ("2,nan,0,0,0",), ("3,1,0",), ("# 4,1,0,0,0",), (None,), ("5,0,0,0,1e999",)], "value string")
    rows = sensors.angular(lines, sensors.Layout(values=(1, 2, 3, 4), angle="quaternion"), finite=True)
    assert [r["t"] for r in rows.collect()] == [1.0]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_clicks_and_observations_that_pile_up_make_no_pairs(spark):
    seen = spark.range(200_000).select(F.lit(0).alias("g"), F.col("id").alias("obs_id"), (F.col("id") % 2 * 10.0).alias("x"), F.lit(0.0).alias("y"))
    clicks = spark.range(200_000).select(F.lit(0).alias("g"), F.col("id").alias("click_id"), (F.col("id") % 3 * 10.0 + 0.5).alias("cx"), F.lit(0.25).alias("cy"))
    got = catalog.pick(seen, clicks, ["g"], 4.0).groupBy("obs_id", "d").agg(F.count("*").alias("n")).collect()  # 40,000 million pairs, if all met
    assert sorted(map(tuple, got)) == [(0, 0.5, 66667), (1, 0.5, 66667)]


def test_edges_and_counts_are_dealt_by_key_before_they_are_summed(spark):
    from trailmark.operators import catalog, graphs

    obs = spark.createDataFrame([(1, 2, 1), (2, 1, 4), (1, 1, 9), (3, 2, 1), (3, 7, 1)], "id1 long, id2 long, n int")
    edges = graphs.build_edges(obs, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, None), (None, 5)], "owner long, item long")
    counts = catalog.referred_counts(rows, "owner", "item", spark.createDataFrame([(6,)], "item long"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 5), (2, 3, 1)]
    assert {(r["owner"], r["n"]) for r in counts.collect()} == {(1, 1), (2, 0), (None, 1)}
    for df in (edges, counts):
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_vertical_is_made_once(spark):
    places = spark.range(3).select((F.col("id") * 40.0 - 40).alias("lat"), (F.col("id") * 70.0).alias("lon"))
    c = places.withColumn("c", geodesy.horizontal_constraint(F.col("lat"), F.col("lon"), F.lit(-100.0), F.lit(1000.0))).select("lat", "c.P", "c.d")
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") + plan.count("COS(") < 100, "positions and axes are made again for each number that needs them"
    for row in c.collect():
        p = np.array(row["P"]).reshape(2, 3)
        assert np.allclose(p @ p.T, np.eye(2), atol=1e-9) and abs(p[0, 2] - np.cos(np.radians(row["lat"]))) < 1e-5 and row["d"][1] == pytest.approx(0, abs=1e-6)


def test_landmark_errors_are_plain_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, k, float(rng.normal()), float(rng.normal()), (rng.normal(0, 0.5, 3).tolist(), rng.normal(size=3).tolist()), [*rng.normal(size=2).tolist(), 12.0], 80.0, [1.0, 2.0]) for k in range(9)]
    rows += [(3, 1, 0.0, 0.0, ([0.0] * 3, [0.0] * 3), [0.0, 0.0, -1.0], 80.0, [1.0, 2.0]), (4, 1, 0.0, 0.0, None, [0.0, 0.0, 1.0], 80.0, [1.0, 2.0])]
    obs = spark.createDataFrame(rows, "landmark_id int, image_id int, u double, v double, pose struct<r:array<double>,t:array<double>>, p array<double>, f double, pp array<double>")
    e = estimation.projection_residual(F.col("pose.r"), F.col("pose.t"), F.col("p"), F.col("f"), F.col("pp"), F.array("u", "v"))
    sizes = {}
    for row in obs.select("landmark_id", e.alias("e")).collect():
        sizes.setdefault(row["landmark_id"], []).append(np.hypot(*row["e"]) if row["e"] and None not in row["e"] else None)
    report = estimation.landmark_report(obs)
    got = {r["landmark_id"]: r for r in report.collect()}
    for k in range(3):
        assert got[k]["n_images"] == 3 and got[k]["mean_error"] == pytest.approx(np.mean(sizes[k])) and got[k]["max_error"] == pytest.approx(max(sizes[k]))
    assert np.isnan(got[3]["max_error"]) and got[4]["max_error"] is None and sizes[4] == [None]
    assert "lambda" not in report._jdf.queryExecution().optimizedPlan().toString(), "functions over arrays are interpreted row by row"
