"""Matching operators against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import assignment as assignment_module
from trailmark.operators import matching, nearest, robust, rounds
from trailmark.operators.assignment import assignment
from trailmark.operators.corners import suppressed, top_corners
from trailmark.plans.q_matching import _views


def least_total(c: np.ndarray, skip: float) -> float:
    """Least cost over all ways to match rows or leave them alone."""
    n, m = c.shape
    wide = np.concatenate([c, np.full((n, n), skip)], axis=1)
    return min(sum(wide[i, p[i]] for i in range(n)) for p in permutations(range(n + m), n))


@pytest.mark.parametrize("block", [5, 4096])
def test_assignment_is_least_cost(spark, block):
    rng = np.random.default_rng(0)
    costs = {g: np.round(rng.uniform(size=(4, 4)) * (1 if g else 0.2), 2) for g in (0, 1, None)}  # rounding makes ties
    df = spark.createDataFrame([(g, i, j, float(c[i, j])) for g, c in costs.items() for i in range(4) for j in range(4)], "g int, i int, j int, cost double")
    for skip in (0.3,) if block < 8 else (0.15, 0.6, 1e6):
        got = assignment(df, ["g"], skip, digits=2, block=block).collect()
        assert len({(r["g"], r["i"]) for r in got}) == len({(r["g"], r["j"]) for r in got}) == len(got)
        for g, c in costs.items():
            own = [r["cost"] for r in got if r["g"] == g]
            assert abs(sum(own) + skip * (4 - len(own)) - least_total(c, skip)) < 1e-9 * max(1, skip)
    assert assignment(df, ["g"], 0.0, block=block).count() == 0


def test_larger_assignment_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(1)
    c = np.round(rng.uniform(size=(14, 12)), 2)
    df = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(14) for j in range(12)], "i int, j int, cost double").withColumn("g", F.lit("a"))
    total = lambda **how: sum(r["cost"] - 0.2 for r in assignment(df, ["g"], 0.2, digits=2, **how).collect())
    assert abs(total() - total(block=18)) < 1e-9
    few = assignment(df, ["g"], 0.2, best=3).collect()
    assert few and all(sorted(c[r["i"]]).index(r["cost"]) < 3 for r in few)


def greedy(rows, radius):
    kept = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 > radius**2 for _, a, b, _ in kept):
            kept.append((i, x, y, s))
    return {k[0] for k in kept}


@pytest.mark.parametrize("radius", [0.0, 3.0, 10.0, 200.0])
def test_suppression_is_greedy(spark, radius):
    rng = np.random.default_rng(2)
    spots = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(*rng.integers(0, 60, (2, 150)), rng.integers(0, 6, 150), strict=True))]
    spots += [(500 + i, 0.9 * radius * i, -100.0, 9.0 - i) for i in range(9)] + [(600, 9.9, 1000.0, 1.0), (601, 10.1, 1000.0, 2.0)]
    df = spark.createDataFrame([(g, *s) for g in (1, None) for s in spots] + [(1, 700, None, 1.0, 5.0)], "img int, id int, x double, y double, score double").withColumn("cx", F.lit("mine"))
    got = suppressed(df, ["img"], radius).collect()
    for g in (1, None):
        assert {r["id"] for r in got if r["img"] == g} == greedy(spots, radius)
    assert all(r["cx"] == "mine" for r in got)
    top = top_corners(df, ["img"], 5, radius).where("img = 1").orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, len(top) + 1)) and top[0]["score"] == 9.0
    assert suppressed(df.limit(0), ["img"], radius).count() == 0


def test_nearest_in_plane(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1000, (60, 2)), rng.normal(500, 0.01, (40, 2)), np.full((9, 2), 7.0), [[1e5, 1e5]]])
    df = spark.createDataFrame([(g, i, float(x), float(y)) for g in ("a", None) for i, (x, y) in enumerate(p)] + [("b", 0, 1.0, 1.0), ("c", 0, 1.0, 1.0), ("c", 1, 1.0, 1.0)], "g string, id int, x double, y double")
    got = nearest.nearest_in_plane(df, ["g"], 7).collect()
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    for g in ("a", None):
        for i in range(len(p)):
            want = sorted((d[i, j], j) for j in range(len(p)) if j != i)[:7]
            own = sorted((r["rank"], r["other"]) for r in got if r["g"] == g and r["id"] == i)
            assert [o for _, o in own] == [j for _, j in want]
    assert {(r["id"], r["other"]) for r in got if r["g"] == "c"} == {(0, 1), (1, 0)} and not [r for r in got if r["g"] == "b"]


@pytest.mark.parametrize("block", [4, 1024])
def test_least_costs_and_candidates(spark, block):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 6))
    b = np.concatenate([a[:50] + rng.normal(0, 0.02, (50, 6)), rng.normal(size=(20, 6))])
    rows = lambda v: spark.createDataFrame([(g, i, x.tolist()) for g in (1, None) for i, x in enumerate(v)], "g int, id long, vec array<double>")
    exact = nearest.least_costs(rows(a), rows(b), ["g"], 2, block=block)
    cost = np.abs(a[:, None] - b[None]).sum(2)
    got = exact.where("g is null").collect()
    assert {(r["i"], r["j"]) for r in got if r["of"] == 0} == {(i, int(j)) for i in range(60) for j in cost[i].argsort()[:2]}
    assert {(r["i"], r["j"]) for r in got if r["of"] == 1} == {(int(i), j) for j in range(70) for i in cost[:, j].argsort()[:2]}
    pairs = {(r["i"], r["j"]) for r in matching.mutual_best(exact, ["g"], 1.0).where("g = 1").collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(70) if cost[i, j] == cost[i].min() == cost[:, j].min()}
    found = matching.candidate_costs(rows(a[:50]), rows(b), ["g"], 2, 6, width=4.0)
    assert matching.recall(nearest.least_costs(rows(a[:50]), rows(b), ["g"], 2), found, ["g"]) >= 0.9
    assert found.count() < 2 * 2 * 120
    assert nearest.least_costs(rows(a).limit(0), rows(b), ["g"], 2).count() == 0


def test_kth_least(spark, tmp_path):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=400), 1), "c": np.full(7, 3.5), None: rng.exponential(size=64) ** 9}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)], "g string, v double")
    got = {r["g"]: r["v"] for r in rounds.kth_least(df, ["g"], "v", F.floor(F.col("n") / 2), str(tmp_path), bins=8).collect()}
    assert got == {g: float(np.sort(v)[len(v) // 2]) for g, v in groups.items()}


def test_placed(spark, tmp_path):
    df = spark.createDataFrame([(g, i * 7 % 40, "x") for g in (1, None) for i in range(40)], "g int, v int, part string")
    got = rounds.placed(df, ["g"], [F.col("v")], "place", str(tmp_path / "p"))
    assert got.columns == ["g", "v", "part", "place"] and got.where("place = v").count() == 80


def test_samples_are_early_and_different(spark):
    got = robust.samples(spark.createDataFrame([(1, 4), (2, 1000), (None, 50)], "g int, n long"), ["g"], 4, 200, 0).collect()
    assert all(len(set(r["places"])) == 4 and 0 <= min(r["places"]) and max(r["places"]) < {1: 4, 2: 1000, None: 50}[r["g"]] for r in got)
    first = np.array([r["places"] for r in got if r["g"] == 2])
    assert 50 < np.median(first) + 50 < 150  # a place k in proportion to 1 / (k + 1)


def test_robust_marks_outliers(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, size=(40, 2))
    rows = [(g, k, x, y, x + 5.0 + (40.0 if k % 8 == 7 else 0.0), y - 2.0) for g in (1, None) for k, (x, y) in enumerate(p.tolist())] + [(2, k, 0.0, 0.0, float(k), 1.0) for k in range(3)] + [(3, k, 1.0, 1.0, 2.0, 2.0) for k in range(9)]
    df = spark.createDataFrame(rows, "pair int, match_id int, x1 double, y1 double, x2 double, y2 double").withColumn("m", F.lit("mine"))
    got = robust.robust(df.drop("m"), ["pair"], "perspective", 1.0).collect()
    assert all(r["inlier"] == (r["match_id"] % 8 != 7) for r in got if r["pair"] in (1, None))
    assert all(r["inlier"] for r in got if r["pair"] == 2) and not any(r["inlier"] for r in got if r["pair"] == 3)


def test_second_pass_by_neighbours(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0, 100, size=(50, 2))
    rows = [(1, k, x, y, 1.1 * x + 5 + (8.0 if k == 17 else 0.0), y - 2.0) for k, (x, y) in enumerate(p.tolist())] + [(2, k, float(k), float(k * k), 1.0, 1.0) for k in range(4)]
    df = spark.createDataFrame(rows, "pair int, match_id int, x1 double, y1 double, x2 double, y2 double")
    kept = {(r["pair"], r["match_id"]) for r in robust.by_neighbours(df, ["pair"], 5.0).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    q = np.array([r[4:] for r in rows if r[0] == 1])
    want = set()
    for k in range(50):
        own = [j for j in d[k].argsort(kind="stable") if j != k][:7]
        m = robust.perspective(p[own], q[own])
        at = m @ [*p[k], 1]
        if np.hypot(*(at[:2] / at[2] - q[k])) <= 5.0:
            want.add((1, k))
    assert kept == want and (1, 17) not in kept


def test_pipeline_stages(spark):
    one, two = _views(spark, "/root/testdata/sf0.001")
    shift = lambda m: m.withColumn("x2", F.col("x2") + 1000)
    got = matching.match_images(one, two, ["pair"], [(0, 0), (1, 1), (1, 1)], radius=5.0, rounds=40, refine=shift, matcher=matching.assigned).collect()
    assert {(r["scale1"], r["scale2"]) for r in got} == {(0, 0), (1, 1)} and min(r["x2"] for r in got) >= 1000
    assert all(r["i"] == r["j"] for r in got if r["inlier"]) and sum(r["inlier"] for r in got) > 100
    near = matching.match_images(one, two, ["pair"], [(0, 0), (1, 1)], radius=5.0, rounds=40, width=0.5, dim=8, sub_threshold=None)
    assert near.where("inlier").count() > 100
    assert matching.matched_corners(one, near, ["pair"], "i").count() > 100
    text = matching.as_correspondences(spark.createDataFrame([(1, 2, 3, 1.5, 2.5, 3.5, 4.5)], "match_id int, image1 int, image2 int, u1 double, v1 double, u2 double, v2 double"))
    assert text.first()["value"] == "UV 2 1.50 2.50, UV 3 3.50 4.50"


def test_wide_joins_broadcast_nothing(spark):
    a = spark.createDataFrame([(1, 2), (None, 3)], "k int, x int")
    b = spark.createDataFrame([(1, 5), (None, 6)], "k int, y int")
    got = rounds.joined(a, b, ["k"], wide=True)
    assert sorted(map(tuple, got.select("x", "y").collect())) == [(2, 5), (3, 6)]
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_groups_beyond_4096_bidders_are_one_auction(spark, monkeypatch):
    monkeypatch.setattr(assignment_module, "_in_rounds", None)
    cost = spark.range(2500).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.explode(F.array("id", F.col("id") + 1)).alias("j"), F.lit(1.0).alias("cost"))
    cost = cost.withColumn("cost", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.5))
    found = assignment_module.assignment(cost, ["g"], 2.0)
    n, total = found.agg(F.count("*"), F.sum("cost")).first()
    assert (n, total) == (2500, 1250.0)


def test_least_costs_do_not_depend_on_blocks(spark):
    rows = lambda odd: spark.range(60).where(f"id % 2 = {odd}").select((F.col("id") % 3).alias("g"), "id", F.array(F.col("id") * 7 % 11, F.col("id") * 5 % 13).cast("array<double>").alias("vec"))
    few, many = (sorted(map(tuple, nearest.least_costs(rows(0), rows(1), ["g"], 2, block=b).select("g", "of", "i", "j", "cost", "rank").collect())) for b in (1024, 2))
    assert few == many and len(few) == 120


def test_close_costs_are_exact(spark):
    rng = np.random.default_rng(7)
    a = {1: rng.uniform(size=(150, 8)), None: np.round(rng.uniform(size=(60, 3)), 1), 2: np.full((20, 4), 3.0), 3: rng.normal(size=(20, 2)), 4: rng.normal(size=(20, 2)), 5: rng.normal(size=(20, 1)) + 1e9, 6: np.zeros((2, 1))}
    b = {1: np.concatenate([a[1][:120] + rng.normal(0, 0.001, (120, 8)), rng.uniform(size=(20, 8))]), None: np.round(rng.uniform(size=(60, 3)), 1), 2: np.full((30, 4), 3.0), 3: rng.normal(size=(20, 2)), 4: rng.normal(size=(20, 2)), 5: a[5] + 1e-6, 7: np.zeros((2, 1))}
    a[3][3], b[4][5, 1] = np.nan, np.inf
    rows = lambda v: spark.createDataFrame([(g, i, x.tolist()) for g, v in v.items() for i, x in enumerate(v)], "g int, id long, vec array<double>")
    every = [(r["g"], r["of"], r["i"], r["j"], str(r["cost"]), r["rank"]) for r in nearest.least_costs(rows(a), rows(b), ["g"], 3).collect()]
    least = {(g, of, (i, j)[of]): float(c) for g, of, i, j, c, rank in every if rank == 1}
    want = {r for r in every if r[5] == 1 or float(r[4]) <= 1.1 * least[(r[0], r[1], r[2 + r[1]])] or np.isnan(least[(r[0], r[1], r[2 + r[1]])])}
    got = [(r["g"], r["of"], r["i"], r["j"], str(r["cost"]), r["rank"]) for r in nearest.close_costs(rows(a), rows(b), ["g"], 3, 1.1, cell=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pipeline_does_not_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "least_costs", None)
    monkeypatch.setattr(nearest, "least_costs", None)
    one, two = _views(spark, "/root/testdata/sf0.001")
    found = matching.match_images(one, two, ["pair"], [(0, 0), (1, 1)], n_corners=1_000_000, radius=5.0, rounds=60)
    assert sorted((r["i"], r["j"], r["inlier"]) for r in found.collect()) == [(k, k, k // 4 % 10 != 3) for k in range(200)]
