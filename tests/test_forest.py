"""Spanning forests and absolute poses against brute force."""

import numpy as np
import pytest

from trailmark.operators import forest
from trailmark.operators.bundle import _matrices
from trailmark.operators.forest import spanning_poses
from trailmark.operators.rounds import written
from trailmark.operators.trajectories import _log

POSE = "struct<r: array<double>, t: array<double>>"


def kruskal(nodes, edges):
    root, total, n = {k: k for k in nodes}, 0.0, 0
    find = lambda x: x if root[x] == x else find(root[x])
    for w, a, b in sorted(((w, a, b) for a, b, w in edges), reverse=True):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            total, n = total + w, n + 1
    return total, n, {k: find(k) for k in nodes}


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_poses_of_a_forest(spark, shape):
    rng = np.random.default_rng(0)
    n = 40
    r, t = rng.normal(0, 0.7, (n, 3)), rng.normal(0, 10, (n, 3))
    m = _matrices(r)
    if shape == "random":
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2)) if a != b] + [(35, 36)]
    else:
        pairs = [(k, k + 1) for k in range(n - 1)]
    weights = [float(rng.integers(0, 5)) for _ in pairs]  # with ties
    pose = lambda a, b: (_log(m[a].T @ m[b]).tolist(), (m[a].T @ (t[b] - t[a])).tolist())
    edges = [(a, b, w, pose(a, b)) for (a, b), w in zip(pairs, weights, strict=True)]
    odd = [(1, 1, 9.0, pose(1, 1)), (1, 99, 9.0, pose(1, 2)), (1, 2, None, pose(1, 2)), (2, 3, 9.0, None)]
    df = spark.createDataFrame(edges + odd, f"a long, b long, weight double, pose {POSE}")
    poses, picked = spanning_poses(spark.createDataFrame([(k,) for k in range(n)], "id long"), df)
    total, count, root = kruskal(range(n), [(a, b, w) for a, b, w, _ in edges])
    got = {x["id"]: x for x in poses.collect()}
    assert {k: x["root"] for k, x in got.items()} == root
    for k, x in got.items():
        want = m[root[k]].T @ m[k], m[root[k]].T @ (t[k] - t[root[k]])
        assert np.allclose(_matrices(np.array([x["pose"]["r"]]))[0], want[0], atol=1e-8) and np.allclose(x["pose"]["t"], want[1], atol=1e-8)
    own = picked.collect()
    assert len({frozenset((x["a"], x["b"])) for x in own}) == count and abs(sum({frozenset((x["a"], x["b"])): x["weight"] for x in own}.values()) - total) < 1e-9


def test_no_edges(spark):
    poses, picked = spanning_poses(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], f"a long, b long, weight double, pose {POSE}"))
    assert sorted((x["id"], x["root"], x["pose"]["t"][0]) for x in poses.collect()) == [(1, 1, 0.0), (2, 2, 0.0)] and picked.count() == 0


def test_strongest_edges_are_picked_without_their_poses(spark, monkeypatch):
    plans = []

    def kept(df, path):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, path)

    monkeypatch.setattr(forest, "written", kept)
    pose = lambda x: ([0.0, 0.0, 0.0], [x, 0.0, 0.0])
    edges = spark.createDataFrame([(1, 2, 1.0, pose(1.0)), (2, 1, 1.0, pose(5.0)), (2, 3, 2.0, pose(1.0)), (1, 3, 0.5, pose(9.0))], f"a long, b long, weight double, pose {POSE}")
    poses, _ = spanning_poses(spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "id long"), edges)  # 2 twice
    assert sorted((x["id"], x["root"], x["pose"]["t"][0]) for x in poses.collect()) == [(1, 1, 0.0), (2, 1, 1.0), (2, 1, 1.0), (3, 1, 2.0), (4, 4, 0.0)]
    assert not any("SortAggregate" in p for p in plans), "a task sorts all edges it reads, with their poses, to find the strongest ones"
