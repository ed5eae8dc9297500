"""Bundle adjustment against a dense solution with NumPy."""

import numpy as np
import pandas as pd


from trailmark.operators import bundle


def scene(spark, seed=0, n=4, m=14, noise=0.0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-2, 2, (m, 3)) + [0, 0, 8]
    t = np.stack([np.linspace(-2, 2, n), rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)], 1)
    r = rng.normal(0, 0.1, (n, 3))
    seen = [(c, k) for c in range(n) for k in range(m) if (c + k) % 4]
    c, k = np.array(seen).T
    f, pp = np.full(len(c), 1000.0), np.zeros((len(c), 2))
    uv = bundle.linearised(r[c], t[c], p[k], f, pp, np.zeros((len(c), 2)), np.ones(len(c)))[0] + rng.normal(0, noise, (len(c), 2))
    r0, t0, p0 = r + rng.normal(0, 0.01, r.shape), t + rng.normal(0, 0.05, t.shape), p + rng.normal(0, 0.05, p.shape)
    r0[0], t0[0] = r[0], t[0]
    prior = [None if i % 2 else (t[i]).tolist() for i in range(n)]
    cams = [(i, r0[i].tolist(), t0[i].tolist(), 1000.0, [0.0, 0.0], i == 0, prior[i], 20.0) for i in range(n)]
    cams.append((99, [0.0] * 3, [1.0, 2.0, 3.0], 1000.0, [0.0, 0.0], False, None, None))  # sees nothing
    cameras = spark.createDataFrame(cams, "id int, r array<double>, t array<double>, f double, pp array<double>, fixed boolean, prior array<double>, weight double")
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p0)] + [(50, [1.0, 1.0, 1.0])], "id int, p array<double>")
    obs = spark.createDataFrame([(int(a), int(b), float(u), float(v), 0.5) for (a, b), (u, v) in zip(seen, uv, strict=True)], "camera int, point int, u double, v double, sigma double")
    return cameras, points, obs, (r, t, p, r0, t0, p0, c, k, uv, prior)


def dense(r, t, p, c, k, uv, prior, rounds):
    """Normal equations of all free parameters at once."""
    n, m = len(r), len(p)

    def system():
        res, a, b = bundle.linearised(r[c], t[c], p[k], np.full(len(c), 1000.0), np.zeros((len(c), 2)), uv, np.full(len(c), 0.5))
        j = np.zeros((len(c), 2, 6 * n + 3 * m))
        for i in range(len(c)):
            j[i, :, 6 * c[i] : 6 * c[i] + 6], j[i, :, 6 * n + 3 * k[i] : 6 * n + 3 * k[i] + 3] = a[i], b[i]
        rows, off = [j.reshape(-1, j.shape[2])], [res.ravel()]
        for i in range(1, n):
            if prior[i] is not None:
                e = np.zeros((3, j.shape[2]))
                e[:, 6 * i + 3 : 6 * i + 6] = 20 * np.eye(3)
                rows, off = [*rows, e], [*off, 20 * (t[i] - prior[i])]
        return np.concatenate(rows)[:, 6:], np.concatenate(off)

    for _ in range(rounds):
        j, e = system()
        x = np.concatenate([np.zeros(6), np.linalg.lstsq(j, -e, rcond=None)[0]])
        for i in range(n):
            turned = bundle._matrices(r[i : i + 1])[0] @ bundle._matrices(x[None, 6 * i : 6 * i + 3])[0]
            from trailmark.operators.trajectories import _log

            r[i], t[i] = _log(turned), t[i] + x[6 * i + 3 : 6 * i + 6]
        p += x[6 * n :].reshape(-1, 3)
    j, e = system()
    return r, t, p, e @ e, np.linalg.inv(j.T @ j)


def test_slopes(spark):
    rng = np.random.default_rng(1)
    r, t, p, w = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=(5, 3)) + [0, 0, 9], rng.normal(size=(5, 2))
    f, pp, s = np.full(5, 7.0), np.ones((5, 2)), np.full(5, 0.3)
    res, a, b = bundle.linearised(r, t, p, f, pp, w, s)
    m = bundle._matrices(r)
    at = lambda m, t, p: ((lambda q: f[:, None] * q[:, :2] / q[:, 2:] + pp - w)(np.einsum("nji,nj->ni", m, p - t))) / 0.3
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        assert np.allclose((at(m @ bundle._matrices(np.tile(e, (5, 1))), t, p) - res) / 1e-6, a[:, :, i], rtol=1e-3, atol=1e-3)
        assert np.allclose((at(m, t + e, p) - res) / 1e-6, a[:, :, 3 + i], rtol=1e-3, atol=1e-3) and np.allclose((at(m, t, p + e) - res) / 1e-6, b[:, :, i], rtol=1e-3, atol=1e-3)


def test_adjustment_equals_dense_solution(spark):
    cameras, points, obs, (_, _, _, r0, t0, p0, c, k, uv, prior) = scene(spark, noise=0.3)
    s = bundle.Scene(cameras, points, obs)
    costs = s.adjust(rounds=3, damping=1e-9, near=1e-4, enough=1e-7)
    r, t, p, cost, covariance = dense(r0.copy(), t0.copy(), p0.copy(), c, k, uv, prior, 5)
    assert costs[0] > 100 * cost and all(b <= a for a, b in zip(costs, costs[1:], strict=False)) and abs(costs[-1] - cost) < 1e-4 * cost
    got = {x["id"]: x for x in s.cameras.collect()}
    assert all(np.allclose(got[i]["t"], t[i], atol=1e-3) and np.allclose(got[i]["r"], r[i], atol=1e-3) for i in range(4))
    assert got[99]["t"] == [1.0, 2.0, 3.0]
    places = {x["id"]: x["p"] for x in s.points.collect()}
    assert all(np.allclose(places[i], p[i], atol=1e-3) for i in range(len(p))) and places[50] == [1.0, 1.0, 1.0]
    block = s.covariance([2], near=1e-4).toPandas().sort_values("k")[[f"x{i}" for i in range(6)]].to_numpy()
    assert np.allclose(block, covariance[6:12, 6:12], rtol=1e-2, atol=1e-9)


def test_empty_scene(spark):
    cameras, points, obs, _ = scene(spark)
    assert bundle.Scene(cameras.limit(0), points.limit(0), obs.limit(0)).adjust(rounds=1)[0] == 0.0




def test_products_by_pairs_and_by_rows_agree(spark, monkeypatch):
    n = 40
    cams = [(i, [0.001 * (i % 3), 0.0, 0.0], [float(i), i % 4 * 0.01, 0.0], 1000.0, [0.0, 0.0], False, [float(i), 0.0, 0.0], 200.0) for i in range(n)]
    p = np.array([(k % (n - 3) + 1.5 + k * 37 % 100 / 50, k * 53 % 100 / 40 - 1.2, 8 + k * 71 % 100 / 25) for k in range(8 * n)])
    seen = [(k % (n - 3) + j, k) for k in range(8 * n) for j in range(4)]
    c, k = np.array(seen).T
    uv = bundle.linearised(np.zeros((len(c), 3)), np.stack([c, 0 * c, 0 * c], 1).astype(float), p[k], np.full(len(c), 1000.0), np.zeros((len(c), 2)), np.zeros((len(c), 2)), np.ones(len(c)))[0]
    cameras = spark.createDataFrame(cams, "id int, r array<double>, t array<double>, f double, pp array<double>, fixed boolean, prior array<double>, weight double")
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id int, p array<double>")
    obs = spark.createDataFrame([(int(a), int(b), float(u), float(v), 1.0) for (a, b), (u, v) in zip(seen, uv, strict=True)], "camera int, point int, u double, v double, sigma double")
    s = bundle.Scene(cameras, points, obs)
    linear, _ = s._linear("test")
    blocks, diagonal = s._system(linear, 1e-8, "test")
    right = diagonal.selectExpr("0 as k", "camera", *[f"cast(pmod(camera * {7 + a}, 11) - 5 as double) as r{a}" for a in range(6)])
    pairs = bundle.Reduced(linear, blocks, diagonal, f"{s.path}/pairs")
    x = right.toDF("k", "camera", *[f"x{a}" for a in range(6)])
    found = pairs.times(x).orderBy("camera").toPandas()
    monkeypatch.setattr(bundle.Reduced, "FEW", 3)
    rows = bundle.Reduced(linear, blocks, diagonal, f"{s.path}/rows")
    assert pairs.many is None and rows.many is not None and rows.pairs.where("camera <> other").isEmpty()
    q = [f"q{a}" for a in range(6)]
    wanted = rows.times(x).orderBy("camera").toPandas()[q].to_numpy()
    assert np.allclose(found[q].to_numpy(), wanted, rtol=1e-6, atol=1e-6 * np.abs(wanted).max())


def test_solution_of_a_group():
    rng = np.random.default_rng(2)
    j = rng.normal(size=(40, 18))
    a, r = j.T @ j, rng.normal(size=18)
    blocks = a.reshape(3, 6, 3, 6).transpose(0, 2, 1, 3).reshape(9, 36)
    d = pd.DataFrame(blocks, columns=bundle._C).assign(g=4, at=np.repeat([3, 5, 9], 3), to=np.tile([3, 5, 9], 3))
    f = bundle._factor(d.sample(frac=1, random_state=0))["f"].iloc[0]
    z = next(bundle._near_solutions(iter([pd.DataFrame({"k": [0], "f": [f], "cameras": [[7, 8, 11]], "r": [r.reshape(3, 6).tolist()]})])))
    assert list(z["camera"]) == [7, 8, 11] and np.allclose(z[bundle._Z6].to_numpy().ravel(), np.linalg.solve(a, r), rtol=1e-4, atol=1e-6)
