"""Bundle adjustment as rounds of joins and sums: landmarks are eliminated one by one, cameras are solved for by conjugate gradients.

A round makes the observations linear: a row has its residual, 2 x 6 numbers for its camera and 2 x 3 for its landmark. Sums by landmark give 3 x 3 blocks, which are
inverted in place. What is left is a system over cameras only. Landmarks that few cameras see are summed to blocks of pairs of cameras once a round; of those that more
cameras see no pairs are made, their rows are multiplied by two joins and two grouped sums. Neither cameras nor landmarks ever
come to the driver, only the two sums of an iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import rotations as R
from .rounds import placed, shared_folder, written

_A, _B, _X, _Z = [[f"a{m}{k}" for k in range(6)] for m in range(2)], [[f"b{m}{j}" for j in range(3)] for m in range(2)], [f"x{k}" for k in range(6)], [f"z{j}" for j in range(3)]
_C, _Z6 = [f"c{a}{b}" for a in range(6) for b in range(6)], [f"z{k}" for k in range(6)]
_LINEAR = ["r0", "r1", *_A[0], *_A[1], *_B[0], *_B[1]]


def _matrices(r: np.ndarray) -> np.ndarray:
    """Rotation matrices of axis-angle vectors (n, 3)."""
    t = np.linalg.norm(r, axis=1)[:, None, None]
    k = np.zeros((len(r), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -r[:, 2], r[:, 1], r[:, 2], -r[:, 0], -r[:, 1], r[:, 0]
    small = t < 1e-6
    safe = np.where(small, 1.0, t)
    s, c = np.where(small, 1 - t**2 / 6, np.sin(safe) / safe), np.where(small, 0.5 - t**2 / 24, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + s * k + c * (k @ k)


def linearised(r: np.ndarray, t: np.ndarray, p: np.ndarray, f: np.ndarray, pp: np.ndarray, uv: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (n, 2) of landmarks p in cameras (r, t, camera to world), and their slopes by turn and place of the camera (n, 2, 6) and by landmark (n, 2, 3)."""
    m = _matrices(r)
    q = np.einsum("nji,nj->ni", m, p - t)
    z = np.where(np.abs(q[:, 2]) > 1e-12, q[:, 2], 1e-12)
    s = 1 / sigma[:, None]
    res = (f[:, None] * q[:, :2] / z[:, None] + pp - uv) * s
    by_q = np.zeros((len(q), 2, 3))
    by_q[:, 0, 0] = by_q[:, 1, 1] = f / z
    by_q[:, :, 2] = -f[:, None] * q[:, :2] / z[:, None] ** 2
    by_q *= s[:, :, None]
    # A turn w after the camera's own changes q by q x w; a shift of the landmark by m^T.
    cross = np.zeros((len(q), 3, 3))
    cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0], cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = -q[:, 2], q[:, 1], q[:, 2], -q[:, 0], -q[:, 1], q[:, 0]
    by_p = by_q @ m.transpose(0, 2, 1)
    return res, np.concatenate([by_q @ cross, -by_p], axis=2), by_p


def _linear(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in frames:
        rows = lambda c: np.array(d[c].tolist(), float).reshape(len(d), -1)
        res, a, b = linearised(rows("r"), rows("t"), rows("p"), d["f"].to_numpy(float), rows("pp"), d[["u", "v"]].to_numpy(float), d["sigma"].to_numpy(float))
        a = np.where(d["fixed"].to_numpy(bool)[:, None, None], 0.0, a)
        yield pd.concat([d[["camera", "point"]], pd.DataFrame(np.concatenate([res, a.reshape(-1, 12), b.reshape(-1, 6)], axis=1), columns=_LINEAR)], axis=1)


def _dot(names: list[str], others: list[str]) -> Column:
    return sum((F.col(a) * F.col(b) for a, b in zip(names[1:], others[1:], strict=True)), F.col(names[0]) * F.col(others[0]))


def _inverted(v: DataFrame, damping: float) -> DataFrame:
    """(point, i00, i01, ...): inverses of the landmarks' blocks h00, h01, ... with their diagonals raised by a share; zeros where a landmark isn't held."""
    h = lambda i, j: F.col(f"h{min(i, j)}{max(i, j)}") * ((1 + damping) if i == j else 1.0)
    minor = lambda i, j: (lambda a, b, c, d: h(a, c) * h(b, d) - h(a, d) * h(b, c))(*[k for k in range(3) if k != i], *[k for k in range(3) if k != j])
    det = h(0, 0) * minor(0, 0) - h(0, 1) * minor(0, 1) + h(0, 2) * minor(0, 2)
    held = F.when(det > 1e-14 * h(0, 0) * h(1, 1) * h(2, 2), det)
    return v.select("point", "n", "g0", "g1", "g2", *[F.coalesce(minor(i, j) * ((-1) ** (i + j)) / held, F.lit(0.0)).alias(f"i{i}{j}") for i in range(3) for j in range(i, 3)])


def _by_landmark(sums: DataFrame, blocks: DataFrame, keys: list[str], sign: float = 1.0) -> DataFrame:
    """(keys, point, z0, z1, z2): the landmarks' inverse blocks times y0, y1, y2 of sums."""
    i = lambda a, b: F.col(f"i{min(a, b)}{max(a, b)}")
    return sums.join(blocks, "point").select(*keys, "point", *[(sign * sum((i(j, k) * F.col(f"y{k}") for k in range(1, 3)), i(j, 0) * F.col("y0"))).alias(_Z[j]) for j in range(3)])


def _pushed(linear: DataFrame, x: DataFrame) -> DataFrame:
    """(k, point, y0, y1, y2): slopes by landmark times what x (k, camera, x0, ...) does to residuals, summed by landmark."""
    met = linear.join(x, "camera")
    moved = [_dot(_A[m], _X) for m in range(2)]
    return met.groupBy("k", "point").agg(*[F.sum(F.col(_B[0][j]) * moved[0] + F.col(_B[1][j]) * moved[1]).alias(f"y{j}") for j in range(3)])


def _pairs(ids: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of pairs of cameras from landmarks (i, their inverse block, and s, their rows (camera, y)), summed over the landmarks of a batch; ids is the cameras' type."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, inverse = batch.column("s"), batch.column("i").flatten().to_numpy().reshape(-1, 3, 3)
            sizes = s.value_lengths().to_numpy()
            rows = s.flatten()
            at, cameras = pd.factorize(rows.field("camera").to_pandas())
            y = rows.field("y").flatten().to_numpy().reshape(-1, 6, 3)
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                of = np.flatnonzero(sizes == n)
                for part in np.array_split(of, -(-len(of) * n * n // 50000)):
                    k = first[part][:, None] + np.arange(n)
                    v = y[k] @ inverse[part][:, None]
                    c = -(v[:, :, None] @ y[k].transpose(0, 1, 3, 2)[:, None]).reshape(-1, 36)
                    pair = (at[k][:, :, None] * len(cameras) + at[k][:, None, :]).ravel()
                    order = np.argsort(pair, kind="stable")
                    keys, starts = np.unique(pair[order], return_index=True)
                    sums = np.add.reduceat(c[order], starts)
                    names = [pa.array(cameras.take(keys // len(cameras)), ids), pa.array(cameras.take(keys % len(cameras)), ids)]
                    yield pa.RecordBatch.from_arrays([*names, *[pa.array(x) for x in sums.T]], names=["camera", "other", *_C])

    return found


def _factor(d: pd.DataFrame) -> pd.DataFrame:
    """The inverse of the Cholesky factor of a group's system, its lower half as bytes: a turn by it and back is SPD however it is rounded."""
    place = np.unique(d["at"].to_numpy())
    n = len(place)
    a = np.zeros((n, n, 6, 6))
    a[np.searchsorted(place, d["at"]), np.searchsorted(place, d["to"])] = d[_C].to_numpy(float).reshape(-1, 6, 6)
    a = a.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n)
    size = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    a = (a + a.T) / 2 * size[:, None] * size
    for more in (0.0, 1e-10, 1e-6, 1e-2, 1e2):  # what nothing holds is held a little
        try:
            f = np.linalg.inv(np.linalg.cholesky(a + more * np.eye(6 * n))) * size
            break
        except np.linalg.LinAlgError:
            f = np.diag(size)
    return pd.DataFrame({"g": [d["g"].iloc[0]], "f": [f[np.tril_indices(6 * n)].astype("f4").tobytes()]})


def _near_solutions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in frames:
        for k, f, cameras, r in zip(d["k"], d["f"], d["cameras"], d["r"], strict=True):
            n = 6 * len(cameras)
            a = np.zeros((n, n))
            a[np.tril_indices(n)] = np.frombuffer(f, "f4")
            z = a.T @ (a @ np.concatenate(list(r)))
            yield pd.concat([pd.DataFrame({"k": k, "camera": cameras}), pd.DataFrame(z.reshape(-1, 6), columns=_Z6)], axis=1)


class Reduced:
    """The system over cameras, and the systems of groups of cameras that are near it.

    Landmarks of at most FEW rows are summed to blocks of pairs of cameras, so that a product reads a row for each pair of cameras that share some, however many
    landmarks these are. Landmarks of more rows make no pairs; a product takes their rows twice. Groups are of GROUP cameras in order of ids and OVER more on
    either side: where ids follow the way that was taken, they leave few iterations, and else they cost iterations but no result.
    """

    FEW, GROUP, OVER = 16, 32, 8

    def __init__(self, linear: DataFrame, blocks: DataFrame, diagonal: DataFrame, path: str):
        ids = linear.schema["camera"].dataType
        kind = ids.simpleString()
        numbers = lambda names: "".join(f", {n} double" for n in names)
        inverse = F.array(*[F.col(f"i{min(a, b)}{max(a, b)}") for a in range(3) for b in range(3)]).alias("i")
        y = [F.col(_A[0][c]) * F.col(_B[0][j]) + F.col(_A[1][c]) * F.col(_B[1][j]) for c in range(6) for j in range(3)]
        few = linear.select("camera", "point", F.array(*y).alias("y")).join(blocks.where(F.col("n") <= self.FEW).select("point", inverse), "point")
        lists = few.groupBy("point").agg(F.first("i").alias("i"), F.collect_list(F.struct("camera", "y")).alias("s"))
        # Landmarks of the same cameras come to the same task, which sums them up before they are shuffled.
        lists = written(lists, f"{path}/lists").withColumn("least", F.array_min(F.transform("s", lambda x: x["camera"])))
        pairs = lists.repartitionByRange("least", "point").sortWithinPartitions("least").select("i", "s").mapInArrow(_pairs(to_arrow_type(ids)), f"camera {kind}, other {kind}" + numbers(_C))
        own = diagonal.select("camera", F.col("camera").alias("other"), *[F.col(f"m{min(a, b)}{max(a, b)}").alias(f"c{a}{b}") for a in range(6) for b in range(6)])
        # Cameras that are fixed go.
        free = diagonal.select("camera")
        pairs = pairs.join(free, "camera", "left_semi").join(free.withColumnRenamed("camera", "other"), "other", "left_semi").select("camera", "other", *_C)
        self.pairs = written(own.unionByName(pairs).groupBy("camera", "other").agg(*[F.sum(n).alias(n) for n in _C]), f"{path}/pairs")
        place = placed(free, [], [F.col("camera")], "place", f"{path}/order")
        at = F.col("place") - F.col("g") * self.GROUP + self.OVER
        groups = F.sequence(F.ceil((F.col("place") - self.OVER - self.GROUP + 1) / self.GROUP), F.floor((F.col("place") + self.OVER) / self.GROUP))
        self.members = written(place.withColumn("g", F.explode(groups)).select("g", "camera", at.alias("at")), f"{path}/members")
        to = self.members.select("g", F.col("camera").alias("other"), F.col("at").alias("to"))
        local = self.pairs.join(self.members, "camera").join(to, ["g", "other"]).select("g", "at", "to", *_C)
        self.factors = written(local.groupBy("g").applyInPandas(_factor, "g long, f binary"), f"{path}/factors")
        self.many = None
        many = blocks.where(F.col("n") > self.FEW)
        if not many.isEmpty():
            rows = linear.join(many, "point").join(free, "camera", "left_semi")
            self.many = written(rows.select("camera", "point", *[f"i{a}{b}" for a in range(3) for b in range(a, 3)], *[v.alias(f"y{k // 3}{k % 3}") for k, v in enumerate(y)]), f"{path}/many")

    def times(self, state: DataFrame) -> DataFrame:
        """state (k, camera, x0, ... and what else sums by k and camera, a row each) with q0, ...: the system times x."""
        x = state.select("k", "camera", *_X)
        out = self.pairs.join(x.withColumnRenamed("camera", "other"), "other").select("k", "camera", *[_dot(_C[6 * a : 6 * a + 6], _X).alias(f"q{a}") for a in range(6)])
        if self.many is not None:
            z = self.many.join(x, "camera").groupBy("k", "point").agg(*[F.sum(_dot([f"y{a}{j}" for a in range(6)], _X)).alias(f"z{j}") for j in range(3)])
            v = [_dot([f"i{min(a, j)}{max(a, j)}" for j in range(3)], _Z) for a in range(3)]
            back = self.many.join(z, "point").select("k", "camera", *[f"y{a}{j}" for a in range(6) for j in range(3)], *[v[a].alias(f"v{a}") for a in range(3)])
            out = out.unionByName(back.select("k", "camera", *[(-_dot([f"y{a}{j}" for j in range(3)], ["v0", "v1", "v2"])).alias(f"q{a}") for a in range(6)]))
        return self._with(state, out)

    def near(self, state: DataFrame) -> DataFrame:
        """state (k, camera, r0, ... and what else sums by k and camera, a row each) with z0, ...: about what the system takes to r, the sum of the groups' own solutions."""
        r = state.join(self.members, "camera").groupBy("k", "g").agg(F.sort_array(F.collect_list(F.struct("at", "camera", F.array(*[f"r{a}" for a in range(6)]).alias("r")))).alias("s"))
        kind = state.schema["camera"].dataType.simpleString()
        z = r.select("k", "g", F.col("s.camera").alias("cameras"), F.col("s.r").alias("r")).join(self.factors, "g").mapInPandas(_near_solutions, f"k int, camera {kind}" + "".join(f", {n} double" for n in _Z6))
        return self._with(state, z)

    @staticmethod
    def _with(state: DataFrame, rows: DataFrame) -> DataFrame:
        both = state.unionByName(rows, allowMissingColumns=True)
        return both.groupBy("k", "camera").agg(*[F.sum(c).alias(c) for c in both.columns if c not in ("k", "camera")])


def conjugate_gradients(system: Reduced, right: DataFrame, path: str, near: float = 1e-3, rounds: int = 200) -> DataFrame:
    """(k, camera, x0, ...) that solve the reduced system for the right sides (k, camera, r0, ...), to `near` of their size each.

    A round is two written tables, with a sum for each right side that is taken as they are written; k are a few.
    """
    ks = [row["k"] for row in right.select("k").distinct().collect()]

    def kept(table: DataFrame, a: str, b: str, name: str) -> tuple[DataFrame, dict[int, float]]:
        seen = Observation()
        product = _dot([f"{a}{c}" for c in range(6)], [f"{b}{c}" for c in range(6)])
        table = written(table.observe(seen, *[F.sum(F.when(F.col("k") == k, product)).alias(f"k{k}") for k in ks]), f"{path}/{name}")
        return table, {k: seen.get[f"k{k}"] or 0.0 for k in ks}

    if not ks:
        return right.select("k", "camera", *[F.col(f"r{c}").alias(f"x{c}") for c in range(6)])
    of = lambda m: F.element_at(F.create_map(*[v for k, y in m.items() for v in (F.lit(k), F.lit(float(y)))]), F.col("k"))
    columns = lambda n: [f"{n}{c}" for c in range(6)]
    state, rz = kept(system.near(right.select("k", "camera", *columns("r"), *[F.lit(0.0).alias(n) for n in columns("s")])), "r", "z", "start")
    start = rz
    state = state.withColumnsRenamed(dict(zip(_Z6, _X, strict=True)))
    for i in range(rounds):
        state, xq = kept(system.times(state), "x", "q", f"times{i}")
        alpha = {k: rz[k] / xq[k] if xq[k] > 0 else 0.0 for k in ks}
        state = state.select("k", "camera", *[(F.col(f"s{c}") + of(alpha) * F.col(f"x{c}")).alias(f"s{c}") for c in range(6)], *[(F.col(f"r{c}") - of(alpha) * F.col(f"q{c}")).alias(f"r{c}") for c in range(6)], *_X)
        state, left = kept(system.near(state), "r", "z", f"step{i}")
        if all(left[k] <= near * near * start[k] or alpha[k] == 0.0 for k in ks):
            break
        beta = {k: left[k] / rz[k] if rz[k] > 0 else 0.0 for k in ks}
        state = state.select("k", "camera", *columns("s"), *columns("r"), *[(F.col(f"z{c}") + of(beta) * F.col(f"x{c}")).alias(f"x{c}") for c in range(6)])
        rz = left
    return state.select("k", "camera", *[F.col(f"s{c}").alias(f"x{c}") for c in range(6)])


class Scene:
    """Cameras (id, r, t, f, pp, fixed, prior, weight), landmarks (id, p) and observations (camera, point, u, v, sigma).

    prior is where a camera is known to stand, to within 1 / weight, or null. A camera or landmark without observations stays as it is, but for its prior.
    """

    def __init__(self, cameras: DataFrame, points: DataFrame, observations: DataFrame):
        self.path = shared_folder(cameras.sparkSession, "bundle")
        self.cameras = written(cameras.select("id", "r", "t", "f", "pp", F.coalesce("fixed", F.lit(False)).alias("fixed"), "prior", F.coalesce("weight", F.lit(0.0)).alias("weight")), f"{self.path}/cameras")
        self.points = written(points.select("id", "p"), f"{self.path}/points")
        self.observations = written(observations.select("camera", "point", "u", "v", "sigma"), f"{self.path}/observations")

    def _linear(self, at: str) -> tuple[DataFrame, float]:
        c, p = self.cameras.withColumnRenamed("id", "camera"), self.points.withColumnRenamed("id", "point")
        kinds = ", ".join(f"{k} {self.observations.schema[k].dataType.simpleString()}" for k in ("camera", "point"))
        linear = self.observations.join(c, "camera").join(p, "point").mapInPandas(_linear, kinds + "".join(f", {n} double" for n in _LINEAR))
        linear = written(linear, f"{self.path}/{at}/linear")
        cost = linear.agg(F.sum(F.col("r0") * F.col("r0") + F.col("r1") * F.col("r1"))).first()[0] or 0.0
        off = [F.col("t")[i] - F.col("prior")[i] for i in range(3)]
        held = self.cameras.where("prior is not null and not fixed").agg(F.sum(F.col("weight") * F.col("weight") * sum((o * o for o in off[1:]), off[0] * off[0]))).first()[0] or 0.0
        return linear, cost + held

    def _system(self, linear: DataFrame, damping: float, at: str) -> tuple[DataFrame, DataFrame]:
        """The landmarks' inverse blocks with slopes, and the cameras' own blocks and slopes."""
        h = linear.groupBy("point").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(_B[0][i]) * F.col(_B[0][j]) + F.col(_B[1][i]) * F.col(_B[1][j])).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)], *[F.sum(F.col(_B[0][j]) * F.col("r0") + F.col(_B[1][j]) * F.col("r1")).alias(f"g{j}") for j in range(3)])
        blocks = written(_inverted(h, damping), f"{self.path}/{at}/blocks")
        own = linear.groupBy(F.col("camera").alias("id")).agg(*[F.sum(F.col(_A[0][a]) * F.col(_A[0][b]) + F.col(_A[1][a]) * F.col(_A[1][b])).alias(f"d{a}{b}") for a in range(6) for b in range(a, 6)])
        w = [F.when(F.col("prior").isNotNull(), F.col("weight") * F.col("weight")).otherwise(0.0) if c > 2 else F.lit(0.0) for c in range(6)]
        pull = [w[c] * F.coalesce(F.col("t")[c - 3] - F.col("prior")[c - 3], F.lit(0.0)) if c > 2 else F.lit(0.0) for c in range(6)]
        d = lambda a, b: F.coalesce(F.col(f"d{a}{b}"), F.lit(0.0))
        free = self.cameras.where(~F.col("fixed")).join(own, "id", "left")
        # A direction that nothing holds gets 1 on the diagonal, and stays.
        held = [F.when(d(c, c) + w[c] > 0, (d(c, c) + w[c]) * (1 + damping)).otherwise(1.0) for c in range(6)]
        diagonal = free.select(F.col("id").alias("camera"), *[(held[a] if a == b else d(a, b)).alias(f"m{a}{b}") for a in range(6) for b in range(a, 6)], *[pull[c].alias(f"g{c}") for c in range(6)])
        return blocks, written(diagonal, f"{self.path}/{at}/diagonal")

    def _step(self, linear: DataFrame, damping: float, at: str, near: float) -> tuple[DataFrame, DataFrame]:
        """Moves of cameras (camera, x0, ...) and landmarks (point, z0, ...)."""
        blocks, diagonal = self._system(linear, damping, at)
        z = _by_landmark(blocks.select("point", *[F.col(f"g{j}").alias(f"y{j}") for j in range(3)]), blocks.drop("n", "g0", "g1", "g2"), [])
        left = [F.col(f"r{m}") - _dot(_B[m], _Z) for m in range(2)]
        right = linear.join(z, "point").groupBy("camera").agg(*[F.sum(F.col(_A[0][c]) * left[0] + F.col(_A[1][c]) * left[1]).alias(f"w{c}") for c in range(6)])
        right = diagonal.join(right, "camera", "left").select(F.lit(0).alias("k"), "camera", *[(-F.coalesce(F.col(f"w{c}"), F.lit(0.0)) - F.col(f"g{c}")).alias(f"r{c}") for c in range(6)])
        x = conjugate_gradients(Reduced(linear, blocks, diagonal, f"{self.path}/{at}"), right, f"{self.path}/{at}", near)
        moved = blocks.select("point", "g0", "g1", "g2").join(_pushed(linear, x), "point", "left").select("point", *[(F.col(f"g{j}") + F.coalesce(f"y{j}", F.lit(0.0))).alias(f"y{j}") for j in range(3)])
        return x, _by_landmark(moved, blocks.drop("n", "g0", "g1", "g2"), [], -1.0)

    def adjust(self, rounds: int = 12, damping: float = 1e-4, near: float = 1e-3, enough: float = 1e-12) -> list[float]:
        """Move cameras and landmarks so that the weighted squares of all residuals are least; gives the cost after each round (damped Gauss-Newton)."""
        linear, cost = self._linear("round0")
        costs = [cost]
        for i in range(1, rounds + 1):
            x, z = self._step(linear, damping, f"step{i}", near)
            before = self.cameras, self.points
            turned = R.vector_of_quaternion(R.times_quaternion(R.quaternion_of_vector(F.col("r")), R.quaternion_of_vector(F.array("x0", "x1", "x2"))))
            c = self.cameras.join(x.drop("k").withColumnRenamed("camera", "id"), "id", "left")
            moved = F.when(F.col("x0").isNotNull(), F.array(*[F.col("t")[k] + F.col(f"x{k + 3}") for k in range(3)])).otherwise(F.col("t"))
            self.cameras = written(c.select("id", F.when(F.col("x0").isNotNull(), turned).otherwise(F.col("r")).alias("r"), moved.alias("t"), "f", "pp", "fixed", "prior", "weight"), f"{self.path}/step{i}/cameras")
            p = self.points.join(z.withColumnRenamed("point", "id"), "id", "left")
            self.points = written(p.select("id", F.when(F.col("z0").isNotNull(), F.array(*[F.col("p")[k] + F.col(_Z[k]) for k in range(3)])).otherwise(F.col("p")).alias("p")), f"{self.path}/step{i}/points")
            now, better = self._linear(f"round{i}")
            if better <= cost:
                done = cost - better <= enough * max(1.0, cost)
                linear, cost, damping = now, better, damping / 10
                costs.append(cost)
                if done:
                    break
            else:
                self.cameras, self.points = before
                damping *= 10
        return costs

    def covariance(self, cameras: list[int], near: float = 1e-8) -> DataFrame:
        """(camera, k, x0, ..., x5): rows of the covariance blocks (turn, place) of a few chosen cameras, by solving for their unit vectors."""
        linear, _ = self._linear("covariance")
        blocks, diagonal = self._system(linear, 0.0, "covariance")
        units = diagonal.select("camera").crossJoin(F.broadcast(linear.sparkSession.createDataFrame([(n * 6 + k, c, k) for n, c in enumerate(cameras) for k in range(6)], "k int, own long, at int")))
        right = units.select("k", "camera", *[F.when((F.col("camera") == F.col("own")) & (F.col("at") == c), 1.0).otherwise(0.0).alias(f"r{c}") for c in range(6)])
        x = conjugate_gradients(Reduced(linear, blocks, diagonal, f"{self.path}/covariance"), right, f"{self.path}/covariance", near)
        chosen = F.element_at(F.create_map(*[v for n, c in enumerate(cameras) for v in (F.lit(n), F.lit(c))]), F.floor(F.col("k") / 6).cast("int"))
        return x.where(F.col("camera") == chosen).select("camera", (F.col("k") % 6).alias("k"), *_X)
