"""Absolute poses from relative ones: a maximum spanning forest of image pairs, and the poses along it.

Edges are numbered once by strength, so that a round carries whole numbers only. The forest grows in rounds: every tree picks its strongest edge to another tree, ties to the lesser pair, and
trees that picks join become one; poses are composed for what is picked. A tree knows each node's pose in its root; where trees join, roots become nodes of a tree of trees, whose poses are composed by pointer doubling: each looks up the pose of the one it points
to, and points to where that one points. So a long chain takes a number of steps that grows with its logarithm, in rounds as well as within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotations as R
from .rounds import placed, shared_folder, written


# Between input and output a pose is STRUCT<w, x, y, z, a, b, c>, a unit quaternion and a translation, so that composing is plain arithmetic.
_TURN = (
    ("1 - 2 * ({p}.y * {p}.y + {p}.z * {p}.z)", "2 * ({p}.x * {p}.y - {p}.w * {p}.z)", "2 * ({p}.x * {p}.z + {p}.w * {p}.y)"),
    ("2 * ({p}.x * {p}.y + {p}.w * {p}.z)", "1 - 2 * ({p}.x * {p}.x + {p}.z * {p}.z)", "2 * ({p}.y * {p}.z - {p}.w * {p}.x)"),
    ("2 * ({p}.x * {p}.z - {p}.w * {p}.y)", "2 * ({p}.y * {p}.z + {p}.w * {p}.x)", "1 - 2 * ({p}.x * {p}.x + {p}.y * {p}.y)"),
)
_IDENTITY = "named_struct('w', 1D, 'x', 0D, 'y', 0D, 'z', 0D, 'a', 0D, 'b', 0D, 'c', 0D)"


def _turned(p: str, q: str, back: bool = False) -> list[str]:
    """q's translation turned as p turns, or back."""
    return [" + ".join(f"({(_TURN[j][i] if back else _TURN[i][j]).format(p=p)}) * {q}.{k}" for j, k in enumerate("abc")) for i in range(3)]


def _composed(p: str, q: str) -> Column:
    """The pose p after the pose q."""
    t = [f"{x} + {p}.{k}" for x, k in zip(_turned(p, q), "abc", strict=True)]
    return F.expr(
        f"named_struct('w', {p}.w * {q}.w - {p}.x * {q}.x - {p}.y * {q}.y - {p}.z * {q}.z, 'x', {p}.w * {q}.x + {p}.x * {q}.w + {p}.y * {q}.z - {p}.z * {q}.y,"
        f"'y', {p}.w * {q}.y - {p}.x * {q}.z + {p}.y * {q}.w + {p}.z * {q}.x, 'z', {p}.w * {q}.z + {p}.x * {q}.y - {p}.y * {q}.x + {p}.z * {q}.w, 'a', {t[0]}, 'b', {t[1]}, 'c', {t[2]})"
    )


def _inverse(p: str) -> Column:
    t = _turned(p, p, back=True)
    return F.expr(f"named_struct('w', {p}.w, 'x', -{p}.x, 'y', -{p}.y, 'z', -{p}.z, 'a', -({t[0]}), 'b', -({t[1]}), 'c', -({t[2]}))")


def _followed(pointers: DataFrame, path: str) -> DataFrame:
    """(tree, root, pose): where pointers (tree, up, pose of tree in up) end; a tree that points to itself is an end."""
    at, i = written(pointers, f"{path}/pointers0"), 0
    while True:
        nxt = at.select(F.col("tree").alias("up"), F.col("up").alias("further"), F.col("pose").alias("above"))
        moved = at.join(nxt.hint("merge"), "up").select("tree", F.col("further").alias("up"), F.when(F.col("up") == F.col("further"), F.col("pose")).otherwise(_composed("above", "pose")).alias("pose"), (F.col("up") != F.col("further")).alias("moved"))
        moved, i = written(moved, f"{path}/pointers{i + 1}"), i + 1
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at.withColumnRenamed("up", "root")


def spanning_poses(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root, pose) of each node, its pose in its tree's root, and the edges (a, b, weight) of a maximum spanning forest.

    nodes: id; edges: a, b, weight, pose, the pose of b in a (what takes b's coordinates to a's), of different nodes. Several edges of a pair are
    possible, the strongest counts, then the first by direction. The root of a tree is its least id. Edges without a weight or of unknown nodes are left out; a node without
    edges is its own root.
    """
    path = shared_folder(nodes.sparkSession, "forest")
    still = written(nodes.select("id").distinct().select("id", F.col("id").alias("root"), F.expr(_IDENTITY).alias("pose")), f"{path}/nodes0")
    known = edges.where("a <> b and weight is not null and not isnan(weight) and pose is not null").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").cast("double").alias("weight"), "pose")
    for k in "uv":
        known = known.join(nodes.select(F.col("id").alias(k)).hint("merge"), k, "left_semi")
    known = known.withColumn("q", R.quaternion_of_vector(F.col("pose.r"))).withColumn("t", F.col("pose.t"))
    known = known.select("u", "v", "weight", F.struct(*[F.col("q")[i].alias(k) for i, k in enumerate("wxyz")], *[F.col("t")[i].cast("double").alias(k) for i, k in enumerate("abc")]).alias("pose"))
    order = [F.col("weight"), -F.least("u", "v"), -F.greatest("u", "v"), -F.col("u"), F.col("pose")]
    known = written(placed(known, [], order, "strength", f"{path}/placed"), f"{path}/edges0")
    left = known.select("strength", "u", "v", F.col("u").alias("root_u"), F.col("v").alias("root_v"))
    picked, i = None, 0
    while True:
        between = written(left.where("root_u <> root_v"), f"{path}/between{i}")
        if between.isEmpty():
            break
        best = between.select("strength", F.explode(F.array("root_u", "root_v")).alias("tree")).groupBy("tree").agg(F.max("strength").alias("strength"))
        # An edge that one tree picks hangs it to the other one. Where two trees pick each other, the lesser one is the end.
        hung = best.groupBy("strength").agg(F.max("tree").alias("tree")).join(between.hint("merge"), "strength").join(known.select("strength", "weight", "pose").hint("merge"), "strength")
        of = lambda k: still.select(F.col("id").alias(k), F.col("pose").alias(f"pose_{k}")).hint("merge")
        hung = hung.join(of("u"), "u").withColumn("out", _composed("pose_u", "pose")).join(of("v"), "v")
        of_v = F.col("tree") == F.col("root_v")
        hung = hung.withColumn("above", F.when(of_v, F.col("out")).otherwise(F.col("pose_v"))).withColumn("own", F.when(of_v, F.col("pose_v")).otherwise(F.col("out"))).withColumn("back", _inverse("own"))
        hung = written(hung.select("tree", F.when(of_v, F.col("root_u")).otherwise(F.col("root_v")).alias("up"), _composed("above", "back").alias("pose"), "u", "v", "weight"), f"{path}/hung{i}")
        edge = hung.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight")
        picked = edge if picked is None else picked.unionAll(edge)
        ends = hung.select(F.col("up").alias("tree")).distinct().join(hung.select("tree").hint("merge"), "tree", "left_anti")
        pointers = hung.select("tree", "up", "pose").unionAll(ends.select("tree", F.col("tree").alias("up"), F.expr(_IDENTITY).alias("pose")))
        roots = _followed(pointers, f"{path}/round{i}").withColumnsRenamed({"root": "end", "pose": "above"})
        moved = still.join(roots.withColumnRenamed("tree", "root"), "root", "left")
        still = written(moved.select("id", F.coalesce("end", "root").alias("root"), F.when(F.coalesce("end", "root") == F.col("root"), F.col("pose")).otherwise(_composed("above", "pose")).alias("pose")), f"{path}/nodes{i + 1}")
        left = between
        for k in "uv":
            left = left.join(roots.select(F.col("tree").alias(f"root_{k}"), F.col("end").alias(f"end_{k}")), f"root_{k}")
        left = left.select("strength", "u", "v", F.col("end_u").alias("root_u"), F.col("end_v").alias("root_v"))
        i += 1
    # All poses in the least node of the tree.
    first = still.groupBy("root").agg(F.min("id").alias("id")).join(still.select("id", "pose").hint("merge"), "id")
    first = written(first.select("root", F.col("id").alias("first"), _inverse("pose").alias("back")), f"{path}/first")
    out = nodes.select("id").join(still.join(first, "root").hint("merge"), "id")  # a row for each row of nodes, where these repeat an id
    out = out.select("id", F.col("first").alias("root"), F.when(F.col("id") == F.col("first"), F.expr(_IDENTITY)).otherwise(_composed("back", "pose")).alias("p"))
    r = R.vector_of_quaternion(F.array(*[F.col("p")[k] for k in "wxyz"]))
    out = written(out.select("id", "root", F.struct(r.alias("r"), F.array(*[F.col("p")[k] for k in "abc"]).alias("t")).alias("pose")), f"{path}/out")
    return out, (picked if picked is not None else known.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight"))
