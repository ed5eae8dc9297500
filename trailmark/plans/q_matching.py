"""Matching of image pairs. Image pairs, corners and features are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment as asg
from ..operators import matching as mt
from ..operators.corners import suppressed
from ..operators.nearest import least_costs, nearest_in_plane
from ..operators.robust import robust
from .common import Registry, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded

_COST = """l AS (SELECT label, vec_id AS i, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 2 = 0), rr AS (SELECT label, vec_id AS j, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 2 = 1),
    ct AS (SELECT label, i, j, round(list_sum(list_transform(range(1, len(a) + 1), lambda k: abs(a[k] - b[k]))), 6) AS cost FROM l JOIN rr USING (label))"""


def _least(spark, d, n=3):
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return least_costs(e.where("id % 2 = 0"), e.where("id % 2 = 1"), ["label"], n, 6)


@_R.add(
    "matching_mutual_best",
    f"""WITH {_COST}, a AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY cost, j) AS ri, min(cost) OVER (PARTITION BY label, i) AS bi, row_number() OVER (PARTITION BY label, j ORDER BY cost, i) AS rj, min(cost) OVER (PARTITION BY label, j) AS bj FROM ct)
    SELECT label, i, j, cost FROM a WHERE (ri = 1 OR (ri <= 3 AND cost <= 1.1 * bi)) AND (rj = 1 OR (rj <= 3 AND cost <= 1.1 * bj))""",
)
def matching_mutual_best(spark, d):
    return mt.mutual_best(_least(spark, d), ["label"], 1.1)


@_R.add("matching_threshold", f"WITH {_COST}, m AS (SELECT label, i, min(cost) AS m FROM ct GROUP BY ALL), s AS (SELECT label, list_sort(list(m)) AS ms FROM m GROUP BY 1) SELECT label, {sr('ms[len(ms) // 2 + 1] * 1.5')} AS threshold FROM s")
def matching_threshold(spark, d):
    return mt.upper_median_of_minima(_least(spark, d, 1), ["label"]).select("label", r(F.col("threshold")).alias("threshold"))


@_R.add("matching_assignment")
def matching_assignment(spark, d):
    return mt.assigned(_least(spark, d), ["label"])


@_R.add(
    "matching_small_assignment",
    """WITH RECURSIVE c AS (SELECT s_suppkey // 4 AS g, s_suppkey % 4 AS i, j, round(abs(s_acctbal / 1000 - (j * 7 + s_suppkey * (j + 3)) % 11), 6) AS cost FROM supplier, unnest(range(4)) AS u(j)),
    w AS (SELECT DISTINCT g, 0 AS i, []::STRUCT(i BIGINT, j BIGINT, cost DOUBLE)[] AS m, 0.0::DOUBLE AS total FROM c
        UNION ALL SELECT w.g, w.i + 1, CASE WHEN o.j IS NULL THEN w.m ELSE list_append(w.m, struct_pack(i := o.i::BIGINT, j := o.j::BIGINT, cost := o.cost::DOUBLE)) END, w.total + coalesce(o.cost, 2.5)
        FROM w JOIN (SELECT g, i, j, cost FROM c UNION ALL SELECT DISTINCT g, n, NULL::BIGINT, NULL::DOUBLE FROM c, unnest(range(4)) AS v(n)) o ON o.g = w.g AND o.i = w.i AND w.i < 4 AND (o.j IS NULL OR NOT list_contains(list_transform(w.m, lambda x: x.j), o.j)))
    SELECT g, round(min(total), 4) AS total FROM (SELECT g, total + 0 AS total FROM w WHERE i = 4) GROUP BY g""",
)
def matching_small_assignment(spark, d):
    """Groups so small that SQL can try all matchings: what the least-cost one costs, rows without a match included."""
    s, j = table(spark, d, "supplier"), F.explode(F.sequence(F.lit(0), F.lit(3)))
    c = s.select(F.floor(F.col("s_suppkey") / 4).alias("g"), (F.col("s_suppkey") % 4).cast("long").alias("i"), "s_acctbal", "s_suppkey", j.alias("j"))
    c = c.select("g", "i", F.col("j").cast("long").alias("j"), F.round(F.abs(F.col("s_acctbal") / 1000 - (F.col("j") * 7 + F.col("s_suppkey") * (F.col("j") + 3)) % 11), 6).alias("cost"))
    found = asg.assignment(c, ["g"], 2.5).groupBy("g").agg(F.sum(2.5 - F.col("cost")).alias("saved"))
    return c.select("g").distinct().join(found, "g", "left").select("g", F.round(10.0 - F.coalesce("saved", F.lit(0.0)), 4).alias("total"))


def _wrong(c):
    return F.when(c % 10 == 3, 50.0).otherwise(0.0)


@_R.add("matching_robust_perspective", "SELECT p_partkey % 4 AS pair, p_partkey AS match_id, p_partkey % 10 <> 3 AS inlier FROM part")
def matching_robust_perspective(spark, d):
    x, y = (F.col("p_partkey") % 97).cast("double"), (F.col("p_partkey") * 31 % 89).cast("double")
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("pair"), F.col("p_partkey").alias("match_id"), x.alias("x1"), y.alias("y1"))
    w = 1 + F.col("x1") * 1e-3
    p = p.withColumn("x2", (F.col("x1") * 1.1 + 3) / w + _wrong(F.col("match_id"))).withColumn("y2", (F.col("y1") * 0.9 - 2) / w + _wrong(F.col("match_id")))
    return robust(p, ["pair"], "perspective", 1.0, rounds=60).select("pair", "match_id", "inlier")


@_R.add("matching_robust_epipolar", "SELECT p_partkey % 4 AS pair, p_partkey AS match_id, p_partkey % 10 <> 3 AS inlier FROM part")
def matching_robust_epipolar(spark, d):
    """Views beside each other of points at various depths: rows agree, but for the wrong matches."""
    k = F.col("p_partkey")
    x, y = (k % 97).cast("double"), (k * 31 % 89).cast("double")
    p = table(spark, d, "part").select((k % 4).alias("pair"), k.alias("match_id"), x.alias("x1"), y.alias("y1"), (x + 5 + k * 17 % 23).alias("x2"), (y + _wrong(k)).alias("y2"))
    return robust(p, ["pair"], "epipolar", 1.0, rounds=60).select("pair", "match_id", "inlier")


_SPOTS = "pt AS (SELECT p_partkey % 8 AS image, p_partkey AS id, (p_partkey * 37 % 1009) / 4.0::DOUBLE AS x, (p_partkey * 91 % 997) / 4.0::DOUBLE AS y, p_retailprice AS score FROM part)"


def _spots(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 8).alias("image"), k.alias("id"), (k * 37 % 1009 / 4.0).alias("x"), (k * 91 % 997 / 4.0).alias("y"), F.col("p_retailprice").alias("score"))


@_R.add(
    "matching_corners",
    f"""WITH RECURSIVE {_SPOTS}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS n FROM pt),
    w AS (SELECT DISTINCT image, 0::BIGINT AS n, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM o
        UNION ALL SELECT w.image, o.n, CASE WHEN len(list_filter(w.kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) <= 576.0)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(id := o.id::BIGINT, x := o.x, y := o.y)) END FROM w JOIN o ON o.image = w.image AND o.n = w.n + 1)
    SELECT image, unnest(kept).id AS id FROM (SELECT image, max_by(kept, n) AS kept FROM w GROUP BY 1)""",
)
def matching_corners(spark, d):
    return suppressed(_spots(spark, d), ["image"], 24.0).select("image", "id")


@_R.add(
    "matching_nearest",
    f"""WITH {_SPOTS}, c AS (SELECT a.image, a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON a.image = b.image AND a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY d2, other) AS rank FROM c) SELECT image, id, other, d2, rank::INT AS rank FROM n WHERE rank <= 7""",
)
def matching_nearest(spark, d):
    return nearest_in_plane(_spots(spark, d), ["image"], 7)


def _views(spark, d):
    """Corners of two images of four pairs: a grid with decoys beside it, every fifth corner on level 1; a tenth has moved in the second image."""
    k = F.floor(F.col("p_partkey") / 4).cast("long")
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("pair"), F.col("p_partkey").alias("id"), k.alias("k"))
    p = p.withColumn("scale", F.when(F.col("k") % 5 == 4, 1).otherwise(0)).withColumn("px", F.col("k") % 40 * 25.0 + F.col("k") * 7 % 5).withColumn("py", F.floor(F.col("k") / 40) * 25.0 + F.col("k") * 3 % 5)
    spread = lambda shift: F.array(*[(F.col("id") * a % q / float(q) + shift).alias("v") for a, q in ((7919, 1009), (104729, 1013), (1299709, 1019), (15485863, 1021), (32452843, 1031), (49979687, 1033), (67867967, 1039), (86028121, 1049))])
    size = F.pow(F.lit(2.0), F.col("scale"))
    w = 1 + F.col("px") * 1e-5
    moved = F.when(F.col("k") % 10 == 3, 60.0 + F.col("k") % 7).otherwise(0.0)
    corner = lambda x, y, shift: p.select("pair", "id", "scale", (x / size).alias("x"), (y / size).alias("y"), (1.0 + F.col("k") % 50).alias("score"), spread(shift).alias("vec"))
    decoys = lambda c: c.unionAll(c.where("id % 7 = 0").select("pair", F.col("id") + 100_000_000, "scale", F.col("x") + 2, F.col("y") + 1, F.col("score") / 100, "vec"))
    return decoys(corner(F.col("px"), F.col("py"), 0.0)), decoys(corner((F.col("px") * 1.1 + 30) / w + moved, (F.col("py") * 1.2 + 20) / w + moved, F.col("id") % 3 * 0.001))


@_R.add("matching_pipeline", "SELECT p_partkey % 4 AS pair, p_partkey AS i, p_partkey AS j, p_partkey // 4 % 10 <> 3 AS inlier FROM part")
def matching_pipeline(spark, d):
    """Corners, matches, inliers and the second pass in a row; SQL has the planted truth."""
    one, two = _views(spark, d)
    return mt.match_images(one, two, ["pair"], [(0, 0), (1, 1), (0, 0)], n_corners=1_000_000, radius=5.0, rounds=60).select("pair", "i", "j", "inlier")


QUERIES, ORACLES = _R.queries, _R.oracles
