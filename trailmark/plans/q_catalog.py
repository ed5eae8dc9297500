"""Catalog joins and constraint graphs: orders stand in for images, parts for landmarks, line items for observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import graphs as gr
from ..sources import exchange as ex
from .common import Registry, rounded, sql_rounded, table

_R = Registry()
r, sr = rounded, sql_rounded


def _observations(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("landmark_id"), F.col("l_quantity").alias("u"), F.col("l_discount").alias("v"), "l_linenumber")


def _landmarks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def _images(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Image "), F.col("o_orderkey").cast("string")).alias("name"))


@_R.add("catalog_observation_table", "SELECT 'Image ' || o_orderkey AS \"Image\", p_name AS \"Landmark\", l_quantity AS u, l_discount AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber < 7")
def catalog_observation_table(spark, d):
    return ex.observation_table(_observations(spark, d), _landmarks(spark, d), _images(spark, d))


@_R.add("catalog_optional_references", "SELECT coalesce(n_name, 'none') AS name, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END GROUP BY 1")
def catalog_optional_references(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("n_nationkey"))
    return c.join(F.broadcast(table(spark, d, "nation")), "n_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@_R.add("catalog_images_of_landmarks", "SELECT o_orderkey AS id, 'Image ' || o_orderkey AS name FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 7)")
def catalog_images_of_landmarks(spark, d):
    seen = _observations(spark, d).where("landmark_id is not null").select(F.col("image_id").alias("id"))
    return _images(spark, d).join(seen, "id", "left_semi")


@_R.add("catalog_referred_counts", "SELECT l_partkey AS landmark_id, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_linenumber < 7 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def catalog_referred_counts(spark, d):
    out = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    return cat.referred_counts(_observations(spark, d).where("landmark_id is not null"), "landmark_id", "image_id", out)


@_R.add("catalog_common_points", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def catalog_common_points(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).intersect(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey"))


@_R.add("catalog_referred_items", "SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS id FROM lineitem")
def catalog_referred_items(spark, d):
    return table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("id")).distinct()


def _objects(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("Image").alias("class"), F.col("c_custkey").alias("ord"), F.concat(F.lit("name"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.col("c_nationkey").cast("long").alias("parent"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("Camera").alias("class"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("name"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.col("s_nationkey").cast("long").alias("parent"))
    return c.unionByName(s)


OBJ = "ob AS (SELECT c_custkey AS id, 'Image' AS class, c_custkey AS ord, 'name' || (c_custkey % 50) AS name, c_nationkey::BIGINT AS parent FROM customer UNION ALL SELECT s_suppkey + 1000000, 'Camera', s_suppkey, 'name' || (s_suppkey % 60), s_nationkey::BIGINT FROM supplier)"


@_R.add("catalog_by_name", f"WITH {OBJ} SELECT name, id, class, ord, parent FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY class, ord, id) AS k FROM ob) WHERE k = 1")
def catalog_by_name(spark, d):
    o = _objects(spark, d)
    return cat.by_name(o, o.select("name").distinct()).select("name", "id", "class", "ord", "parent")


@_R.add("catalog_counts", f"WITH {OBJ} SELECT class, count(*) AS n FROM ob GROUP BY 1")
def catalog_counts(spark, d):
    return cat.counts(_objects(spark, d))


@_R.add("catalog_children", f"WITH {OBJ} SELECT id, class, name FROM ob WHERE parent = 3 AND class = 'Image'")
def catalog_children(spark, d):
    return cat.children(_objects(spark, d), F.lit(3), "Image").select("id", "class", "name")


@_R.add("catalog_next_id", "WITH x AS (SELECT DISTINCT c_nationkey AS g, c_custkey // 25 AS id FROM customer), k AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS p FROM x) SELECT g, coalesce(max(id) FILTER (id = p) + 1, 0)::BIGINT AS next_id FROM k GROUP BY 1")
def catalog_next_id(spark, d):
    o = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.floor(F.col("c_custkey") / 25).alias("id"))
    return cat.next_id(o, ["g"])


@_R.add("catalog_created", f"WITH {OBJ}, f AS (SELECT min(g) AS g FROM range(2000000) r(g) WHERE g NOT IN (SELECT id FROM ob)) SELECT id, class, name FROM ob UNION ALL SELECT g, 'Camera', 'Camera ' || g FROM f")
def catalog_created(spark, d):
    return cat.create(_objects(spark, d), "Camera", {"Camera": "Camera", "Image": "Image"}).select("id", "class", "name")


@_R.add("catalog_unordered_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def catalog_unordered_pairs(spark, d):
    return cat.unordered_pairs(table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b")


@_R.add("catalog_ordered_triplets", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b, coalesce(CASE WHEN l_linenumber <> 3 THEN l_linenumber END, -1)::INT AS c FROM lineitem")
def catalog_ordered_triplets(spark, d):
    return cat.ordered_tuples(table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("c")), ["a", "b", "c"])


@_R.add("catalog_clear_optimized", "SELECT o_orderkey AS id, NULL::DOUBLE AS optimized, CASE WHEN o_orderkey % 4 >= 2 THEN 1 ELSE o_orderkey % 4 END::INT AS step FROM orders")
def catalog_clear_optimized(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("optimized"), (F.col("o_orderkey") % 4).cast("int").alias("step"))
    return cat.clear_optimized(o, ["optimized"])


@_R.add("catalog_has_solution", "SELECT bool_or(c_acctbal > 9000) AS has_solution FROM customer")
def catalog_has_solution(spark, d):
    return cat.has_solution(table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).alias("optimized")))


@_R.add("catalog_referers", "SELECT DISTINCT o_custkey AS id, o_orderkey AS referred_by FROM orders")
def catalog_referers(spark, d):
    return cat.referers(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("refers_to")))


@_R.add("catalog_removed", f"WITH {OBJ} SELECT class, count(*) AS n FROM ob WHERE id NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def catalog_removed(spark, d):
    o = _objects(spark, d)
    kept, _ = cat.remove(o, o.select("id", F.col("parent").alias("refers_to")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))
    return cat.counts(kept)


@_R.add("catalog_inserted_observations", "SELECT count(*) AS n, count(DISTINCT (l, p)) AS keys FROM (SELECT l_orderkey AS l, l_partkey AS p FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 1)")
def catalog_inserted_observations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("l"), F.col("l_partkey").alias("p"), "l_linenumber")
    out = cat.insert_observations(li.where("l_linenumber = 1").dropDuplicates(["l", "p"]), li.where("l_linenumber > 1"), ["l", "p"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l", "p").alias("keys"))


@_R.add(
    "catalog_pick",
    """WITH o AS (SELECT p_partkey AS obs_id, p_size % 3 AS g, (p_partkey % 101) * 1.0::DOUBLE AS x, (p_size * 2.0)::DOUBLE AS y FROM part), c AS (SELECT s_suppkey AS click_id, s_suppkey % 3 AS g, (s_suppkey % 97) * 1.0 + 0.25::DOUBLE AS cx, (s_suppkey % 89) * 1.0 + 0.5::DOUBLE AS cy FROM supplier),
    m AS (SELECT c.g, click_id, obs_id, greatest(abs(x - cx), abs(y - cy)) AS d FROM c JOIN o ON o.g = c.g)
    SELECT g, click_id, obs_id, d FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY d, obs_id) AS k FROM m WHERE d < 4) WHERE k = 1""",
)
def catalog_pick(spark, d):
    o = table(spark, d, "part").select(F.col("p_partkey").alias("obs_id"), (F.col("p_size") % 3).cast("long").alias("g"), (F.col("p_partkey") % 101 * 1.0).alias("x"), (F.col("p_size") * 2.0).alias("y"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("click_id"), (F.col("s_suppkey") % 3).alias("g"), (F.col("s_suppkey") % 97 + 0.25).alias("cx"), (F.col("s_suppkey") % 89 + 0.5).alias("cy"))
    return cat.pick(o, c, ["g"], 4.0)


@_R.add("catalog_pair_partners", "SELECT o_custkey AS id, o_orderkey AS pair_id, o_orderkey % 100 AS other FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey % 100, o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_orderkey % 100")
def catalog_pair_partners(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"))
    return cat.pair_partners(p, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


# ---- constraint graph --------------------------------------------------------------------------

_EDGES = "e0 AS (SELECT o_custkey AS id1, l_partkey + 10000000 AS id2, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
_NODES = "n0 AS (SELECT c_custkey AS id, 24 AS dof FROM customer UNION ALL SELECT p_partkey + 10000000, 20 FROM part)"


def _peel_sql(rounds: int = 25) -> str:
    parts = [_EDGES, _NODES]
    for i in range(rounds):
        parts.append(f"c{i} AS MATERIALIZED (SELECT n.id, n.dof, coalesce(sum(x.n), 0)::BIGINT AS n_obs FROM n{i} n LEFT JOIN (SELECT id1 AS id, n FROM e{i} UNION ALL SELECT id2, n FROM e{i}) x ON x.id = n.id GROUP BY ALL)")
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT id, dof FROM c{i} WHERE n_obs >= dof)")
        parts.append(f"e{i + 1} AS MATERIALIZED (SELECT id1, id2, n FROM e{i} WHERE id1 IN (SELECT id FROM n{i + 1}) AND id2 IN (SELECT id FROM n{i + 1}))")
    return f"WITH {', '.join(parts)} SELECT id, n_obs FROM c{rounds - 1} WHERE n_obs >= dof"


@_R.add("graph_constrained", _peel_sql())
def graph_constrained(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    obs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("id1"), (F.col("l_partkey") + 10000000).alias("id2"), F.lit(1).alias("n"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(24).alias("dof")).unionByName(table(spark, d, "part").select((F.col("p_partkey") + 10000000).alias("id"), F.lit(20).alias("dof")))
    return gr.constrained(nodes, gr.build_edges(obs, nodes)).select("id", F.col("n_obs").cast("long").alias("n_obs"))


@_R.add("graph_edges", "SELECT least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY ALL")
def graph_edges(spark, d):
    obs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"), F.col("l_linenumber").alias("n"))
    return gr.build_edges(obs, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


@_R.add(
    "graph_weights",
    "WITH p AS (SELECT l_orderkey AS id1, l_partkey AS id2, l_linenumber AS k FROM lineitem) SELECT k, count(*) AS rows, sum(CASE k WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 END)::BIGINT AS n FROM p WHERE k <= 3 GROUP BY 1",
)
def graph_weights(spark, d):
    k = F.col("l_linenumber")
    kinds = F.when(k == 1, F.array(F.lit("XYZ"), F.lit("XYZ"))).when(k == 2, F.array(F.lit("UV"), F.lit("XYZ"))).when(k == 3, F.array(F.lit("GEOXYZ"), F.lit("UV"))).otherwise(F.array(F.lit("LINE3D"), F.lit("XYZ")))
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id1"), F.col("l_partkey").alias("id2"), "l_linenumber", kinds[0].alias("kind1"), kinds[1].alias("kind2"))
    w = gr.weights(p.withColumn("id2", F.col("id2") * 10 + k).withColumn("id1", F.col("id1") * 10 + k), gr.rules(spark))
    return w.groupBy((F.coalesce("id2", "id1") % 10).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))


def _bipartite_sql(rounds: int = 25) -> str:
    parts = [
        "e0 AS (SELECT DISTINCT o_custkey AS i, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 11 <> 0)",
        "i0 AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END AS prior FROM customer WHERE c_custkey % 11 <> 0)",
        "p0 AS (SELECT p_partkey AS id FROM part)",
    ]
    for k in range(rounds):
        parts.append(f"i{k + 1} AS MATERIALIZED (SELECT id, any_value(prior) AS prior FROM i{k} LEFT JOIN e{k} ON i = id GROUP BY id HAVING count(i) + any_value(prior) >= 6)")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT id FROM p{k} LEFT JOIN e{k} ON p = id GROUP BY id HAVING count(p) >= 5)")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT i, p FROM e{k} WHERE i IN (SELECT id FROM i{k + 1}) AND p IN (SELECT id FROM p{k + 1}))")
    return f"WITH {', '.join(parts)} SELECT 'i' AS kind, id FROM i{rounds} UNION ALL SELECT 'p', id FROM p{rounds}"


@_R.add("graph_bipartite", _bipartite_sql())
def graph_bipartite(spark, d):
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 11 != 0).alias("enabled"), F.when(F.col("c_custkey") % 7 == 0, 3).otherwise(0).alias("prior"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("enabled"), F.lit(0).alias("prior"))
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    obs = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("image"), F.col("l_partkey").alias("point"))
    return gr.bipartite(i, p, obs, 6, 5)


@_R.add("catalog_observation_times", "SELECT l_orderkey AS trajectory_id, l_suppkey AS observer_id, l_quantity::DOUBLE AS t FROM lineitem WHERE l_linenumber < 5 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def catalog_observation_times(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trajectory_id"), F.col("l_suppkey").alias("observer_id"), F.when(F.col("l_linenumber") < 5, F.col("l_quantity").cast("double")).alias("t"))
    observers = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("observer_id"))
    return cat.observation_times(o, observers, ["trajectory_id"])


QUERIES, ORACLES = _R.queries, _R.oracles
