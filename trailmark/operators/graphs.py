"""Constraint graphs: nodes with degrees of freedom, observations on and between them, and the peel of what isn't held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import dealt, shared_folder
from .rounds import written as _written

#: Observations on a pair of kinds, and whether they are on the one node (self) or between two. UV and UVT with XYZ count twice.
RULES = [
    ("PRIOR", "XYZ", "self", 3),
    ("GEOXYZ", "PRIORID", "self", 3),
    ("GEOXYZ", "XYZ", "self", 3),
    ("XYZ", "XYZ", "edge", 3),
    ("PRIORID", "XYZ", "edge", 3),
    ("XYZ", "XYZT", "edge", 3),
    ("XYZT", "XYZT", "edge", 3),
    ("UV", "UV", "edge", 2),
    ("UV", "UVT", "edge", 2),
    ("UVT", "UVT", "edge", 2),
    ("UV", "XYZ", "edge", 4),
    ("UVT", "XYZ", "edge", 4),
    ("GEOXYZ", "UV", "self", 2),
    ("GEOXYZ", "UVT", "self", 2),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind1 string, kind2 string, applies string, n int")


def weights(pairs: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Observations of pairs (id1, kind1, id2, kind2), kinds in alphabetical order: (id1, id2, n), id2 null for a self observation.

    The rule table has under twenty rows.
    """
    met = pairs.join(F.broadcast(rule_table), ["kind1", "kind2"])
    own = F.when(F.col("kind1").isin("PRIOR", "GEOXYZ"), F.col("id2")).otherwise(F.col("id1"))
    return met.select(F.when(F.col("applies") == "self", own).otherwise(F.col("id1")).alias("id1"), F.when(F.col("applies") == "edge", F.col("id2")).alias("id2"), "n")


def build_edges(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id1, id2, n) summed over both directions; without self loops and unknown nodes."""
    ways = observations.where("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "n")
    edges = dealt(ways, "id1", "id2").groupBy("id1", "id2").agg(F.sum("n").alias("n"))
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "id1"), "id1", "left_semi").join(known.withColumnRenamed("id", "id2"), "id2", "left_semi").select("id1", "id2", "n")


def constrained(nodes: DataFrame, edges: DataFrame, self_observations: DataFrame | None = None) -> DataFrame:
    """Nodes (id, dof) left after removing, again and again, those with fewer observations than degrees of freedom.

    Observations are counted once. Then each round drops the nodes that fall short and takes what they shared off their neighbours' counts; edges are written
    once and only read after that, nodes are written each round, so plans stay short and a lost executor loses nothing. The result doesn't depend on the
    order. Edges of unknown nodes don't count.
    """
    path = shared_folder(nodes.sparkSession, "peel")
    known = nodes.select("id").distinct()
    side = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.col("n").alias("n"))
    ways = edges.select(F.explode(F.array(side("id1", "id2"), side("id2", "id1"))).alias("e")).select("e.*")
    ways = _written(ways.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "other"), "other", "left_semi").select("id", "other", "n"), f"{path}/edges")
    seen = ways.groupBy("id").agg(F.sum("n").alias("n"))
    seen = seen if self_observations is None else seen.unionAll(self_observations.groupBy("id").agg(F.sum("n").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    left, i = _written(nodes.select("id", "dof").join(seen, "id", "left").select("id", "dof", F.coalesce("n", F.lit(0)).cast("long").alias("n_obs")), f"{path}/nodes0"), 0
    while True:
        gone = left.where("n_obs < dof").select(F.col("id").alias("other"))
        if gone.isEmpty():
            return left
        less = ways.join(gone, "other").groupBy("id").agg(F.sum("n").alias("less"))
        left, i = _written(left.where("n_obs >= dof").join(less, "id", "left").select("id", "dof", (F.col("n_obs") - F.coalesce("less", F.lit(0))).alias("n_obs")), f"{path}/nodes{i + 1}"), i + 1


def bipartite(images: DataFrame, points: DataFrame, observations: DataFrame, least_image: int, least_point: int) -> DataFrame:
    """Images and points (kind, id) that keep enough observations of each other; enabled ones only, a prior (0, 1 or 3) adds to a point's or image's count."""
    nodes = images.where("enabled").select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.lit(least_image).alias("dof"), "prior")
    nodes = nodes.unionByName(points.where("enabled").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit(least_point).alias("dof"), "prior"))
    met = dealt(observations.select("image", "point"), "image", "point").distinct()
    edges = met.select(F.concat(F.lit("i"), F.col("image").cast("string")).alias("id1"), F.concat(F.lit("p"), F.col("point").cast("string")).alias("id2"), F.lit(1).alias("n"))
    kept = constrained(nodes, build_edges(edges, nodes), nodes.select("id", F.col("prior").alias("n")))
    return kept.select(F.substring("id", 1, 1).alias("kind"), F.expr("cast(substring(id, 2) as bigint)").alias("id"))
