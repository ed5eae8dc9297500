"""A catalog of records: objects (id, class, ord, name, parent, fixed, enabled, step), references as edges, and joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import dealt


def by_name(objects: DataFrame, names: DataFrame) -> DataFrame:
    """The first object of each name (name, optional hint): classes in order of name, then order of insertion."""
    hint = F.col("hint") if "hint" in names.columns else F.lit(None).cast("string")
    met = objects.join(names.withColumn("_hint", hint).select("name", "_hint"), "name").where(F.col("_hint").isNull() | (F.col("class") == F.col("_hint")))
    w = Window.partitionBy("name", "_hint").orderBy("class", "ord", "id")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_hint")


def next_id(objects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest unused id from 0 on, for each group. Without groups, ids are counted in cells first, so no task orders them all."""
    by = by or []
    cell = F.floor(F.col("id") / 65536)
    cells = objects.where("id >= 0").groupBy(*by, cell.alias("cell")).agg(F.countDistinct("id").alias("n"))
    # The first cell that isn't full, or the one after the last.
    w = Window.partitionBy(*by).orderBy("cell")
    ranked = cells.withColumn("place", F.row_number().over(w) - 1)
    full = ranked.where((F.col("n") == 65536) & (F.col("cell") == F.col("place")))
    groups = objects.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    first = full.groupBy(*by).agg((F.max("cell") + 1).alias("first"))
    first = (groups.join(first, by, "left") if by else groups.crossJoin(first)).select(*by, F.coalesce("first", F.lit(0).cast("long")).alias("first"))
    met = objects.withColumn("cell", cell).select(*by, "id", "cell").distinct()
    inside = met.join(first, [*by] if by else None, "inner") if by else met.crossJoin(F.broadcast(first))
    inside = inside.where("cell = first")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1 + F.col("first") * 65536
    gap = inside.withColumn("place", place).where("id = place").groupBy(*by).agg((F.max("id") + 1).alias("upto"))
    out = first.join(gap, by, "left") if by else first.crossJoin(gap)
    return out.select(*by, F.coalesce("upto", F.col("first") * 65536).alias("next_id"))


def create(objects: DataFrame, kind: str, classes: dict[str, str]) -> DataFrame:
    """objects with one more record of a class, named by the class's label and its id; an unknown class changes nothing."""
    if kind not in classes:
        return objects
    new = next_id(objects).select(F.col("next_id").alias("id"), F.lit(kind).alias("class"), F.concat(F.lit(classes[kind] + " "), F.col("next_id").cast("string")).alias("name"))
    return objects.unionByName(new, allowMissingColumns=True)


def counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def children(objects: DataFrame, parent: Column, kind: str | None = None) -> DataFrame:
    found = objects.where(F.col("parent") == parent)
    return found.where(F.col("class") == kind) if kind else found


def referers(edges: DataFrame) -> DataFrame:
    """Back references of (id, refers_to)."""
    return edges.select(F.col("refers_to").alias("id"), F.col("id").alias("referred_by")).distinct()


def remove(objects: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects and edges without these ids and what refers to or from them."""
    gone = ids.select("id")
    kept = objects.join(gone, "id", "left_anti")
    return kept, edges.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "refers_to"), "refers_to", "left_anti")


def has_solution(objects: DataFrame, column: str = "optimized") -> DataFrame:
    return objects.agg(F.coalesce(F.bool_or(F.col(column).isNotNull()), F.lit(False)).alias("has_solution"))


def clear_optimized(objects: DataFrame, columns: list[str], step_from: int = 2) -> DataFrame:
    """Optimised values to null; steps from step_from on fall back to 1 (initialised)."""
    return objects.withColumns({c: F.lit(None).cast(objects.schema[c].dataType) for c in columns}).withColumn("step", F.when(F.col("step") >= step_from, 1).otherwise(F.col("step")))


def effective(optimized: Column, raw: Column, default) -> Column:
    return F.coalesce(optimized, raw, F.lit(default))


def unordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs, whichever side is first."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def ordered_tuples(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples; missing members count as -1."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in columns]).distinct()


def insert_observations(have: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """have and those of new whose key isn't there yet, one of each key."""
    fresh = new.join(have.select(*by), by, "left_anti").dropDuplicates(by)
    return have.unionByName(fresh, allowMissingColumns=True)


def referred_counts(rows: DataFrame, owner: str, item: str, excluded: DataFrame | None = None) -> DataFrame:
    """Distinct items of each owner, without the excluded ones."""
    kept = rows.join(excluded.select(item), item, "left_anti") if excluded is not None else rows
    return dealt(kept.select(owner, item), owner, item).distinct().groupBy(owner).agg(F.count(item).alias("n"))


def pick(observations: DataFrame, clicks: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """For each click (cx, cy): the observation nearest by the larger axis distance, under the tolerance; the earliest of equals.

    Both are dealt to square cells of the tolerance's size, an observation to its cell and the eight around it, so the join is on equal cells. Observations
    at one place are met as the earliest of them, clicks at one place as one, so those that pile up make no pairs.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    o = observations.groupBy(*by, "x", "y").agg(F.min("obs_id").alias("obs_id")).withColumn("_i", F.explode(F.transform(around, lambda d: cell("x") + d))).withColumn("_j", F.explode(F.transform(around, lambda d: cell("y") + d)))
    q = clicks.select(*by, "cx", "cy").distinct().withColumn("_i", cell("cx")).withColumn("_j", cell("cy"))
    d = F.greatest(F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy")))
    met = q.join(o, [*by, "_i", "_j"]).withColumn("d", d).where(F.col("d") < tolerance)
    best = met.groupBy(*by, "cx", "cy").agg(F.min(F.struct("d", "obs_id")).alias("m"))
    return clicks.join(best, [*by, "cx", "cy"]).groupBy(*by, "click_id").agg(F.min("m").alias("m")).select(*by, "click_id", F.col("m.obs_id").alias("obs_id"), F.col("m.d").alias("d"))


def pair_partners(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of pairs (pair_id, a, b) for each image (id) that is either side, with the other one."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("s"))
    return images.join(sides.select("pair_id", "s.id", "s.other"), "id").select("id", "pair_id", "other")


def observation_times(observations: DataFrame, observers: DataFrame, by: list[str]) -> DataFrame:
    """by, observer_id and t of the observations that have a time, by observers of that list: when a trajectory is seen, a row for each time."""
    return observations.where("t is not null").join(observers.select("observer_id").distinct(), "observer_id", "left_semi").select(*by, "observer_id", "t")
