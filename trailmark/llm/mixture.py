"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all rates r (copies per document, 0 to 2) that meet
sum(r * size) = target, take the one nearest to 1 in entropy, sum(r log r - r). The dual is convex
with one multiplier per source and gives exponentially tilted rates r = min(2, exp(l * size / scale)).
Newton's iterations solve it on a table of (source, size, documents), which documents are
counted into first; an iteration is one grouped aggregate over that table, kept within a bracket. Rates are then rounded
to 0, 1 or 2 copies: within a source, from the largest size to the smallest, each size's copies make up for what was
rounded before, so a source ends within one small document of its target.

Defined cases: null and empty texts have size 0, take nothing and never matter; a null source is a source of its
own, last in order; a source of size 0 has target 0; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rounds import joined, placed
from .shared import documents, fresh, save, work_dir

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of one source and size that one task ranks at most; larger cells are split by hash.
CELL = 512


def word_count(text: Column) -> Column:
    """Number of [^ \\t-\\r]+ in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): share of all sizes by weight, none above most times its size.

    The excess reshared by weight until none is above is the level t with sum(min(most * size, t * weight)) = total:
    in order of most * size / weight, the first ones stop at their size and the others share the rest. One row for a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", cycle[((F.row_number().over(order) - 1) % len(weights)).cast("int")])
    ranked = ranked.withColumn("top", F.col("source_size") * float(most)).withColumn("level", F.col("top") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    ranked = (
        ranked.withColumn("stopped", F.coalesce(F.sum("top").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(all_) * float(share))
        .withColumn("t", (F.col("total") - F.col("stopped")) / F.col("open"))
    )
    # The level of the first source, in that order, which the rest doesn't fill up.
    level = F.min(F.when(F.col("t") <= F.col("level"), F.struct("level", "t"))).over(all_)["t"]
    return ranked.withColumn("target", F.least(F.col("top"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def solve_rates(cells: DataFrame, targets: DataFrame, path: str, rounds: int = 40, near: float = 1e-6) -> DataFrame:
    """Multiplier l of each source (source, target, scale, l), by Newton's method on the dual.

    cells: source, size, n. The dual's gradient is sum(n * size * min(2, exp(l * size / scale))) - target, which rises with l.
    """
    scale = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = targets.alias("t").join(scale.alias("s"), null_safe(targets, scale)).select("t.source", "t.source_size", "t.target", "s.scale")
    state = save(t.select("*", F.lit(0.0).alias("l"), F.lit(-200.0).alias("low"), F.lit(200.0).alias("high"), F.lit(1.0).alias("off")), f"{path}/rates0")
    for i in range(rounds):
        c = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).where("c.size > 0")
        x = F.col("c.size") / F.col("s.scale")
        rate = F.exp(F.least(F.col("s.l") * x, F.lit(1.0)))
        open_ = rate < MOST
        sums = c.groupBy("s.source").agg(
            F.sum(F.col("c.n") * F.col("c.size") * F.least(rate, F.lit(float(MOST)))).alias("got"),
            F.sum(F.when(open_, F.col("c.n") * F.col("c.size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        step = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.got", "g.slope")
        gap = F.col("got") - F.col("target")
        step = step.withColumn("low", F.when(gap < 0, F.col("l")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("l")).otherwise(F.col("high")))
        newton = F.col("l") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        full = F.col("target") >= F.col("source_size") * float(MOST)
        moved = F.when(gap == 0, F.col("l")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        off = F.when(full, 0.0).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
        state = save(step.select("source", "source_size", "target", "scale", F.when(full, F.lit(1e9)).when(off <= near, F.col("l")).otherwise(moved).alias("l"), "low", "high", off.alias("off")), f"{path}/rates{i + 1}")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= near:
            break
    return state.select("source", "source_size", "target", F.col("scale"), "l")


def _allocate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of one source: from large sizes to small, carrying the words that rounding leaves. A row for each size that occurs."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    copies, carry = [], 0.0
    for size, n, rate in zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(), strict=True):
        wish = n * size * rate + carry
        m = int(min(MOST * n, max(0, round(wish / size))))
        carry = wish - m * size
        copies.append(m)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "copies": copies})


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to 2) of each document."""
    path = work_dir(docs.sparkSession, "mixture")
    spread = F.xxhash64(F.col("doc_id"), F.lit("mixture"))
    rows = save(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), f"{path}/sizes")
    cells = save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), f"{path}/cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = save(source_targets(sizes), f"{path}/targets")
    rates = solve_rates(cells, targets, path)

    c, r = cells.where("size > 0").alias("c"), rates.alias("r")
    rate = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("r.l") * F.col("c.size") / F.col("r.scale"), F.lit(1.0))))
    given = save(c.join(r, F.col("c.source").eqNullSafe(F.col("r.source"))).select("c.*", rate.alias("rate")).groupBy("source").applyInPandas(_allocate, "source string, size long, n long, copies long"), f"{path}/copies")

    # Large cells are split by hash, so that no task ranks more than about CELL documents of one source and size; each part has its
    # share of the copies beyond the whole ones.
    g = given.select(F.col("source").alias("gs"), F.col("size").alias("gz"), F.col("n").alias("cell_n"), "copies")
    met = rows.where("size > 0").join(g, F.col("source").eqNullSafe(F.col("gs")) & (F.col("size") == F.col("gz"))).drop("gs", "gz")
    met = save(met.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.ceil(F.col("cell_n") / CELL))), f"{path}/met")
    parts = met.where(F.col("cell_n") > CELL).groupBy("source", "size", "sub").agg(F.count(F.lit(1)).alias("m"), F.first("cell_n").alias("cell_n"), F.first("copies").alias("copies"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("sub"))
    left = F.col("copies") % F.col("cell_n")
    share = F.floor(left * F.col("upto") / F.col("cell_n")) - F.floor(left * (F.col("upto") - F.col("m")) / F.col("cell_n"))
    parts = parts.withColumn("upto", upto).select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("sub").alias("pu"), share.alias("extra"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy(spread, "doc_id"))
    ranked = met.withColumn("rank", rank).join(parts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("sub") == F.col("pu")), "left")
    each = F.floor(F.col("copies") / F.col("cell_n")) + (F.col("rank") <= F.coalesce("extra", left)).cast("long")
    out = ranked.select("doc_id", "source", "size", each.alias("copies")).unionByName(rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies")))
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("ts"))).select("doc_id", "source", "size", "source_size", "target", "copies")


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, with the columns of docs.

    Rows of one doc_id, source and size are alike to the mix, so the plan says for these how many are taken twice and once, in two numbers. Where there are
    several such rows, their place by hash of their text decides which; places are dealt by ranges, so very many rows of one id are many tasks' work.
    """
    size, source, n, once, twice, place, h, row, least = fresh(docs, "size", "source_", "n", "once", "twice", "place", "h", "row", "least")
    keys = ["doc_id", source, size]
    is_ = lambda k: F.sum((F.col("copies") == k).cast("long"))
    plan = mix_sources(docs).withColumnsRenamed({"source": source, "size": size}).groupBy(*keys).agg(F.count(F.lit(1)).alias(n), is_(1).alias(once), is_(2).alias(twice)).where(F.col(once) + F.col(twice) > 0)
    rows = docs.withColumn(source, F.col("source").cast("string")).withColumn(size, word_count(F.col("text")))
    met = joined(rows, plan, keys)
    alone = met.where(F.col(n) == 1).withColumn(place, F.lit(0).cast("long"))
    several = met.where(F.col(n) > 1).withColumn(h, F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id())
    several = placed(several, keys, [F.col(h), F.col(row)], place, work_dir(docs.sparkSession, "mixture_rows")).drop(h, row)
    every = alone.unionByName(several).withColumn(n, F.when(F.col(place) < F.col(twice), 2).when(F.col(place) < F.col(twice) + F.col(once), 1).otherwise(0)).where(F.col(n) > 0)
    return every.withColumn(least, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
