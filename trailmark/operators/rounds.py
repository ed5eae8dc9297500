"""What iterations share: a folder for written rounds, and places in an order without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Without that setting a temporary folder serves on one machine; on a cluster it's an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and no folder of one machine would do")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet, read back: a short plan that outlives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until none of the given ones is the same."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def dealt(rows: DataFrame, *by: Column | str) -> DataFrame:
    """rows shuffled by these columns, for an aggregate by them that leaves about as many rows: else each task of a scan would first hold a table of nearly all it reads."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def placed(rows: DataFrame, by: list[str], order: list[Column], name: str, path: str) -> DataFrame:
    """rows with their place, from 0, among the rows of equal `by` in this order.

    Rows are dealt by ranges of (by, order), ranked within a range, and start after what earlier ranges have of their group, so a group of very many rows is many
    tasks' work. Rows that are equal in all of `by` and `order` are one range.
    """
    part, at, before, n = unused(rows.columns, "part", "at", "before", "n")
    dealt = rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id())
    dealt = written(dealt.withColumn(at, F.row_number().over(Window.partitionBy(part, *by).orderBy(*order))), path)
    sizes = dealt.groupBy(*by, part).agg(F.count(F.lit(1)).alias(n))  # a row for each group and range
    starts = sizes.select(*by, part, F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return joined(dealt, starts, [*by, part]).withColumn(name, F.col(before) + F.col(at) - 1).drop(part, at, before)


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", wide: bool = False, where: Column | None = None) -> DataFrame:
    """An equi-join in which nulls of `by` are equal; columns of `by` come from the left.

    wide: there are about as many keys as rows, so that the right side is shuffled by them and never sent whole through the driver, however small its files look.
    where: what rows of equal keys must fulfil to match, in columns of either side that no other has.
    """
    other = unused([*left.columns, *right.columns], *[f"{b}_r" for b in by])
    right = right.select(*[F.col(b).alias(o) for b, o in zip(by, other, strict=True)], *[c for c in right.columns if c not in by])
    on = F.lit(True) if where is None else where
    for b, o in zip(by, other, strict=True):
        on = on & left[b].eqNullSafe(right[o])
    return left.join(right.hint("merge") if wide else right, on, how).drop(*other)


def kth_least(rows: DataFrame, by: list[str], value: str, place: Column, path: str, bins: int = 4096) -> DataFrame:
    """(by, value): in each group the value at `place` (from 0, in terms of the column n of the group's rows) in ascending order; nulls don't count.

    Two passes count values by bins between the group's limits, first over all, then within the bin that has the place; only the
    distinct values of that fine bin are ranked. A group costs `bins` rows, whatever its size.
    """
    r = written(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m")), f"{path}/values")
    g = r.groupBy(*by).agg(F.sum("m").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    g = g.select(*by, place.cast("long").alias("k"), "low", "high")
    for i in range(2):
        b = F.least(F.floor((F.col("v") - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / bins, F.lit(5e-324))), F.lit(bins - 1)).cast("long")
        binned = written(joined(r, g, by).where("v >= low and v <= high").withColumn("b", b).drop("k", "low", "high"), f"{path}/binned{i}")
        counts = binned.groupBy(*by, "b").agg(F.sum("m").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy("b"))
        met = joined(counts.withColumn("upto", upto), g.select(*by, "k"), by).where("upto > k and upto - c <= k")
        g = written(met.select(*by, (F.col("k") - F.col("upto") + F.col("c")).alias("k"), "low", "high", "b"), f"{path}/bin{i}").drop("b")
    left = joined(r, g, by).where("v >= low and v <= high").withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("v")))
    return left.where("upto > k and upto - m <= k").select(*by, F.col("v").alias(value))
