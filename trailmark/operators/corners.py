"""Corners of images: suppression of all but the strongest within a radius, and the strongest ones of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import joined, shared_folder, unused, written

#: A cell's diagonal is the radius, so corners of one cell suppress each other, and others within reach lie at most two cells away. Cells meet in tiles of so many cells' width.
REACH, TILE = 2, 4


def suppressed(corners: DataFrame, by: list[str], radius: float) -> DataFrame:
    """The corners (id, x, y, score) of each image that no stronger survivor has within the radius; of equal scores the lesser id is the stronger.

    What a pass over corners from the strongest to the weakest would keep, found in rounds: a corner that is the strongest undecided one of its cell and of all
    cells around survives, then undecided ones within its radius go. A cell sends its strongest corner only, and holds one survivor at
    most, so crowded cells cost few pairs; it is sent to the tiles that its surroundings touch. The number of rounds is that of the longest row of corners that each wait for a stronger neighbour.
    Corners without a position or score are dropped; a radius of 0 drops only repeats of a place.
    """
    path = shared_folder(corners.sparkSession, "suppressed")
    cx, cy, rank, top, tx, ty, wx, wy, ux, uy = unused(corners.columns, "cx", "cy", "rank", "top", "tx", "ty", "wx", "wy", "ux", "uy")
    side = radius / 2**0.5
    cell = (lambda c: F.floor(F.col(c) / side).cast("long")) if side > 0 else (lambda c: F.xxhash64(c))
    first = F.struct(F.col("score").cast("double").alias("score"), (-F.col("id")).alias("id"))
    left = corners.where("id is not null and x is not null and y is not null and score is not null and not isnan(x) and not isnan(y) and not isnan(score)")
    start = written(left.withColumn(cx, cell("x")).withColumn(cy, cell("y")).withColumn(rank, first), f"{path}/start")
    left = start.select(*by, cx, cy, rank, "x", "y")
    reach, tile = (REACH, TILE) if side > 0 else (0, 1)

    def home(df: DataFrame) -> DataFrame:
        return df.withColumn(tx, F.floor(F.col(cx) / tile)).withColumn(ty, F.floor(F.col(cy) / tile))

    def around(df: DataFrame, *columns: Column) -> DataFrame:
        """df in every tile that has cells around its own."""
        touched = [F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)) if reach else F.array(F.floor(F.col(c) / tile)) for c in (cx, cy)]
        return df.withColumn(tx, F.explode(touched[0])).withColumn(ty, F.explode(touched[1])).select(*by, tx, ty, *columns)

    kept, i = None, 0
    while not left.isEmpty():
        best = left.groupBy(*by, cx, cy).agg(F.max(F.struct(rank, "x", "y")).alias("best"))
        best = written(best.select(*by, cx, cy, F.col(f"best.{rank}").alias(rank), F.col("best.x").alias("x"), F.col("best.y").alias("y")), f"{path}/best{i}")
        others = around(best, F.col(cx).alias(ux), F.col(cy).alias(uy), F.col(rank).alias(top))
        stronger = (F.abs(F.col(cx) - F.col(ux)) <= reach) & (F.abs(F.col(cy) - F.col(uy)) <= reach) & (F.col(top) > F.col(rank))
        won = written(joined(home(best), others, [*by, tx, ty], "left_anti", wide=True, where=stronger).select(*best.columns), f"{path}/won{i}")
        kept = won if kept is None else kept.unionAll(won)
        apart = (F.col("x") - F.col(wx)) * (F.col("x") - F.col(wx)) + (F.col("y") - F.col(wy)) * (F.col("y") - F.col(wy))
        near = around(won, F.col("x").alias(wx), F.col("y").alias(wy))
        left = written(joined(home(left), near, [*by, tx, ty], "left_anti", wide=True, where=apart <= radius * radius).select(*left.columns), f"{path}/left{i + 1}")
        i += 1
    if kept is None:
        return corners.limit(0)
    return joined(start, kept.select(*by, cx, cy, F.col(rank).alias(top)), [*by, cx, cy], wide=True).where(F.col(rank) == F.col(top)).select(*corners.columns)


def top_corners(corners: DataFrame, by: list[str], n: int, radius: float) -> DataFrame:
    """The n strongest of the suppressed corners of each image, with their rank from 1."""
    order: list[Column] = [F.desc("score"), F.col("id")]
    return suppressed(corners, by, radius).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
