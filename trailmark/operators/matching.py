"""Feature matching between image pairs, in four stages: corners, matches, refinement, inliers.

Corners are rows (id, scale, x, y, score, vec) of an image of a pair `by`: level 0 is full resolution, level n has 1 / 2^n of it, and x and y are in its pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assignment
from .corners import top_corners
from .nearest import close_costs, least_costs, projected_cells
from .robust import by_neighbours, robust
from .rounds import joined, kth_least, placed, shared_folder, written


def absolute_cost(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mutual_best(least: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """(by, i, j, cost): pairs among the least costs of their row and of their column (see `least_costs`); beyond the first, only while the cost is at most ratio times the best."""
    own = F.when(F.col("of") == 0, F.col("i")).otherwise(F.col("j"))
    near = least.withColumn("best", F.min("cost").over(Window.partitionBy(*by, "of", own))).where((F.col("rank") == 1) | (F.col("cost") <= ratio * F.col("best")))
    return joined(near.where("of = 0").select(*by, "i", "j", "cost"), near.where("of = 1").select(*by, "i", "j"), [*by, "i", "j"], "left_semi", wide=True)


def upper_median_of_minima(least: DataFrame, by: list[str], factor: float = 1.5) -> DataFrame:
    """(by, threshold): factor times the upper median of the rows' least costs."""
    minima = least.where("of = 0 and rank = 1").select(*by, "cost")
    found = kth_least(minima, by, "cost", F.floor(F.col("n") / 2), shared_folder(least.sparkSession, "median"))
    return found.select(*by, (F.col("cost") * factor).alias("threshold"))


def candidate_costs(left: DataFrame, right: DataFrame, by: list[str], n: int, dim: int, width: float, tables: int = 8, projections: int = 4) -> DataFrame:
    """`least_costs` among rows that share a cell of projected features; what it misses, `recall` tells."""
    cells = [projected_cells(x, dim, width, tables, projections) for x in (left, right)]
    return least_costs(*cells, by, n, cells=["cell"])


def recall(exact: DataFrame, found: DataFrame, by: list[str]) -> float:
    """Share of the exact best pairs of left rows that are also found."""
    want = exact.where("of = 0 and rank = 1").select(*by, "i", "j")
    n, hit = joined(want, found.where("of = 0 and rank = 1").select(*by, "i", "j", F.lit(1).alias("hit")), [*by, "i", "j"], "left", wide=True).agg(F.count(F.lit(1)), F.count("hit")).first()
    return hit / n if n else 1.0


def assigned(least: DataFrame, by: list[str], best: int = 3, **how) -> DataFrame:
    """(by, i, j, cost): least-cost assignment of rows to one of their `best` least costs, where leaving a row alone costs the threshold of its group."""
    pairs = least.where((F.col("of") == 0) & (F.col("rank") <= best)).select(*by, "i", "j", "cost")
    return assignment(joined(pairs, upper_median_of_minima(least, by), by), by, "threshold", best, **how)


def detected(corners: DataFrame, by: list[str], n: int, radius: float) -> DataFrame:
    """The n strongest corners of each image and level, no two within the radius of that level's pixels, placed in full resolution."""
    top = top_corners(corners, [*by, "scale"], n, radius)
    size = F.pow(F.lit(2.0), F.col("scale"))
    return top.withColumn("x", F.col("x") * size).withColumn("y", F.col("y") * size).drop("rank")


def matched(one: DataFrame, two: DataFrame, by: list[str], scales: Iterable[tuple[int, int]], matcher: Callable[[DataFrame, list[str]], DataFrame], n: int = 3, digits: int | None = None, width: float | None = None, dim: int = 0, ratio: float | None = None) -> DataFrame:
    """(by, match_id, scale1, scale2, i, j, cost, x1, y1, x2, y2): matches of each distinct pair of levels, numbered from the least cost on.

    matcher takes least costs and their keys. With a width only pairs that share a cell of projected features are candidates. A ratio says that the matcher
    needs no costs over so many times a row's least one (see `close_costs`).
    """
    pairs = one.sparkSession.createDataFrame(sorted(set(scales)), "scale1 int, scale2 int")
    keys = [*by, "scale1", "scale2"]
    side = lambda c, k: c.withColumn(f"scale{k}", F.col("scale").cast("int")).join(F.broadcast(pairs), f"scale{k}").select(*keys, "id", "vec")
    left, right = side(one, 1), side(two, 2)
    if width:
        least = candidate_costs(left, right, keys, n, dim, width)
    else:
        least = least_costs(left, right, keys, n, digits) if ratio is None else close_costs(left, right, keys, n, ratio, digits)
    path = shared_folder(one.sparkSession, "matched")
    found = matcher(written(least, f"{path}/least"), keys)
    at = lambda c, k, i: c.select(*by, F.col("scale").cast("int").alias(f"scale{k}"), F.col("id").alias(i), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    found = joined(joined(found, at(one, 1, "i"), [*by, "scale1", "i"], wide=True), at(two, 2, "j"), [*by, "scale2", "j"], wide=True)
    order = [F.col(c) for c in ("cost", "scale1", "scale2", "i", "j")]
    return placed(found, by, order, "match_id", f"{path}/placed").select(*by, "match_id", "scale1", "scale2", "i", "j", "cost", "x1", "y1", "x2", "y2")


def match_images(
    one: DataFrame, two: DataFrame, by: list[str], scales: Iterable[tuple[int, int]] = ((0, 0),), n_corners: int = 1000, radius: float = 10.0, matcher: Callable[[DataFrame, list[str]], DataFrame] | None = None,
    refine: Callable[[DataFrame], DataFrame] | None = None, model: str = "perspective", threshold: float = 10.0, rounds: int = 200, sub_threshold: float | None = 5.0, seed: int = 0, **how,
) -> DataFrame:
    """The four stages in a row: matches as `matched` gives them, with `inlier`.

    matcher: by default pairs that are among each other's three best, within 1.1 times the best cost; refine: moves matched positions, if given.
    The second pass, by neighbours, is for perspective models only; without a sub_threshold there is none.
    """
    least = lambda costs, keys: mutual_best(costs, keys, 1.1)
    path = shared_folder(one.sparkSession, "pipeline")
    one, two = (written(detected(c, by, n_corners, radius), f"{path}/corners{k}") for k, c in ((1, one), (2, two)))
    found = matched(one, two, by, scales, matcher or least, **({} if matcher else {"ratio": 1.1}) | how)
    found = written(refine(found) if refine else found, f"{path}/matches")
    told = written(robust(found, by, model, threshold, rounds, seed, [F.col("match_id")]), f"{path}/told")
    if model != "perspective" or sub_threshold is None:
        return told
    few = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n < 4").select(*by)
    kept = joined(told.where("inlier"), few, by, "left_anti")
    held = by_neighbours(kept, by, sub_threshold).select(*by, "match_id").unionAll(joined(told, few, by, "left_semi").select(*by, "match_id"))
    return joined(told, held.withColumn("held", F.lit(True)), [*by, "match_id"], "left", wide=True).withColumn("inlier", F.col("inlier") & F.coalesce("held", F.lit(False))).drop("held")


def matched_corners(corners: DataFrame, matches: DataFrame, by: list[str], side: str) -> DataFrame:
    """The corners of one side (i or j) that matches keep."""
    return joined(matches.select(*by, F.col(side).alias("id")).distinct(), corners, [*by, "id"], wide=True)


def as_correspondences(matches: DataFrame) -> DataFrame:
    """Text pairs of matches given as (v, u) rows and columns."""
    side = lambda k: F.format_string("UV %d %.2f %.2f", F.col(f"image{k}"), F.col(f"u{k}").cast("double"), F.col(f"v{k}").cast("double"))
    return matches.select("match_id", F.concat_ws(", ", side(1), side(2)).alias("value"))
