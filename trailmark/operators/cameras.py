"""Tables of what cameras see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import pushbroom_direction
from ..functions.vectors import vector


def view_table(cameras: DataFrame, by: list[str], optimized: bool = False) -> DataFrame:
    """by, u and direction of each pixel of line cameras (width, f, pp, a, b and, for optimized, the same with a leading opt_).

    Columns are doubles, a and b arrays of six. A width that isn't whole counts as the next one; without a width there are no pixels. What
    isn't known: f is the width, pp half of it, coefficients are 0. An optimized value that isn't known is the plain one.
    """
    known = lambda c: F.coalesce(F.col(f"opt_{c}"), F.col(c)) if optimized else F.col(c)
    n = F.ceil("width").cast("double")
    zeros = vector(0, 0, 0, 0, 0, 0)
    values = lambda c: F.transform(F.coalesce(known(c), zeros), lambda x: F.coalesce(x, F.lit(0.0)))
    filled = cameras.where(F.ceil("width") > 0).select(*by, n.alias("width"), F.coalesce(known("f"), n).alias("f"), F.coalesce(known("pp"), n / 2).alias("pp"), values("a").alias("a"), values("b").alias("b"))
    pixels = filled.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    direction = pushbroom_direction(F.col("u").cast("double"), F.lit(0.0), F.col("f"), F.array("pp"), F.col("a"), F.col("b"), F.col("width"))
    return pixels.select(*by, "u", direction.alias("direction"))
