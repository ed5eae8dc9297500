"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseq import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """To so many digits, without a negative zero."""
    return F.round(c, digits) + 0.0


def sql_rounded(c: str, digits: int = 6) -> str:
    return f"(round({c}, {digits}) + 0.0::DOUBLE)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", epoch_seconds(F.col("ts")).alias("t"), "value", "props")


EV = "ev AS (SELECT user_id, event_id, event_type, epoch_us(ts)::DOUBLE / 1e6 AS t, value, props FROM events)"
SPAN = "st AS (SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM ev GROUP BY 1)"


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep
