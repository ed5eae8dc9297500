"""Time sequences: samples (series, t, value) and questions about times between them.

A sequence holds its first value before its start and its last one after its end. Every lookup is a union of samples and
probes under one window, so a series is shuffled once and nothing is joined by range. Where one series may hold much of the data, `bucket` splits
its time axis: the last and first sample of the other buckets are carried in by a small table, and no task needs a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import joined, placed, shared_folder


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long")
    micros = (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return micros / F.lit(1e6)


def stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Start, end, number of samples and mean step (1 for a single one) of each series."""
    s = samples.groupBy(*by).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count(F.lit(1)).alias("n"))
    step = (F.col("t_end") - F.col("t_start")) / (F.col("n") - 1)
    return s.withColumn("step", F.when((F.col("n") <= 1) | (F.col("t_end") <= F.col("t_start")), 1.0).otherwise(step))


def regular_grid(samples: DataFrame, by: list[str], n: int) -> DataFrame:
    """n uniform times (k, t) over each series."""
    s = stats(samples, by)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    return s.select(*by, "t_start", "t_end", k).select(*by, "k", (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * F.col("k") / F.lit(float(max(1, n - 1)))).alias("t"))


def stepped_grid(spans: DataFrame, by: list[str], step: float) -> DataFrame:
    """(k, t, dt) of a grid over spans (t_start, t_end): ceil(length / step) + 1 times at equal distances dt."""
    length = F.col("t_end") - F.col("t_start")
    g = spans.withColumn("steps", F.ceil(length / step) + 1)
    g = g.withColumn("dt", F.when(F.col("steps") > 1, length / (F.col("steps") - 1)).otherwise(0.0))
    return g.select(*by, "t_start", "dt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("k")).select(*by, "k", (F.col("t_start") + F.col("k") * F.col("dt")).alias("t"), "dt")


def neighbours(samples: DataFrame, probes: DataFrame, by: list[str], bucket: float | None = None, strict: bool = False) -> DataFrame:
    """probes with structs (t, value): lower, the last sample at or before t (before it if strict), and upper, the first at or after it; null where there is none."""
    keep = [c for c in probes.columns if c not in (*by, "t")]
    s = samples.select(*by, "t", F.struct("t", "value").alias("_s"), F.lit(None).cast(probes.select(F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))).schema[0].dataType).alias("_p"), F.lit(0).alias("_is_probe"))
    p = probes.select(*by, "t", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), (F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))).alias("_p"), F.lit(1).alias("_is_probe"))
    both, part = s.unionByName(p), list(by)
    if bucket:
        at = F.floor(F.col("t") / bucket)
        both, part = both.withColumn("_b", at), [*by, "_b"]
        # The buckets' own first and last samples: one row for a bucket.
        b = both.groupBy(*part).agg(F.max(F.when(F.col("_is_probe") == 0, F.col("_s"))).alias("_last"), F.min(F.when(F.col("_is_probe") == 0, F.col("_s"))).alias("_first"))
        w = Window.partitionBy(*by).orderBy("_b")
        carried = b.select(*part, F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
        extra = carried.select(*by, "_b", F.explode(F.array("_before", "_after")).alias("_s")).where("_s is not null")
        none = F.lit(None).cast(both.schema["_p"].dataType)
        both = both.unionByName(extra.select(*by, F.col("_s.t").alias("t"), "_s", none.alias("_p"), F.lit(0).alias("_is_probe"), "_b"))
    up = Window.partitionBy(*part).orderBy("t", F.desc("_is_probe") if strict else F.col("_is_probe")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.desc("t"), "_is_probe", F.desc("_s.value")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("lower", F.last("_s", True).over(up)).withColumn("upper", F.last("_s", True).over(down)).where("_is_probe = 1")
    return found.select(*by, "t", *[F.col("_p")[c].alias(c) for c in keep], "lower", "upper")


def value_at(samples: DataFrame, probes: DataFrame, by: list[str], bucket: float | None = None) -> DataFrame:
    """As-of interpolation: probes with w_lower, v_lower, w_upper, v_upper and their sum `interp`.

    Up to the start (0, first, 1, first), from the end on (1, last, 0, last), between two samples their distance shares, half each where they coincide.
    """
    n = neighbours(samples, probes, by, bucket, strict=True).join(samples.groupBy(*by).agg(F.max("t").alias("_end")), by)
    first, last = F.col("lower").isNull(), F.col("t") >= F.col("_end")
    span = F.col("upper.t") - F.col("lower.t")
    final = F.coalesce("upper.value", "lower.value")
    out = n.withColumn("w_upper", F.when(first, 1.0).when(last, 0.0).when(span == 0, 0.5).otherwise((F.col("t") - F.col("lower.t")) / span)).withColumn("w_lower", 1.0 - F.col("w_upper"))
    out = out.withColumn("v_lower", F.when(first, F.col("upper.value")).when(last, final).otherwise(F.col("lower.value"))).withColumn("v_upper", F.when(last, final).otherwise(F.col("upper.value")))
    return out.withColumn("interp", F.col("w_lower") * F.col("v_lower") + F.col("w_upper") * F.col("v_upper")).drop("lower", "upper", "_end")


def nearest(samples: DataFrame, probes: DataFrame, by: list[str], bucket: float | None = None) -> DataFrame:
    """probes with the nearest sample (nearest_t, nearest_value), the later one of a tie, and the samples before and after (previous_t, next_t).

    previous_t is the last sample at or before t, next_t the first at or after it.
    """
    n = neighbours(samples, probes, by, bucket)
    earlier = F.col("upper").isNull() | (F.col("lower").isNotNull() & (F.col("t") - F.col("lower.t") < F.col("upper.t") - F.col("t")))
    s = F.when(earlier, F.col("lower")).otherwise(F.col("upper"))
    return n.select(*[c for c in n.columns if c not in ("lower", "upper")], s["t"].alias("nearest_t"), s["value"].alias("nearest_value"), F.col("lower.t").alias("previous_t"), F.col("upper.t").alias("next_t"))


def segments(samples: DataFrame, by: list[str], hold: str = "previous") -> DataFrame:
    """(t_from, t_to, value): where each sample's value holds, the outer ones without end. hold: previous or next sample."""
    w = Window.partitionBy(*by).orderBy("t")
    inf = F.lit(float("inf"))
    before, after = F.lag("t").over(w), F.lead("t").over(w)
    if hold == "previous":
        return samples.select(*by, F.when(before.isNull(), -inf).otherwise(F.col("t")).alias("t_from"), F.coalesce(after, inf).alias("t_to"), "value")
    return samples.select(*by, F.coalesce(before, -inf).alias("t_from"), F.when(after.isNull(), inf).otherwise(F.col("t")).alias("t_to"), "value")


def integrals(samples: DataFrame, intervals: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pieces (dt, value) of each interval (t0, tf): dt sums to tf - t0. Forward the previous sample holds, backward the next one and dt is negative.

    The range join is an equi-join on time cells of `width`: each segment and interval is copied into the cells it meets (outer
    segments, which have no end, into the cells of its series' intervals only), and a pair counts in the cell where it begins.
    """
    span = intervals.withColumn("low", F.least("t0", "tf")).withColumn("high", F.greatest("t0", "tf"))
    cell = lambda t: F.floor(t / width)
    bound = span.groupBy(*by).agg(F.min("low").alias("b_low"), F.max("high").alias("b_high"))
    q = span.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    out = None
    for hold, sign in (("previous", F.col("t0") <= F.col("tf")), ("next", F.col("t0") > F.col("tf"))):
        s = segments(samples, by, hold).join(bound, by).withColumn("s_low", F.greatest("t_from", "b_low")).withColumn("s_high", F.least("t_to", "b_high")).where("s_low <= s_high")
        s = s.withColumn("cell", F.explode(F.sequence(cell(F.col("s_low")), cell(F.col("s_high")))))
        met = q.where(sign).join(s.select(*by, "cell", "t_from", "t_to", "value"), [*by, "cell"])
        low, high = F.greatest("low", "t_from"), F.least("high", "t_to")
        met = met.where((high > low) & (F.col("cell") == cell(low)))
        piece = met.withColumn("dt", F.when(F.col("t0") > F.col("tf"), -(high - low)).otherwise(high - low)).drop("cell", "t_from", "t_to", "low", "high")
        out = piece if out is None else out.unionByName(piece)
    return out


def common_interval(series: DataFrame, by: list[str], kinds: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The time that all kinds of samples of a group share, clipped to [low, high]; no row where it is empty."""
    each = series.groupBy(*by, kinds).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    both = each.groupBy(*by).agg(F.max("a").alias("t_start"), F.min("b").alias("t_end"))
    if low is not None:
        both = both.withColumn("t_start", F.greatest("t_start", F.lit(low)))
    if high is not None:
        both = both.withColumn("t_end", F.least("t_end", F.lit(high)))
    return both.where("t_end > t_start")


def nonfinite_census(samples: DataFrame, by: list[str], value: str = "v", shown: int = 10) -> DataFrame:
    """(by, n_bad, first_bad): how many values of each series are no finite numbers, nulls included, and the places of the first ones in order of time, from 0.

    Places are dealt by ranges of time and only bad rows are ranked, so a series with very many of either is many tasks' work.
    """
    at = placed(samples.select(*by, "t", F.col(value).cast("double").alias("v")), by, [F.col("t")], "i", shared_folder(samples.sparkSession, "census"))
    bad = at.where(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).select(*by, "i")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("i"))
    first = bad.withColumn("k", rank).where(F.col("k") <= shown).groupBy(*by).agg(F.array_sort(F.collect_list("i")).alias("first_bad"))
    counts = joined(samples.select(*by).distinct(), bad.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bad")), by, "left")
    return joined(counts, first, by, "left").select(*by, F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("first_bad", F.array().cast("array<long>")).alias("first_bad"))


def first_in_interval(samples: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """For each pair of neighbouring nodes (t1, t2): the first sample from t1 on, if it is at t2 at the latest, with its weights w1 and w2."""
    w = Window.partitionBy(*by).orderBy("t")
    pairs = nodes.select(*by, F.col("t"), F.lead("t").over(w).alias("t2")).where("t2 is not null")
    found = neighbours(samples, pairs, by).where("upper.t <= t2")
    span = F.col("t2") - F.col("t")
    return found.select(*by, F.col("t").alias("t1"), "t2", F.col("upper.t").alias("t"), F.col("upper.value").alias("value"), ((F.col("t2") - F.col("upper.t")) / span).alias("w1"), ((F.col("upper.t") - F.col("t")) / span).alias("w2"))


def gauss_markov(samples: DataFrame, by: list[str], beta: float, mu: float, sigma: float) -> DataFrame:
    """Residuals (x1 - k x0 - mu (1 - k)) / sigma of neighbouring samples, k = exp(-beta |dt|)."""
    w = Window.partitionBy(*by).orderBy("t")
    k = F.exp(-beta * F.abs(F.col("t") - F.lag("t").over(w)))
    return samples.select(*by, "t", ((F.col("value") - k * F.lag("value").over(w) - mu * (1 - k)) / sigma).alias("residual")).where("residual is not null")


def process_nodes(samples: DataFrame, by: list[str], time_scale: float) -> DataFrame:
    """Uniform nodes (k, t, value 0) of a stochastic process: max(2, ceil(span / time_scale) + 1) of them for a series."""
    s = stats(samples, by)
    span = F.col("t_end") - F.col("t_start")
    s = s.withColumn("nodes", F.greatest(F.lit(2).cast("long"), F.ceil(span / time_scale) + 1))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1)).alias("k")
    return s.select(*by, "t_start", "t_end", "nodes", k).select(*by, "k", (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * F.col("k") / (F.col("nodes") - 1)).alias("t"), F.lit(0.0).alias("value"))


def weighted_sum(targets: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """value + sum(w * p) of the parts of each target."""
    summed = parts.groupBy(key).agg(F.sum(F.col("w") * F.col("p")).alias("_sum"))
    return targets.join(summed, key, "left").select(*[c for c in targets.columns if c != "value"], (F.col("value") + F.coalesce("_sum", F.lit(0.0))).alias("value"))
