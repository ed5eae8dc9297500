"""Time series, trajectories and their statistics. `events` of a user stand in for a sensor's samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rotations import rotation_matrix
from ..functions.vectors import vector
from ..operators import timeseq as ts
from ..operators import trajectories as tr
from .common import EV, SPAN, Registry, events, rounded, sql_rounded

_R = Registry()
r, sr = rounded, sql_rounded
GRID = "pr AS (SELECT user_id, k, a + (b - a) * k / 9.0::DOUBLE AS t FROM st, range(10) g(k))"


@_R.add(
    "timeseq_value_at",
    f"""WITH {EV}, {SPAN}, {GRID},
    lo AS (SELECT p.*, e.t AS lt, e.value AS lv FROM pr p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.t > e.t),
    hi AS (SELECT l.*, e.t AS ut, e.value AS uv FROM lo l ASOF LEFT JOIN ev e ON l.user_id = e.user_id AND l.t <= e.t),
    w AS (SELECT h.*, CASE WHEN lt IS NULL THEN 1.0 WHEN h.t >= st.b THEN 0.0 ELSE (h.t - lt) / (ut - lt) END::DOUBLE AS wu,
                 CASE WHEN lt IS NULL THEN uv WHEN h.t >= st.b THEN coalesce(uv, lv) ELSE lv END AS vl,
                 CASE WHEN h.t >= st.b THEN coalesce(uv, lv) ELSE uv END AS vu FROM hi h JOIN st USING (user_id))
    SELECT user_id, k, {sr('t', 3)} AS t, {sr('1.0 - wu')} AS w_lower, {sr('vl')} AS v_lower, {sr('wu')} AS w_upper, {sr('vu')} AS v_upper, {sr('(1.0 - wu) * vl + wu * vu')} AS interp FROM w""",
)
def timeseq_value_at(spark, d):
    e = events(spark, d).select("user_id", "t", "value")
    out = ts.value_at(e, ts.regular_grid(e, ["user_id"], 10).withColumn("k", F.col("k").cast("long")), ["user_id"], bucket=86400.0)
    return out.select("user_id", "k", r(F.col("t"), 3).alias("t"), *[r(F.col(c)).alias(c) for c in ("w_lower", "v_lower", "w_upper", "v_upper", "interp")])


@_R.add("timeseq_stats", f"WITH {EV}, {SPAN} SELECT user_id, {sr('a')} AS t_start, {sr('b')} AS t_end, n, {sr('CASE WHEN n <= 1 OR b <= a THEN 1.0 ELSE (b - a) / (n - 1) END::DOUBLE')} AS step FROM st")
def timeseq_stats(spark, d):
    s = ts.stats(events(spark, d), ["user_id"])
    return s.select("user_id", "n", *[r(F.col(c)).alias(c) for c in ("t_start", "t_end", "step")])


@_R.add(
    "timeseq_nearest",
    f"""WITH {EV}, {SPAN}, {GRID},
    lo AS (SELECT p.*, e.t AS lt, e.value AS lv FROM pr p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.t >= e.t),
    hi AS (SELECT l.*, e.t AS ut, e.value AS uv FROM lo l ASOF LEFT JOIN ev e ON l.user_id = e.user_id AND l.t <= e.t),
    c AS (SELECT *, ut IS NULL OR (lt IS NOT NULL AND t - lt < ut - t) AS early FROM hi)
    SELECT user_id, k, {sr('CASE WHEN early THEN lt ELSE ut END', 3)} AS nearest_t, {sr('CASE WHEN early THEN lv ELSE uv END')} AS nearest_value, {sr('lt', 3)} AS previous_t, {sr('ut', 3)} AS next_t FROM c""",
)
def timeseq_nearest(spark, d):
    e = events(spark, d).select("user_id", "t", "value")
    out = ts.nearest(e, ts.regular_grid(e, ["user_id"], 10).withColumn("k", F.col("k").cast("long")), ["user_id"], bucket=86400.0)
    return out.select("user_id", "k", *[r(F.col(c), 3).alias(c) for c in ("nearest_t", "previous_t", "next_t")], r(F.col("nearest_value")).alias("nearest_value"))


_INTERVALS = "q AS (SELECT user_id, k, a + (b - a) * (k * 0.3::DOUBLE - 0.2::DOUBLE) AS t0, a + (b - a) * (k * 0.3::DOUBLE + 0.15::DOUBLE) AS tf FROM st, range(5) g(k))"


def _intervals(e, backward=False):
    s = ts.stats(e, ["user_id"]).select("user_id", "t_start", "t_end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k"))
    a, span = F.col("t_start"), F.col("t_end") - F.col("t_start")
    t0, tf = a + span * (F.col("k") * 0.3 - 0.2), a + span * (F.col("k") * 0.3 + 0.15)
    return s.select("user_id", "k", (tf if backward else t0).alias("t0"), (t0 if backward else tf).alias("tf"))


def _integral_sql(backward: bool) -> str:
    if backward:
        seg = "sg AS (SELECT user_id, value, coalesce(lag(t) OVER w, -1e300) AS f, CASE WHEN lead(t) OVER w IS NULL THEN 1e300 ELSE t END AS u FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))"
    else:
        seg = "sg AS (SELECT user_id, value, CASE WHEN lag(t) OVER w IS NULL THEN -1e300 ELSE t END AS f, coalesce(lead(t) OVER w, 1e300) AS u FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))"
    sign = "-" if backward else ""
    return f"""WITH {EV}, {SPAN}, {_INTERVALS}, {seg},
    m AS (SELECT q.user_id, k, {sign}(least(tf, u) - greatest(t0, f)) AS dt, value FROM q JOIN sg ON q.user_id = sg.user_id AND sg.f < q.tf AND sg.u > q.t0)
    SELECT user_id, k, count(*) AS n_pieces, {sr('sum(dt)', 3)} AS duration, {sr('sum(dt * value) / sum(dt)', 4)} AS mean_value FROM m GROUP BY ALL"""


def _integral(spark, d, backward):
    e = events(spark, d).select("user_id", "t", "value")
    p = ts.integrals(e, _intervals(e, backward), ["user_id"], 86400.0)
    return p.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n_pieces"), r(F.sum("dt"), 3).alias("duration"), r(F.sum(F.col("dt") * F.col("value")) / F.sum("dt"), 4).alias("mean_value"))


@_R.add("timeseq_integral_forward", _integral_sql(False))
def timeseq_integral_forward(spark, d):
    return _integral(spark, d, False)


@_R.add("timeseq_integral_backward", _integral_sql(True))
def timeseq_integral_backward(spark, d):
    return _integral(spark, d, True)


@_R.add(
    "timeseq_common_interval",
    f"""WITH {EV}, c AS (SELECT min(t) + (max(t) - min(t)) * 0.02::DOUBLE AS low, min(t) + (max(t) - min(t)) * 0.9::DOUBLE AS high FROM ev), k AS (SELECT user_id, event_type, min(t) AS a, max(t) AS b FROM ev GROUP BY ALL), m AS (SELECT user_id, max(a) AS a, min(b) AS b FROM k GROUP BY 1)
    SELECT user_id, {sr('greatest(a, low)', 3)} AS t_start, {sr('least(b, high)', 3)} AS t_end FROM m, c WHERE least(b, high) > greatest(a, low)""",
)
def timeseq_common_interval(spark, d):
    """Clipped to the time from 2 % to 90 % of all samples."""
    e = events(spark, d)
    a, b = e.agg(F.min("t"), F.max("t")).first()
    c = ts.common_interval(e, ["user_id"], "event_type", low=a + (b - a) * 0.02, high=a + (b - a) * 0.9)
    return c.select("user_id", r(F.col("t_start"), 3).alias("t_start"), r(F.col("t_end"), 3).alias("t_end"))


@_R.add(
    "timeseq_stepped_grid",
    f"WITH {EV}, {SPAN}, g AS (SELECT user_id, a, b, ceil((b - a) / 250000.0)::BIGINT + 1 AS steps FROM st), h AS (SELECT *, CASE WHEN steps > 1 THEN (b - a) / (steps - 1) ELSE 0 END::DOUBLE AS dt FROM g) SELECT user_id, k, {sr('a + k * dt', 3)} AS t, {sr('dt')} AS dt FROM (SELECT *, unnest(range(steps)) AS k FROM h)",
)
def timeseq_stepped_grid(spark, d):
    g = ts.stepped_grid(ts.stats(events(spark, d), ["user_id"]), ["user_id"], 250000.0)
    return g.select("user_id", "k", r(F.col("t"), 3).alias("t"), r(F.col("dt")).alias("dt"))


@_R.add(
    "timeseq_first_in_interval",
    f"""WITH {EV}, {SPAN}, {GRID}, nd AS (SELECT user_id, t AS t1, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t2 FROM pr),
    f AS (SELECT nd.*, e.t, e.value FROM nd ASOF JOIN ev e ON nd.user_id = e.user_id AND nd.t1 <= e.t WHERE t2 IS NOT NULL)
    SELECT user_id, {sr('t1', 3)} AS t1, {sr('t', 3)} AS t, {sr('value')} AS value, {sr('(t2 - t) / (t2 - t1)')} AS w1, {sr('(t - t1) / (t2 - t1)')} AS w2 FROM f WHERE t <= t2""",
)
def timeseq_first_in_interval(spark, d):
    e = events(spark, d).select("user_id", "t", "value")
    f = ts.first_in_interval(e, ts.regular_grid(e, ["user_id"], 10), ["user_id"])
    return f.select("user_id", r(F.col("t1"), 3).alias("t1"), r(F.col("t"), 3).alias("t"), *[r(F.col(c)).alias(c) for c in ("value", "w1", "w2")])


@_R.add(
    "timeseq_gauss_markov",
    f"WITH {EV}, l AS (SELECT user_id, t, value, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), k AS (SELECT *, exp(-1e-6 * abs(t - t0)) AS k FROM l WHERE t0 IS NOT NULL) SELECT user_id, {sr('t', 3)} AS t, {sr('(value - k * v0 - 10.0 * (1 - k)) / 2.0')} AS residual FROM k",
)
def timeseq_gauss_markov(spark, d):
    g = ts.gauss_markov(events(spark, d), ["user_id"], 1e-6, 10.0, 2.0)
    return g.select("user_id", r(F.col("t"), 3).alias("t"), r(F.col("residual")).alias("residual"))


@_R.add("timeseq_process_nodes", f"WITH {EV}, {SPAN}, n AS (SELECT *, greatest(2, ceil((b - a) / 500000.0)::BIGINT + 1) AS nodes FROM st) SELECT user_id, k, {sr('a + (b - a) * k / (nodes - 1)', 3)} AS t, 0.0::DOUBLE AS value FROM (SELECT *, unnest(range(nodes)) AS k FROM n)")
def timeseq_process_nodes(spark, d):
    n = ts.process_nodes(events(spark, d), ["user_id"], 500000.0)
    return n.select("user_id", "k", r(F.col("t"), 3).alias("t"), "value")


@_R.add(
    "timeseq_weighted_sum",
    f"SELECT o_orderkey, {sr('o_totalprice + coalesce(s, 0)', 4)} AS value FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_discount * l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def timeseq_weighted_sum(spark, d):
    from .common import table

    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("w"), F.col("l_extendedprice").alias("p"))
    out = ts.weighted_sum(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), parts, "o_orderkey")
    return out.select("o_orderkey", r(F.col("value"), 4).alias("value"))


# ---- statistics --------------------------------------------------------------------------------


@_R.add(
    "series_nonfinite_census",
    f"""WITH {EV}, v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, event_id % 40 = 0 AS bad FROM ev),
    b AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM v WHERE bad)
    SELECT v.user_id, count(*) FILTER (bad) AS n_bad, coalesce((SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM b WHERE b.user_id = v.user_id AND k <= 10), '') AS first_bad FROM v GROUP BY v.user_id""",
)
def series_nonfinite_census(spark, d):
    e = events(spark, d).select("user_id", "t", F.when(F.col("event_id") % 40 == 0, float("nan")).otherwise(F.col("value")).alias("v"))
    c = ts.nonfinite_census(e, ["user_id"])
    return c.select("user_id", "n_bad", F.array_join(F.transform("first_bad", lambda x: x.cast("string")), ",").alias("first_bad"))


@_R.add(
    "series_error_statistics",
    f"""WITH {EV}, v AS (SELECT user_id, value - 20.0 AS x, value * 0.5 AS y, event_id % 13 - 6.0 AS z FROM ev), n AS (SELECT *, x * x + y * y + z * z AS n2 FROM v)
    SELECT user_id, {sr('avg(x)')} AS mean0, {sr('avg(y)')} AS mean1, {sr('avg(z)')} AS mean2, {sr('arg_max(x, abs(x))')} AS maxabs0, {sr('sqrt(avg(n2))')} AS rms, {sr('sqrt(max(n2))')} AS max_norm, {sr('avg(sqrt(n2))')} AS mean_norm, {sr('var_pop(sqrt(n2))', 4)} AS var_norm FROM n GROUP BY 1""",
)
def series_error_statistics(spark, d):
    e = events(spark, d).select("user_id", F.array(F.col("value") - 20.0, F.col("value") * 0.5, F.col("event_id") % 13 - 6.0).alias("err"))
    s = tr.error_statistics(e, ["user_id"])
    return s.select("user_id", *[r(F.col(c)).alias(c) for c in ("mean0", "mean1", "mean2", "maxabs0", "rms", "max_norm", "mean_norm")], r(F.col("var_norm"), 4).alias("var_norm"))


@_R.add(
    "series_view",
    f"WITH {EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM ev) SELECT user_id, count(*) AS shown, {sr('min(least(value, value * 0.5))')} AS low, {sr('max(greatest(value, value * 0.5))')} AS high, {sr('max(t) - min(t)', 3)} AS span FROM v WHERE i % 5 = 0 GROUP BY 1",
)
def series_view(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1).where("i % 5 = 0")
    half = F.col("value") * 0.5
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("shown"), r(F.min(F.least("value", half))).alias("low"), r(F.max(F.greatest("value", half))).alias("high"), r(F.max("t") - F.min("t"), 3).alias("span"))


# ---- trajectories ------------------------------------------------------------------------------


def _poses(spark, d, shift=0.0):
    e = events(spark, d)
    return e.select("user_id", "t", F.struct(vector(F.lit(0.0), F.lit(0.0), F.col("value") * 0.001 + shift).alias("r"), vector(F.col("value") + shift, F.col("value") * 2, F.lit(1.0)).alias("t")).alias("pose"))


_INTERP = f"""{EV}, {SPAN}, {GRID},
    lo AS (SELECT p.*, e.t AS lt, e.value AS lv FROM pr p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.t >= e.t),
    hi AS (SELECT l.*, e.t AS ut, e.value AS uv FROM lo l ASOF LEFT JOIN ev e ON l.user_id = e.user_id AND l.t <= e.t),
    v AS (SELECT user_id, k, CASE WHEN lt IS NULL THEN uv WHEN ut IS NULL OR ut = lt THEN lv ELSE lv + (uv - lv) * ((t - lt) / (ut - lt)) END AS v FROM hi)"""


@_R.add("trajectory_pose_at", f"WITH {_INTERP} SELECT user_id, k, {sr('v')} AS x, {sr('v * 2')} AS y, {sr('v * 0.001')} AS rz FROM v")
def trajectory_pose_at(spark, d):
    p = _poses(spark, d)
    out = tr.pose_at(p, ts.regular_grid(p, ["user_id"], 10).withColumn("k", F.col("k").cast("long")), ["user_id"])
    return out.select("user_id", "k", r(F.col("pose.t")[0]).alias("x"), r(F.col("pose.t")[1]).alias("y"), r(F.col("pose.r")[2]).alias("rz"))


@_R.add("trajectory_compare", f"WITH {_INTERP} SELECT user_id, k, 0.25::DOUBLE AS dx, 0.0::DOUBLE AS dy, 0.25::DOUBLE AS drz FROM v")
def trajectory_compare(spark, d):
    c = tr.compare(_poses(spark, d), _poses(spark, d, 0.25), ["user_id"], 10)
    return c.select("user_id", F.col("k").cast("long").alias("k"), r(F.col("dp")[0]).alias("dx"), r(F.col("dp")[1]).alias("dy"), r(F.col("dr")[2]).alias("drz"))


@_R.add(
    "trajectory_gyro_rotation",
    f"""WITH {EV}, {SPAN}, {_INTERVALS},
    sg AS (SELECT user_id, value, CASE WHEN lag(t) OVER w IS NULL THEN -1e300 ELSE t END AS f, coalesce(lead(t) OVER w, 1e300) AS u FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    m AS (SELECT q.user_id, k, least(tf, u) - greatest(t0, f) AS dt, value FROM q JOIN sg ON q.user_id = sg.user_id AND sg.f < q.tf AND sg.u > q.t0)
    SELECT user_id, k, {sr('sum(dt * value) * 1e-9')} AS rz FROM m GROUP BY ALL""",
)
def trajectory_gyro_rotation(spark, d):
    e = events(spark, d)
    gyro = e.select("user_id", "t", vector(F.lit(0.0), F.lit(0.0), F.col("value") * 1e-9).alias("value"))
    g = tr.gyro_rotation(gyro, _intervals(e), ["user_id"], 86400.0)
    return g.select("user_id", "k", r(F.col("r")[2]).alias("rz"))


@_R.add("trajectory_accelerometer")
def trajectory_accelerometer(spark, d):
    e = events(spark, d)
    gyro = e.select("user_id", "t", vector(F.lit(0.0), F.lit(0.0), F.col("value") * 1e-9).alias("value"))
    acc = e.select("user_id", "t", vector(F.col("value") * 1e-6, F.lit(0.0), F.lit(9.81e-6)).alias("value"))
    v = tr.accelerometer_velocity(gyro, acc, _intervals(e), ["user_id"], 86400.0)
    return v.select("user_id", "k", *[r(F.col("dv")[i]).alias(f"dv{i}") for i in range(3)])


@_R.add("trajectory_guided_subsample")
def trajectory_guided_subsample(spark, d):
    from pyspark.sql import Window

    p = _poses(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    coarse = _poses(spark, d, 0.1).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t"))).where("i % 8 = 0")
    g = tr.guided_subsample(coarse.drop("i"), p.drop("i"), ["user_id"])
    return g.select("user_id", r(F.col("t"), 3).alias("t"), "inserted", r(F.col("pose.t")[0], 4).alias("x"))


@_R.add("trajectory_consistency")
def trajectory_consistency(spark, d):
    gyro = events(spark, d).select("user_id", "t", vector(F.lit(0.0), F.lit(0.0), F.col("value") * 1e-9).alias("value"))
    c = tr.consistency(_poses(spark, d), gyro, ["user_id"], 100000.0)
    return tr.error_statistics(c, ["user_id"])


@_R.add(
    "trajectory_zip",
    f"WITH {EV} SELECT user_id, {sr('t', 3)} AS t, {sr('value')} AS x, {sr('event_id % 7 * 0.01')} AS rz FROM ev",
)
def trajectory_zip(spark, d):
    e = events(spark, d)
    p = e.select("user_id", "t", vector(F.col("value"), F.lit(0.0), F.lit(0.0)).alias("v"))
    o = e.select("user_id", "t", vector(F.lit(0.0), F.lit(0.0), F.col("event_id") % 7 * 0.01).alias("v"))
    z = tr.zip_by_row(p, o, ["user_id"])
    return z.select("user_id", r(F.col("t"), 3).alias("t"), r(F.col("pose.t")[0]).alias("x"), r(F.col("pose.r")[2]).alias("rz"))


@_R.add("trajectory_centred", f"WITH {EV} SELECT user_id, {sr('t', 3)} AS t, {sr('value - avg(value) OVER (PARTITION BY user_id) + 1.3e-7', 4)} AS x FROM ev")
def trajectory_centred(spark, d):
    c = tr.centred(_poses(spark, d), ["user_id"])
    return c.select("user_id", r(F.col("t"), 3).alias("t"), r(F.col("pose.t")[0] + 1.3e-7, 4).alias("x"))


@_R.add(
    "trajectory_mounted",
    f"WITH {EV}, a AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id * 0.1::DOUBLE END AS z FROM ev) SELECT event_id, {sr('cos(z) * value - sin(z)')} AS x, {sr('sin(z) * value + cos(z)')} AS y, 2.0::DOUBLE AS z FROM a",
)
def trajectory_mounted(spark, d):
    e = events(spark, d).select("user_id", "event_id", vector(F.col("value"), F.lit(1.0), F.lit(2.0)).alias("v"))
    m = e.select("user_id").distinct().where("user_id % 3 <> 0")
    m = m.withColumn("mounting", rotation_matrix(vector(F.lit(0.0), F.lit(0.0), F.col("user_id") * 0.1)))
    return tr.mounted(e, m, ["user_id"]).select("event_id", *[r(F.col("v")[i]).alias(n) for i, n in enumerate("xyz")])


QUERIES, ORACLES = _R.queries, _R.oracles
