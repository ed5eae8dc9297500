"""Running integrals of series: each sample's value holds until the next one, whichever batch brings it.

A watermark bounds how late a sample may come. State holds a series' samples that the watermark hasn't passed yet, in order of time;
older ones are summed up to one sample. A sample before that one comes too late and is counted in n_late.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "series long, n long, t_last double, integral double, n_late long"
_STATE = "n long, t double, v double, total double, late long, ts array<double>, vs array<double>"


def _add(n, t, v, total, at, value):
    return n + 1, at, value, total + (0.0 if t is None else (at - t) * v)


def _update(key, frames, state):
    n, t, v, total, late, ts, vs = state.get if state.exists else (0, None, None, 0.0, 0, [], [])
    rows = pd.concat(list(frames))
    new = list(zip(rows["t"].astype(float).tolist(), rows["value"].astype(float).tolist(), strict=True))
    waiting = sorted([*zip(ts, vs, strict=True), *(x for x in new if t is None or x[0] >= t)])
    late += len(ts) + len(new) - len(waiting)
    passed = state.getCurrentWatermarkMs() / 1000
    settled, i = (n, t, v, total), 0
    while i < len(waiting) and waiting[i][0] < passed:
        settled, i = _add(*settled, *waiting[i]), i + 1
    now = settled
    for x in waiting[i:]:
        now = _add(*now, *x)
    state.update((*settled, late, [x[0] for x in waiting[i:]], [x[1] for x in waiting[i:]]))
    yield pd.DataFrame({"series": [key[0]], "n": [now[0]], "t_last": [now[1]], "integral": [now[3]], "n_late": [late]})


def running_integral(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """samples: streaming (series, t in seconds, value), up to `late` out of order. Gives each series' integral so far after every batch that has rows of it."""
    timed = samples.withColumn("_at", F.expr("timestamp_micros(try_cast(t * 1e6 as bigint))")).withWatermark("_at", late)
    return timed.groupBy("series").applyInPandasWithState(_update, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_means(samples: DataFrame, time: str, late: str, length: str) -> DataFrame:
    """Mean, count and extent of each series' windows, late rows up to the watermark."""
    w = samples.withWatermark(time, late).groupBy(F.window(time, length), "series")
    return w.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
