"""Rates of counters over time: window functions over (ts_ms, value) samples.

``by`` names the keys of the series; a series is the unit that one task orders,
so give keys wherever samples come from many counters. Without keys all samples
are one series, and one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTES = (1, 5, 15)


def rolling(samples: DataFrame, ts: str = "ts_ms", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """rate_1m, rate_5m, rate_15m: (newest - oldest) a second inside the window; 0 for a single sample."""
    w = Window.partitionBy(*by).orderBy(ts)
    rates: dict[str, Column] = {}
    for m in MINUTES:
        span = w.rangeBetween(-m * 60_000, 0)
        dv, dt = F.col(value) - F.first(value).over(span), F.col(ts) - F.first(ts).over(span)
        rates[f"rate_{m}m"] = F.coalesce(F.try_divide(dv * 1000.0, dt), F.lit(0.0))
    return samples.withColumns(rates)


def peak(samples: DataFrame, ts: str = "ts_ms", value: str = "value", by: tuple[str, ...] = (), last: int = 60) -> DataFrame:
    """peak: the greatest rate a second between neighbours among the last samples."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = F.try_divide((F.col(value) - F.lag(value).over(w)) * 1000.0, F.col(ts) - F.lag(ts).over(w))
    stepped = samples.withColumn("_step", step)
    return stepped.withColumn("peak", F.coalesce(F.max("_step").over(w.rowsBetween(-(last - 2), 0)), F.lit(0.0))).drop("_step")
