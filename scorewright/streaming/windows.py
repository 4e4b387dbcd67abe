"""Activity over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col


def throughput(events: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None,
               delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs, failures and cost per tumbling or sliding window; events later than `delay` are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), *(by or [])).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "fail").alias("failures"), F.sum("cost").alias("cost"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []),
                    "events", "failures", "cost")


def still_open(windowed: DataFrame, events: DataFrame, end: Column | str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Of windows over a table of events, those that a stream over it would still hold back at its end.

    For sessions `end` must be reckoned from `last_event`: a filter on the session's own end would be pushed below the
    merging of sessions.
    """
    last = events.agg((F.date_trunc("millisecond", F.max(ts)) - F.expr(f"INTERVAL {delay}")).alias("mark")).scalar()
    return windowed.where(col(end) > last)


def sessions(events: DataFrame, gap: str, by: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Periods of activity that end after a gap without events; last_event is the time of the last one in it."""
    g = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "fail").alias("failures"), F.max(ts).alias("last_event"))
    return g.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "last_event", "events", "failures")
