"""Live state of running experiments. The same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.aggregates import sample_std


def live_progress(events: DataFrame, by: list[str], order: str = "event_id") -> DataFrame:
    """Runs started, completed and failed, percent done, cost so far and the latest status per group."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "fail")
    g = events.groupBy(*by).agg(
        F.count_if(F.col("status") == "start").alias("started"), (done + failed).alias("completed"),
        failed.alias("failed"), F.sum("cost").alias("cost"), F.max_by("status", order).alias("last_status"))
    total = F.greatest("started", "completed")
    return g.withColumn("pct", ratio("completed", total, 0.0) * 100.0)


def phase_progress(events: DataFrame, by: list[str], order: str = "event_id", item: str = "event_id") -> DataFrame:
    """Per scoring phase: items announced, items completed, the current item, and whether it has ended."""
    step = F.col("status") == "progress"
    return events.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("status") == "start", F.col("k"))), F.lit(0)).alias("announced"),
        F.count_if(step).alias("completed"),
        F.max_by(F.when(step, F.col(item)), F.when(step, F.col(order))).alias("current_item"),
        (F.max_by("status", order) == "done").alias("ended"))


def live_quality(scored: DataFrame, by: list[str], score: str = "composite") -> DataFrame:
    """Running mean and deviation of a score."""
    return scored.groupBy(*by).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), sample_std(score).alias("stdev"))
