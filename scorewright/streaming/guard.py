"""Stop spending once a cap is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prefix
from ..session import scratch
from .replay import drain


def guard_batch(batch: DataFrame, carried: DataFrame | None, by: list[str], order: str, cost: str, cap: float,
                splits: list[float] | None) -> DataFrame:
    """Events of one batch with the cost before and after each, what earlier batches spent included."""
    df = prefix.running(batch, by, [order], {"_in": F.col(cost)}, splits)
    if carried is None:
        df = df.withColumn("_carried", F.lit(0.0))
    else:
        df = df.join(carried, by, "left").withColumn("_carried", F.coalesce("_carried", F.lit(0.0)))
    after = F.col("_in") + F.col("_carried")
    return df.withColumn("running_cost", after).withColumn("cost_before", after - F.col(cost)).drop("_in")


def cost_guard(events: DataFrame, by: list[str], cap: float, order: str = "event_id", cost: str = "cost",
               split: bool = True, out: str | None = None) -> DataFrame:
    """Alerts of a stream of events: the first event of a group at which the cap is reached, with the
    number of starts after it.

    Per-key state code would take a hot group through one task row by row. Here each batch is summed with the
    two-level running total of the batch operators, and only one total per group is carried over in a
    table per batch, so a batch that is run again reads and writes the same folders.
    """
    spark = events.sparkSession
    out = out or scratch(spark, "cost-guard")

    def handle(batch: DataFrame, batch_id: int) -> None:
        carried = spark.read.parquet(f"{out}/totals-{batch_id - 1:09d}") if batch_id else None
        splits = prefix.range_splits(batch, order) if split else None
        marked = guard_batch(batch, carried, by, order, cost, cap, splits)
        over = F.col("running_cost") >= cap
        late_start = (F.col("status") == "start") & (F.col("cost_before") >= cap)
        g = marked.groupBy(*by).agg(
            F.max("_carried").alias("_before"), F.sum(cost).alias("_spent"),
            F.min(F.when(over, F.col(order))).alias("alert_at"), F.count_if(late_start).alias("late_starts"))
        g.write.mode("overwrite").parquet(f"{out}/groups-{batch_id:09d}")
        fresh = spark.read.parquet(f"{out}/groups-{batch_id:09d}").select(
            *by, (F.col("_before") + F.col("_spent")).alias("_carried"))
        if carried is not None:
            fresh = fresh.unionByName(carried.join(fresh.select(*by), by, "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{out}/totals-{batch_id:09d}")

    drain(events, "append", handle, f"{out}/checkpoint")
    groups = spark.read.parquet(f"{out}/groups-*")
    return groups.groupBy(*by).agg(
        F.min("alert_at").alias("alert_at"), F.sum("late_starts").alias("late_starts"), F.sum("_spent").alias("total_cost"))
