"""Outcome of runs that were tried several times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..session import pin, scratch, spread
from .replay import drain

# Retries of a transient failure, and the first delay in seconds.
MAX_RETRIES = 3
BASE_DELAY = 30


#: The kinds of an attempt in the order of their names; none comes before them.
_KINDS = ["auth", "deterministic", "other", "success", "transient"]


def retry_parts(attempts: DataFrame, key: list[str], attempt: str = "attempt", success: str = "success",
                error: str = "error", within: list[Column] | None = None) -> DataFrame:
    """What is to be known of each run's attempts; the parts of several tables of attempts can be merged.

    An attempt and its kind travel as one number, attempt first, which sorts as the two do and is aggregated without a sort.
    `within` are further group columns.
    """
    kind = F.when(F.col(success), "success").otherwise(labels.error_class(error))
    allowed = F.col(attempt) <= MAX_RETRIES + 1
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in _KINDS]), kind), F.lit(0))
    row = F.shiftleft(F.col(attempt).cast("bigint"), 3) + place
    return attempts.groupBy(*key, *(within or [])).agg(
        F.min(F.when(allowed & (kind != "transient"), row)).alias("_final"), F.max(F.when(allowed, row)).alias("_last"),
        F.count("*").alias("attempts_seen"))


def retry_outcomes(parts: DataFrame, key: list[str], numbers: str = "int") -> DataFrame:
    """The outcome that the parts of a run give; `numbers` is the type of an attempt's number."""
    end = F.coalesce("_final", "_last")
    kind = F.get(F.array(F.lit(None).cast("string"), *[F.lit(k) for k in _KINDS]), end.bitwiseAND(F.lit(7)).cast("int"))
    retries = F.shiftright(end, 3).cast(numbers) - 1
    outcome = F.when(kind == "transient", F.when(retries >= MAX_RETRIES, "exhausted").otherwise("pending")).otherwise(kind)
    return parts.select(*key, "attempts_seen", outcome.alias("outcome"), retries.alias("retries"),
                        (F.lit(BASE_DELAY) * (F.pow(F.lit(2.0), retries) - 1)).cast("bigint").alias("total_delay"))


def retry_chain(attempts: DataFrame, key: list[str], attempt: str = "attempt", success: str = "success",
                error: str = "error") -> DataFrame:
    """Final outcome per run: the first attempt that succeeded or failed for good, else the last one allowed.

    A transient failure is tried again at most MAX_RETRIES times with doubling delays.
    """
    return retry_outcomes(retry_parts(attempts, key, attempt, success, error), key, attempts.schema[attempt].dataType.simpleString())


def retry_table(attempts: DataFrame, key: list[str], out: str | None = None, **columns: str) -> DataFrame:
    """`retry_chain` over a stream of attempts.

    A batch leaves the parts of its own runs in a folder of its own and reads nothing, so there is no state that grows;
    reading the table merges the parts of a run.
    """
    spark = attempts.sparkSession
    out = out or scratch(spark, "retries")

    def handle(batch: DataFrame, batch_id: int) -> None:
        retry_parts(batch, key, **columns).write.mode("overwrite").parquet(f"{out}/parts/batch={batch_id}")

    drain(attempts, "append", handle, f"{out}/checkpoint")
    merged = spread(spark.read.parquet(f"{out}/parts"), *key).groupBy(*key).agg(
        F.min("_final").alias("_final"), F.max("_last").alias("_last"), F.sum("attempts_seen").alias("attempts_seen"))
    return retry_outcomes(merged, key, attempts.schema[columns.get("attempt", "attempt")].dataType.simpleString())


def auth_aborts(attempts: DataFrame, group: list[str], order: str, error: str = "error") -> DataFrame:
    """Per group: the first attempt that failed for credentials, and how many later ones it takes down.

    Attempts are counted per group and place first and written; the first failures, one row a group, then go to the places. No task
    holds all places of a group.
    """
    auth = labels.error_class(error) == "auth"
    places = pin(attempts.groupBy(*group, order).agg(F.count("*").alias("n"), F.bool_or(auth).alias("_auth")), "places")
    first = places.groupBy(*group).agg(F.min(F.when(F.col("_auth"), F.col(order))).alias("aborted_at"))
    return (places.join(first, group).groupBy(*group)
            .agg(F.first("aborted_at").alias("aborted_at"),
                 F.coalesce(F.sum(F.when(F.col(order) > F.col("aborted_at"), F.col("n"))), F.lit(0)).alias("aborted")))


def ended_runs(attempts: DataFrame, key: list[str], ts: str, delay: str, attempt: str = "attempt", success: str = "success",
               error: str = "error") -> DataFrame:
    """A stream of `retry_chain`: each run once, when no attempt has come for `delay`, which is then forgotten.

    `delay` must exceed the longest wait between two attempts and how late one may arrive. A run is a session that ends `delay` after
    its last attempt, so the state holds the parts of runs of the last `delay` only. Attempts that come when their session would
    have ended are not read any more; Spark counts them as rows dropped by the watermark. A row with a null key only moves the
    time on, which a source without news may send: its session has no length, and Spark passes such sessions over.
    """
    unnamed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    open_ = F.session_window(ts, F.when(unnamed, "0 seconds").otherwise(delay)).alias("_open")
    rows = attempts.withWatermark(ts, delay).withColumn(attempt, F.col(attempt).cast("int"))
    return retry_outcomes(retry_parts(rows, key, attempt, success, error, [open_]), key)
