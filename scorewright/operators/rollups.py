"""Several levels of grouping in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import ratio
from . import reshape


def quality_cube(runs: DataFrame, score: str = "quality", tokens: str = "token_count") -> DataFrame:
    """Quality, tokens and run counts overall, per profile, per model, per model and profile, and per
    category and profile.

    The runs are first summed at the finest level; the grouping sets then expand only those sums.
    """
    fine = (runs.withColumn("category", labels.task_category("task"))
            .groupBy("model", "profile", "category")
            .agg(F.sum(score).alias("s"), F.count(score).alias("n"), F.count("*").alias("runs"),
                 F.sum(tokens).alias("tokens")))
    g = fine.groupingSets(
        [[], [F.col("profile")], [F.col("model")], [F.col("model"), F.col("profile")],
         [F.col("category"), F.col("profile")]],
        "model", "profile", "category").agg(
        F.grouping_id().alias("level"), F.sum("s").alias("s"), F.sum("n").alias("scored_runs"),
        F.sum("runs").alias("runs"), F.sum("tokens").alias("total_tokens"))
    return g.withColumn("quality", ratio("s", "scored_runs", 0.0)).drop("s")


def cost_rollup(runs: DataFrame, levels: list[str], cost: str = "cost", tokens: str = "token_count") -> DataFrame:
    """Cost and tokens with subtotals along the levels."""
    return runs.rollup(*levels).agg(
        F.grouping_id().alias("level"), F.count("*").alias("runs"), F.sum(cost).alias("cost"),
        F.sum(tokens).alias("total_tokens"))


def dim_cube(runs: DataFrame, axes: list[str], dims: list[str]) -> DataFrame:
    """Mean score over all combinations of the axes and the dimension, subtotals included."""
    sums = reshape.agg_dims(runs, axes, dims, {"s": F.sum})
    g = sums.cube(*axes, "dimension").agg(
        F.grouping_id().alias("level"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.withColumn("mean", ratio("s", "n", 0.0)).drop("s")
