"""Group statistics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import col, ratio
from ..functions.tails import t_critical
from ..session import pin
from . import reshape


def sample_var(value: Column | str) -> Column:
    return F.coalesce(F.var_samp(col(value)), F.when(F.count(col(value)) > 0, F.lit(0.0)))


def sample_std(value: Column | str) -> Column:
    return F.coalesce(F.stddev_samp(col(value)), F.when(F.count(col(value)) > 0, F.lit(0.0)))


def execution_stats(runs: DataFrame, by: list[str], metrics: list[str], success: str = "success") -> DataFrame:
    """Counts, success rate and mean/variance/stdev of each metric over the successful runs."""
    ok = F.col(success)
    aggs = [
        F.count("*").alias("total_runs"),
        F.count_if(ok).alias("successful_runs"),
        F.count_if(~ok).alias("failed_runs"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
    ]
    for m in metrics:
        v = F.when(ok, F.col(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), sample_var(v).alias(f"{m}_variance"), sample_std(v).alias(f"{m}_stdev")]
    return runs.groupBy(*by).agg(*aggs)


def failure_details(runs: DataFrame, by: list[str], success: str = "success", error: str = "error") -> DataFrame:
    """Each failure message of a group with its count. Rows, not a list: a group may fail a billion times."""
    return (runs.where(~F.col(success))
            .groupBy(*by, F.coalesce(error, F.lit("Unknown error")).alias("error"))
            .agg(F.count("*").alias("n")))


def mean_ci(df: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """n, mean, stdev, Student-t interval, min and max. One value, or equal ones, give a point."""
    g = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), sample_std(value).alias("stdev"),
        F.min(value).alias("min"), F.max(value).alias("max")).where("n > 0")
    return _interval(g, confidence)


def _interval(g: DataFrame, confidence: float) -> DataFrame:
    half = F.when((F.col("n") > 1) & (F.col("min") < F.col("max")),
                  t_critical(F.col("n") - 1, confidence) * F.col("stdev") / F.sqrt("n")).otherwise(F.lit(0.0))
    return g.withColumn("ci_lower", F.col("mean") - half).withColumn("ci_upper", F.col("mean") + half)


def value_counts(df: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """The raw values of each group as (value, count) rows: whole, yet bounded by distinct values."""
    return df.groupBy(*by, value).agg(F.count(value).alias(n)).where(F.col(n) > 0)


def metric_panel(runs: DataFrame, by: list[str], metrics: list[str], confidence: float = 0.95) -> DataFrame:
    """`mean_ci` of many metrics in one pass over the runs."""
    g = reshape.agg_dims(runs, by, metrics, {
        "mean": F.avg, "stdev": sample_std, "min": F.min, "max": F.max}, name="metric")
    return _interval(g, confidence)


def dim_stats(runs: DataFrame, by: list[str], dims: list[str], population: bool = False) -> DataFrame:
    """Mean and standard deviation per dimension; one value has deviation 0."""
    std = F.stddev_pop if population else sample_std
    return reshape.agg_dims(runs, by, dims, {"mean": F.avg, "std": std})


def macro_mean(runs: DataFrame, outer: list[str], inner: list[str], dims: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """Mean over the inner groups of their means, so that each task counts the same; `sums` adds sums over all runs of the outer group."""
    means = reshape.agg_dims(runs, [*outer, *inner], dims, {"mean": F.avg}, sums=sums, sums_by=outer)
    return means.groupBy(*outer, *(sums or {}), "dimension").agg(F.avg("mean").alias("macro_mean"), F.count("*").alias("groups"))


def grid_mean(runs: DataFrame, axes: list[str], dims: list[str], fill: float | None = 0.0, summed: bool = False) -> DataFrame:
    """Mean per cell of the full grid of axis values and dimensions; cells without runs get `fill`.

    The grid is spanned from the distinct values of each axis of the aggregated cells, which are
    the names of models and profiles, not runs. `summed` tells that `runs` are cells of `reshape.cell_sums`.
    """
    cells = reshape.agg_dims(runs, axes, dims, {"value": F.try_divide if summed else F.avg}, summed=summed).drop("n")
    if fill is None:
        return cells
    cells = pin(cells, "grid")
    names = cells.agg(*[F.collect_set(a).alias(a) for a in axes])
    grid = names
    for i, a in enumerate(axes):
        grid = grid.withColumn(a, F.explode(a))
        grid = grid.repartition(a) if i == 0 else grid
    grid = grid.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dims])))
    return grid.join(cells, [*axes, "dimension"], "left").withColumn(
        "value", F.coalesce("value", F.lit(float(fill))))


def quality(runs: DataFrame, by: list[str], score: str = "quality", tokens: str = "token_count", summed: bool = False) -> DataFrame:
    """Mean run quality (0 without any scored run) beside the tokens of all runs, failed ones included.

    `summed` tells that `runs` are cells of `reshape.cell_sums`.
    """
    scored = F.sum(f"`{score}.n`") if summed else F.count(score)
    return runs.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(score), scored) if summed else F.avg(score), F.lit(0.0)).alias("quality"),
        scored.alias("scored_runs"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"))


def heatmap(runs: DataFrame, rows: str, cols: str, values: list[str], score: str) -> DataFrame:
    """Rows by columns pivot of mean quality; missing cells are 0."""
    return runs.groupBy(rows).pivot(cols, values).agg(F.avg(score)).fillna(0.0, values)


def run_health(runs: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """Totals, failure rate and the most frequent error messages with their counts."""
    per_error = pin(runs.groupBy(*by, F.when(~F.col("success"), F.col("error")).alias("error")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed")), "errors")
    totals = per_error.groupBy(*by).agg(
        F.sum("n").alias("total_runs"), F.sum("failed").alias("failed_runs"))
    from .ranking import top_k
    errors = top_k(per_error.where(F.col("error").isNotNull() & (F.col("failed") > 0)), by,
                   [F.col("failed").desc(), F.col("error")], top)
    common = errors.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "error", "failed"))),
        lambda e: F.concat(e["error"], F.lit(" x"), e["failed"].cast("string"))), "; ").alias("common_errors"))
    return (totals.join(common, by, "left")
            .withColumn("failure_rate", ratio("failed_runs", "total_runs", 0.0))
            .withColumn("common_errors", F.coalesce("common_errors", F.lit(""))))


def summary_matrix(runs: DataFrame, by: list[str], task: str, metrics: list[str]) -> DataFrame:
    """Mean over tasks of the per-task means, and the number of tasks."""
    per_task = execution_stats(runs, [*by, task], metrics)
    return per_task.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        *[F.avg(f"{m}_mean").alias(f"avg_{m}") for m in metrics],
        F.avg("success_rate").alias("avg_success_rate"))


def cv_pct(df: DataFrame, by: list[str], value: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), sample_std(value).alias("stdev"))
    return g.withColumn("cv_pct", ratio("stdev", "mean", 0.0) * 100.0)


def usage_ratio(groups: DataFrame, name: str, tokens: str, by: list[str] | None = None,
                threshold: float = 1.1) -> DataFrame:
    """Most and least expensive group, where the one costs clearly more than the other."""
    by = by or []
    hi = F.struct(F.col(tokens).alias("t"), F.col(name).alias("n"))
    out = groups.groupBy(*by).agg(
        F.min(hi).alias("_lo"), F.max(hi).alias("_hi"), F.count("*").alias("_n"))
    return out.where("_n >= 2 AND _lo.t > 0 AND _hi.t > 0").select(
        *by, F.col("_lo.n").alias("cheapest"), F.col("_lo.t").alias("cheapest_tokens"),
        F.col("_hi.n").alias("most_expensive"), F.col("_hi.t").alias("most_expensive_tokens"),
        (F.col("_hi.t") / F.col("_lo.t")).alias("usage_ratio")).where(F.col("usage_ratio") > threshold)


def category_quality(runs: DataFrame, entity: str, task: str = "task", score: str = "quality") -> DataFrame:
    """Mean quality per task category and entity, with the number of distinct tasks of the category."""
    cells = runs.withColumn("category", labels.task_category(task)).groupBy("category", entity, task).agg(
        F.sum(score).alias("_s"), F.count(score).alias("_n"))
    # A task counts at the first of its entities, so sums over entities count each task once and no names are gathered.
    first = F.row_number().over(Window.partitionBy("category", task).orderBy(entity)) == 1
    means = cells.withColumn("_new", first.cast("int")).groupBy("category", entity).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("n"), F.sum("_new").alias("_new"))
    counted = means.withColumn("task_count", F.sum("_new").over(Window.partitionBy("category"))).where("n > 0")
    return counted.select("category", entity, (F.col("_s") / F.col("n")).alias("quality"), "n", "task_count")


def with_cost(runs: DataFrame, pricing: DataFrame, default: tuple[float, float],
              tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    """Add the cost of each run; models without a price pay the default."""
    from ..functions.scoring import run_cost
    priced = runs.join(pricing, "model", "left")
    return priced.withColumn("cost", run_cost(
        tokens_in, tokens_out,
        F.coalesce("price_in", F.lit(default[0])), F.coalesce("price_out", F.lit(default[1])),
    )).drop("price_in", "price_out")


def cost_by_model(runs: DataFrame, pricing: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Cost per model and in total. Cost is linear in tokens, so tokens are summed before pricing."""
    sums = runs.groupBy("model").agg(
        F.count("*").alias("runs"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))
    costs = with_cost(sums, pricing, default)
    return costs.rollup("model").agg(
        F.sum("runs").alias("runs"), F.sum("cost").alias("cost")).withColumn(
        "model", F.coalesce("model", F.lit("total")))


def estimate_cost(matrix: DataFrame, pricing: DataFrame, default: tuple[float, float],
                  input_tokens: int = 4000, output_tokens: int = 2000) -> DataFrame:
    """Expected cost per model and in total of a planned run matrix (one row per run)."""
    sized = matrix.select("model", F.lit(input_tokens).cast("bigint").alias("input_tokens"),
                          F.lit(output_tokens).cast("bigint").alias("output_tokens"))
    return cost_by_model(sized, pricing, default)


def plan_summary(matrix: DataFrame, done: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Size of a planned matrix: distinct names, repetitions, runs, and how many are already done."""
    marked = matrix.join(done.select(*on).distinct().withColumn("_done", F.lit(True)), on, "left")
    g = marked.groupBy(*by).agg(
        F.countDistinct("task").alias("tasks"), F.countDistinct("profile").alias("profiles"),
        F.countDistinct("model").alias("models"), F.count("*").alias("total_runs"),
        F.count_if(F.col("_done")).alias("skipped"))
    combos = F.col("tasks") * F.col("profiles") * F.col("models")
    return g.withColumn("reps", F.floor(F.col("total_runs") / combos)).withColumn(
        "runs_per_model", F.floor(F.col("total_runs") / F.col("models")))


def dimensions(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Sorted distinct names of each column as one comma-separated text."""
    g = df.groupBy(*(by or []))
    return g.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in cols])
