"""Report frames: summaries, generated sentences and the series behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import round_to
from ..session import pin
from . import aggregates, ranking, reshape


def entry_summary(quality: DataFrame, entity: str, by: list[str], control=None, score: str = "quality",
                  tokens: str = "total_tokens") -> DataFrame:
    """Best and worst entity, spread, efficiency winner, and the gain over the control where there is one."""
    s = F.round(score, 9)
    best = F.min_by(F.struct(entity, score), F.struct((-s).alias("s"), F.col(entity).alias("e"))).alias("_b")
    worst = F.min_by(F.struct(entity, score), F.struct(s.alias("s"), F.col(entity).alias("e"))).alias("_w")
    usable = (F.col(tokens) > 0) & (F.col(score) > 0)
    per_token = F.round(F.when(usable, F.col(score) / F.col(tokens)) * 1e9, 9)
    winner = F.min_by(F.when(usable, F.col(entity)), F.when(
        usable, F.struct((-per_token).alias("s"), F.col(entity).alias("e")))).alias("efficiency_winner")
    g = quality.groupBy(*by).agg(
        best, worst, winner, F.count("*").alias("run_count"),
        F.max(F.when(F.col(entity) == control, F.col(score))).alias("control_score"))
    gain = F.col("best_score") - F.coalesce("control_score", F.lit(0.0))
    return g.select(
        *by, F.col(f"_b.{entity}").alias("best_run"), F.col(f"_b.{score}").alias("best_score"),
        F.col(f"_w.{entity}").alias("worst_run"), F.col(f"_w.{score}").alias("worst_score"),
        "efficiency_winner", "run_count", "control_score").withColumns({
            "spread": F.col("best_score") - F.col("worst_score"),
            "improvement_delta": gain,
            "improvement_pct": F.when(F.col("control_score") > 0, gain / F.col("control_score") * 100.0).otherwise(0.0)})


def _finding(kind: str, subject: Column, value: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"),
                    value.cast("double").alias("value"), text.alias("text"))


def _rows(df: DataFrame, by: list[str], findings: list[tuple[Column, Column]]) -> DataFrame:
    """Explode the findings whose condition holds into one row each."""
    items = F.array_compact(F.array(*[F.when(cond, f) for cond, f in findings]))
    return df.select(*by, F.explode(items).alias("_f")).select(*by, "_f.*")


def quality_findings(quality: DataFrame, by: list[str], entity: str, baseline=None, score: str = "quality",
                     tokens: str = "total_tokens") -> DataFrame:
    """Sentences on the best entity and its tier, the token winner, the spread, and who beats the baseline."""
    quality = pin(quality, "quality")
    s = entry_summary(quality, entity, by, control=baseline, score=score, tokens=tokens)
    q = F.round(score, 9)
    control = F.max(F.when(F.col(entity) == baseline, q))
    base = quality.groupBy(*by).agg(control.alias("_c"))
    better = (quality.join(base, by).where((F.col(entity) != baseline) & (q > F.col("_c")))
              .groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(entity)), ", ").alias("_names"), F.count("*").alias("_n")))
    tw = quality.select(*by, F.col(entity).alias("efficiency_winner"), F.col(score).alias("_tw_score"))
    df = s.join(tw, [*by, "efficiency_winner"], "left").join(better, by, "left")
    fmt = F.format_string
    same = F.col("efficiency_winner") == F.col("best_run")
    band = F.when(F.col("spread") < 5, "minimal").when(F.col("spread") < 15, "moderate").otherwise("significant")
    several = F.col("run_count") >= 2
    has_base = F.col("control_score").isNotNull() & several
    n = F.coalesce("_n", F.lit(0))
    best = F.col("best_run").cast("string")
    return _rows(df, by, [
        (F.lit(True), _finding("best", F.col("best_run"), F.col("best_score"),
                               fmt("%s scored %.1f of 100 overall: %s", best, "best_score", labels.score_tier("best_score")))),
        (same, _finding("token_winner", F.col("best_run"), F.col("best_score"),
                        fmt("%s is also the most token-efficient", best))),
        (~same, _finding("token_winner", F.col("efficiency_winner"), F.col("_tw_score"),
                         fmt("%s is the most token-efficient (%.1f of 100), not %s",
                             F.col("efficiency_winner").cast("string"), "_tw_score", best))),
        (several, _finding("spread", best, F.col("spread"), fmt("Quality spread of %.1f points: %s differences", "spread", band))),
        (has_base & (n > 0), _finding("beats_baseline", F.col("_names"), n, fmt("%d beat the baseline: %s", n, "_names"))),
        (has_base & (n == 0), _finding("beats_baseline", F.lit(None), n, F.lit("None beats the baseline"))),
    ])


def regression_findings(regressions: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """One line per flagged regression, and one with their number and the entities concerned."""
    regressions = pin(regressions, "regressions")
    flagged = regressions.where("is_regression")
    line = F.format_string("%s on %s/%s: %+.1f%% (p=%.3f)", entity, "task", "dimension", F.col("delta_pct") * 100.0, "p_value")
    lines = flagged.select(*by, F.lit("regression").alias("kind"), F.col(entity).alias("subject"),
                           F.col("delta_pct").alias("value"), line.alias("text"))
    summary = regressions.groupBy(*by).agg(
        F.count_if("is_regression").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_regression"), F.col(entity)))), ", ").alias("names"),
        F.countDistinct(F.when(F.col("is_regression"), F.col(entity))).alias("k"))
    total = summary.select(
        *by, F.lit("regression_count").alias("kind"), F.nullif("names", F.lit("")).alias("subject"),
        F.col("n").cast("double").alias("value"),
        F.when(F.col("n") > 0, F.format_string("%d regression(s) in %d profile(s): %s", "n", "k", "names"))
        .otherwise("No regressions detected").alias("text"))
    return lines.unionByName(total)


def experiment_findings(table: DataFrame, quality: DataFrame, by: list[str], entity: str,
                        score: str = "quality", tokens: str = "total_tokens") -> DataFrame:
    """Sentences on an experiment: best variant, spread, significant variants or their absence, token use.

    `table` is the output of `variant_table`, `quality` has one row per variant, control included.
    """
    quality, table = pin(quality, "quality"), pin(table, "variants")
    s = entry_summary(quality, entity, by, score=score, tokens=tokens)
    weak = ~F.col("is_significant") & (F.col("power") < 0.8) if "power" in table.columns else F.lit(False)
    counts = table.groupBy(*by).agg(F.count_if("is_significant").alias("_sig"), F.count_if(weak).alias("_weak"), F.count("*").alias("_rows"))
    df = s.join(counts, by, "left")
    fmt = F.format_string
    best = F.col("best_run").cast("string")
    head = _rows(df, by, [
        (F.col("best_score") > 0, _finding("best", best, F.col("best_score"), fmt("Best variant: %s with %.1f", best, "best_score"))),
        ((F.col("run_count") > 1) & (F.col("spread") > 1.0), _finding(
            "spread", best, F.col("spread"), fmt("Spread across variants: %.1f points (%s over %s)", "spread", best, F.col("worst_run").cast("string")))),
        (F.col("_sig") == 0, _finding("no_difference", F.lit(None), F.lit(0.0), F.lit("No significant differences between variants"))),
        ((F.col("_sig") == 0) & (F.col("_weak") > 0), _finding(
            "underpowered", F.lit(None), F.col("_weak"), fmt("%d of %d comparisons have power below 80%%", "_weak", "_rows"))),
    ])
    direction = F.when(F.col("delta") > 0, "higher").otherwise("lower")
    sig = table.where("is_significant").select(
        *by, F.lit("significant").alias("kind"), F.col(entity).alias("subject"), F.col("delta").alias("value"),
        fmt("%s scored %.1f points %s than control (p=%.3f, d=%.2f)", entity, F.abs("delta"), direction, "p_value", "effect_size").alias("text"))
    return head.unionByName(sig).unionByName(token_findings(quality, by, entity, tokens))


def token_findings(quality: DataFrame, by: list[str], entity: str, tokens: str = "total_tokens") -> DataFrame:
    ratio_rows = aggregates.usage_ratio(quality, entity, tokens, by)
    return ratio_rows.select(
        *by, F.lit("token_usage").alias("kind"), F.col("most_expensive").cast("string").alias("subject"),
        F.col("usage_ratio").alias("value"),
        F.format_string("Token usage varies %.1fx (%s: %d, %s: %d)", "usage_ratio", F.col("cheapest").cast("string"), "cheapest_tokens",
                        F.col("most_expensive").cast("string"), "most_expensive_tokens").alias("text"))


def comparison_findings(comparisons: DataFrame, quality: DataFrame, by: list[str], entity: str,
                        score: str = "quality", tokens: str = "total_tokens") -> DataFrame:
    """Sentences on a comparison of run sets: best, spread, significant differences per dimension, token use."""
    quality, comparisons = pin(quality, "quality"), pin(comparisons, "comparisons")
    s = entry_summary(quality, entity, by, score=score, tokens=tokens)
    sums = comparisons.groupBy(*by).agg(F.count_if("is_significant").alias("_sig"))
    fmt = F.format_string
    best = F.col("best_run").cast("string")
    head = _rows(s.join(sums, by, "left"), by, [
        (F.lit(True), _finding("best", best, F.col("best_score"), fmt("Best run set: %s with %.1f", best, "best_score"))),
        ((F.col("run_count") > 1) & (F.col("spread") > 0.5), _finding(
            "spread", best, F.col("spread"), fmt("Spread across run sets: %.1f points (%s over %s)", "spread", best, F.col("worst_run").cast("string")))),
        (F.coalesce("_sig", F.lit(0)) == 0, _finding("no_difference", F.lit(None), F.lit(0.0), F.lit("No significant differences between run sets"))),
    ])
    per_dim = comparisons.where("is_significant").groupBy(*by, "dimension").agg(F.count("*").alias("n")).select(
        *by, F.lit("significant").alias("kind"), F.col("dimension").alias("subject"), F.col("n").cast("double").alias("value"),
        fmt("%d significant difference(s) in %s", "n", labels.dimension_label("dimension")).alias("text"))
    return head.unionByName(per_dim).unionByName(token_findings(quality, by, entity, tokens))


def radar_series(runs: DataFrame, dims: list[str], summed: bool = False) -> DataFrame:
    """Value per model, profile and dimension; cells without runs are 0. For `summed` see `aggregates.grid_mean`."""
    grid = aggregates.grid_mean(runs, ["model", "profile"], dims, summed=summed)
    return grid.select("model", "profile", labels.dimension_label("dimension").alias("axis"), "value")


def bar_series(runs: DataFrame, dims: list[str], summed: bool = False) -> DataFrame:
    """Value per dimension, profile and task; cells without runs are 0. For `summed` see `aggregates.grid_mean`."""
    return aggregates.grid_mean(runs, ["profile", "task"], dims, summed=summed).select("dimension", "profile", "task", "value")


def scatter_series(quality: DataFrame, entity: str, by: list[str] | None = None) -> DataFrame:
    """Tokens and quality per entity, marked where on the efficient frontier."""
    return ranking.frontier(quality, "total_tokens", "quality", by or [], keep_all=True)


def comparison_pairs(means: DataFrame, on: list[str], entity: str, dim: str = "dimension", value: str = "mean") -> DataFrame:
    """Scores of each two entities beside each other, their tiers and the difference as text."""
    from . import joins
    pairs = joins.pairwise(means, entity, [*on, dim], [value])
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return pairs.withColumns({
        "tier_a": labels.score_tier(a), "tier_b": labels.score_tier(b),
        "delta": F.coalesce(F.format_string("%+.1f", round_to(b - a, 1)), F.lit("-"))})


def comparison_document(means: DataFrame, on: list[str], entity: str, dim: str = "dimension", value: str = "mean") -> DataFrame:
    """One JSON per key: entity to dimension to score. Built from group means, so it stays small."""
    inner = means.groupBy(*on, entity).agg(F.array_sort(F.collect_list(F.struct(dim, value))).alias("_s"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct(entity, "_s"))),
                          lambda e: F.struct(e[entity], F.map_from_entries(e["_s"])))
    return inner.groupBy(*on).agg(F.to_json(F.map_from_entries(entries)).alias("scores"))


def comparison_rows(comparisons: DataFrame, entity: str) -> DataFrame:
    """Display form of `compare_run_sets`."""
    return comparisons.select(
        F.concat_ws("/", "model", "profile", "task").alias("key"), "dimension",
        F.col(f"{entity}_a").cast("string").alias("run_a"), round_to("mean_a", 2).alias("run_a_mean"),
        F.col(f"{entity}_b").cast("string").alias("run_b"), round_to("mean_b", 2).alias("run_b_mean"),
        labels.signed_pct("delta_pct").alias("delta_pct"), round_to("p_value", 4).alias("p_value"),
        "effect_label", "is_significant")


def report_metadata(runs: DataFrame, by: list[str], date: Column, planned: DataFrame | None = None) -> DataFrame:
    """Date, names and sizes of a report; the number of profiles is counted, the planned one kept beside it."""
    g = runs.groupBy(*by).agg(
        F.max(date).alias("date"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("variant_label")), ",").alias("variants"),
        F.countDistinct("profile").alias("profile_count"), F.count("*").alias("total_runs"))
    return g if planned is None else g.join(planned, by, "left")


def narrative(quality: DataFrame, categories: DataFrame, regressions: DataFrame, by: list[str], entity: str) -> DataFrame:
    """One compact JSON per report with qualities, tokens, winners, categories and flagged regressions."""
    quality = pin(quality, "quality")
    s = entry_summary(quality, entity, by)
    q = quality.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        F.col(entity).alias("name"), round_to("quality", 2).alias("quality"), F.col("total_tokens").alias("tokens")))).alias("profiles"))
    c = categories.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "category", "winner", round_to("winner_score", 1).alias("winner_score"), round_to("margin", 1).alias("margin")))).alias("category_analysis"))
    r = regressions.where("is_regression").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        F.col(entity).alias("profile"), "task", "dimension", round_to(F.col("delta_pct") * 100.0, 1).alias("delta_pct"),
        round_to("p_value", 3).alias("p_value")))).alias("regressions"))
    df = s.join(q, by, "left").join(c, by, "left").join(r, by, "left")
    best = F.struct(F.col("best_run").alias("profile"), round_to("best_score", 1).alias("score"))
    return df.select(*by, F.to_json(F.struct(
        best.alias("best_profile_overall"), F.col("efficiency_winner").alias("token_efficiency_winner"),
        F.col("profiles"), F.col("category_analysis"),
        F.coalesce("regressions", F.array().cast(r.schema["regressions"].dataType)).alias("regressions"))).alias("context"))


def drilldown(runs: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The best run of each group taken apart, with the range of all runs of the group beside it."""
    keep = ["tests_passed", "tests_total", "test_pass_rate", "lint_score", "lint_errors", "complexity_score",
            "avg_complexity", "llm_quality", "judge_avg", "token_count", "composite", "static_total", "loc"]
    best = ranking.best_row(runs, by, "composite", ties, keep)
    spread = aggregates.mean_ci(runs, by, "composite").select(
        *by, F.struct("n", "mean", "stdev", F.col("min").alias("low"), F.col("max").alias("high")).alias("_runs"))
    part = lambda **cols: F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    detail = F.struct(
        (F.col("loc") > 0).alias("has_output"),
        part(passed="tests_passed", total="tests_total", pass_rate="test_pass_rate").alias("tests"),
        part(score="lint_score", errors="lint_errors").alias("lint"),
        part(score="complexity_score", avg="avg_complexity").alias("complexity"),
        part(normalized="llm_quality", average="judge_avg").alias("judge"),
        F.col("token_count").alias("tokens"), F.col("composite"), F.col("static_total"),
        ranking.weakest([("tests", "test_pass_rate"), ("lint", "lint_score"), ("complexity", "complexity_score"),
                         ("judge", "llm_quality")]).alias("weakest"),
        F.col("_runs").alias("runs"))
    return best.join(spread, by, "left").select(*by, detail.alias("d"))
