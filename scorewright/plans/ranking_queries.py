"""Leaderboards, winners, frontiers, corrections and samples over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import aggregates, prefix, ranking
from ..session import pin
from .aggregating_queries import r
from .bindings import BASELINE, DIMS, LONG_CTE, QUALITY_CTE, RUNS_CTE, SCORED_CTE
from .joining_queries import _BEST_CTE, best_runs
from .registry import query, rnd

_GRID_CTE = LONG_CTE + """, grid AS (SELECT model, profile, dimension, avg(score) AS value FROM run_scores GROUP BY 1, 2, 3)"""


@query("comparison_table", f"""WITH {_GRID_CTE}, a AS (
  SELECT *, value - max(value) OVER (PARTITION BY model, dimension) AS delta, avg(value) OVER (PARTITION BY model, profile) AS av FROM grid),
 k AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY round(av, 9) DESC, profile) AS rank FROM a)
SELECT model, profile, dimension, {rnd('value', 4)} AS value, {rnd('delta', 4)} AS delta, abs(delta) < 0.005 AS is_best, {rnd('av', 4)} AS avg, CAST(rank AS INT) AS rank FROM k""")
def comparison_table(t):
    grid = aggregates.grid_mean(t.scored, ["model", "profile"], DIMS)
    return ranking.leaderboard(grid, ["model"], "profile").select(
        "model", "profile", "dimension", r("value"), r("delta"), "is_best", r("avg"), "rank")


@query("best_run", f"""WITH {SCORED_CTE}, {_BEST_CTE}
SELECT model, task, profile, coalesce(composite, 0) AS best_score, k1, k2, k3, k4 FROM best""")
def best_run(t):
    return best_runs(t).select("model", "task", "profile", "best_score", "k1", "k2", "k3", "k4")


_Q2 = QUALITY_CTE + """, q AS (SELECT model, profile, coalesce(avg(quality), 0) AS quality, sum(token_count) AS tokens FROM quality GROUP BY 1, 2),
 qp AS (SELECT profile, coalesce(avg(quality), 0) AS quality, sum(token_count) AS tokens FROM quality GROUP BY 1)"""


@query("best_profile", f"""WITH {_Q2}
SELECT 'overall' AS scope, '' AS model, profile, quality FROM (SELECT profile, {rnd('quality', 6)} AS quality FROM qp ORDER BY round(qp.quality, 9) DESC, profile LIMIT 1)
UNION ALL SELECT 'mean_over_models', '', profile, quality FROM (SELECT profile, {rnd('avg(quality)', 6)} AS quality FROM q GROUP BY profile ORDER BY round(avg(q.quality), 9) DESC, profile LIMIT 1)
UNION ALL SELECT 'best_pair', model, profile, quality FROM (SELECT model, profile, {rnd('quality', 6)} AS quality FROM q ORDER BY round(q.quality, 9) DESC, model || '/' || profile LIMIT 1)""")
def best_profile(t):
    """Three winners from one aggregation at model x profile level."""
    fine = t.quality.groupBy("model", "profile").agg(F.sum("quality").alias("s"), F.count("quality").alias("n"))
    fine = pin(fine.withColumn("quality", F.coalesce(F.try_divide("s", "n"), F.lit(0.0))), "fine")
    per_profile = fine.groupBy("profile").agg(
        F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("quality"), F.avg("quality").alias("macro"))
    overall = ranking.winners(per_profile, "profile", "quality")
    macro = ranking.winners(per_profile.select("profile", F.col("macro").alias("quality")), "profile", "quality")
    named = fine.withColumn("name", F.concat_ws("/", "model", "profile"))
    pair = ranking.top_one(named, "quality", "name", ["model", "profile", "quality"])
    out = [overall.select(F.lit("overall").alias("scope"), F.lit("").alias("model"), "profile", "quality"),
           macro.select(F.lit("mean_over_models").alias("scope"), F.lit("").alias("model"), "profile", "quality"),
           pair.select(F.lit("best_pair").alias("scope"), "model", "profile", "quality")]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("quality", round_to("quality", 6))


@query("token_winner", f"""WITH {QUALITY_CTE}, q AS (SELECT run_set, model, profile, avg(quality) AS quality, sum(token_count) AS tokens FROM quality GROUP BY 1, 2, 3)
SELECT run_set, model, profile, {rnd('quality', 6)} AS quality, {rnd('quality / tokens * 1e6', 6)} AS points_per_million FROM (
  SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY round(quality / tokens * 1e9, 9) DESC, model || '/' || profile) AS rn FROM q WHERE tokens > 0 AND quality > 0) WHERE rn = 1""")
def token_winner(t):
    q = aggregates.quality(t.quality, ["run_set", "model", "profile"]).withColumn("name", F.concat_ws("/", "model", "profile"))
    w = ranking.efficiency_winner(q, "name", "quality", "total_tokens", ["model", "profile", "quality"], ["run_set"])
    return w.select("run_set", "model", "profile", r("quality", 6),
                    round_to(F.col("score_per_token") * 1e6, 6).alias("points_per_million"))


def _margin_sql(part: str, best: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER w AS rn, lead(profile) OVER w AS ru, lead(v) OVER w AS ruv,
   max(v) OVER (PARTITION BY {part}) - min(v) OVER (PARTITION BY {part}) AS sp FROM cells WINDOW w AS (PARTITION BY {part} ORDER BY round(v, 9) DESC, profile)),
 top AS ({best})"""


_TOP = "SELECT profile AS best FROM (SELECT profile, avg(quality) AS v FROM quality GROUP BY 1) ORDER BY round(v, 9) DESC, profile LIMIT 1"
_MARGIN_COLS = f"profile AS winner, {rnd('v', 4)} AS winner_score, coalesce(ru, profile) AS runner_up, {rnd('coalesce(ruv, v)', 4)} AS runner_up_score, {rnd('coalesce(v - ruv, 0)', 4)} AS margin, {rnd('sp', 4)} AS spread, profile <> best AS is_exception"


def _with_exception(margins, per_profile):
    best = ranking.top_one(per_profile, "quality", "profile", ["profile"])
    return margins.withColumn("is_exception", F.col("winner") != best.scalar())


def category_frame(t):
    """Per category and per profile from one pass over the runs."""
    cells = pin(aggregates.category_quality(t.quality, "profile"), "cells")
    per_profile = cells.groupBy("profile").agg((F.sum(F.col("quality") * F.col("n")) / F.sum("n")).alias("quality"))
    margins = ranking.winner_margin(cells, ["category"], "profile", "quality")
    tasks = cells.groupBy("category").agg(F.max("task_count").alias("task_count"))
    return _with_exception(margins, per_profile).join(tasks, "category")


@query("category_winner", f"""WITH {QUALITY_CTE}, c AS (SELECT *, regexp_replace(task, '-[0-9]+$', '') AS category FROM quality),
 cells AS (SELECT category, profile, avg(quality) AS v FROM c WHERE quality IS NOT NULL GROUP BY 1, 2),
 tc AS (SELECT category, count(DISTINCT task) AS task_count FROM c GROUP BY 1), {_margin_sql('category', _TOP)}
SELECT ranked.category, {_MARGIN_COLS}, task_count FROM ranked JOIN tc ON ranked.category = tc.category CROSS JOIN top WHERE rn = 1""")
def category_winner(t):
    return category_frame(t).select(
        "category", "winner", r("winner_score"), "runner_up", r("runner_up_score"), r("margin"), r("spread"), "is_exception", "task_count")


@query("model_preference", f"""WITH {QUALITY_CTE}, cells AS (SELECT model, profile, avg(quality) AS v FROM quality WHERE quality IS NOT NULL GROUP BY 1, 2),
 {_margin_sql('model', _TOP)}
SELECT model, {_MARGIN_COLS} FROM ranked CROSS JOIN top WHERE rn = 1""")
def model_preference(t):
    cells = t.quality.groupBy("model", "profile").agg(F.sum("quality").alias("s"), F.count("quality").alias("n")).where("n > 0")
    cells = cells.withColumn("quality", F.col("s") / F.col("n"))
    per_profile = cells.groupBy("profile").agg((F.sum("s") / F.sum("n")).alias("quality"))
    margins = ranking.winner_margin(cells, ["model"], "profile", "quality")
    return _with_exception(margins, per_profile).select(
        "model", "winner", r("winner_score"), "runner_up", r("runner_up_score"), r("margin"), r("spread"), "is_exception")


@query("efficient_frontier", f"""WITH {QUALITY_CTE}, g AS (SELECT run_set, task, sum(token_count)::BIGINT AS tokens, {rnd('avg(quality)', 4)} AS quality FROM quality GROUP BY 1, 2),
 f AS (SELECT *, max(quality) OVER (PARTITION BY run_set ORDER BY tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT run_set, task, tokens, quality, quality > coalesce(before, -1) AS on_frontier FROM f""")
def efficient_frontier(t):
    g = t.quality.groupBy("run_set", "task").agg(F.sum("token_count").alias("tokens"), round_to(F.avg("quality"), 4).alias("quality"))
    return ranking.frontier(g, "tokens", "quality", ["run_set"], keep_all=True)


@query("run_frontier", f"""WITH {SCORED_CTE}, g AS (SELECT model, token_count, max(composite) AS composite FROM scored WHERE composite IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT *, max(composite) OVER (PARTITION BY model ORDER BY token_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT model, token_count, composite FROM f WHERE composite > coalesce(before, -1)""")
def run_frontier(t):
    """Frontier over single runs: too many for one task per model, so the running maximum is split by token range."""
    runs = t.scored.where("success").select("model", "token_count", "composite")
    splits = prefix.range_splits(t.runs.select((F.col("input_tokens") + F.col("output_tokens")).alias("token_count")), "token_count")
    return ranking.frontier(runs, "token_count", "composite", ["model"], splits=splits).distinct()


@query("entry_summary", f"""WITH {QUALITY_CTE}, q AS (SELECT model, run_set, avg(quality) AS v, sum(token_count) AS tk FROM quality GROUP BY 1, 2),
 b AS (SELECT model, arg_max(run_set, v) AS best_run, max(v) AS best, arg_min(run_set, v) AS worst_run, min(v) AS worst, arg_max(run_set, v / tk) AS efficiency_winner, count(*) AS run_count FROM q GROUP BY 1),
 c AS (SELECT model, v AS control FROM q WHERE run_set = 1998)
SELECT b.model, best_run, {rnd('best', 4)} AS best_score, worst_run, {rnd('worst', 4)} AS worst_score, {rnd('best - worst', 4)} AS spread, efficiency_winner, run_count,
  {rnd('best - control', 4)} AS improvement_delta, {rnd('(best - control) / control * 100', 4)} AS improvement_pct FROM b JOIN c ON b.model = c.model""")
def entry_summary(t):
    from ..operators import findings
    q = aggregates.quality(t.quality, ["model", "run_set"])
    s = findings.entry_summary(q, "run_set", ["model"], control=1998)
    return s.select("model", "best_run", r("best_score"), "worst_run", r("worst_score"), r("spread"), "efficiency_winner",
                    "run_count", r("improvement_delta"), r("improvement_pct"))


# p-like numbers for the corrections: one per key, spread over (0, 1).
_P_CTE = RUNS_CTE + """, pv AS (SELECT run_set, model, task, profile, CAST((sum(k1) % 1000) * (sum(k3) % 997) + 1 AS DOUBLE) / 1e6 AS p FROM runs GROUP BY 1, 2, 3, 4)"""


def _p_values(t):
    return t.runs.groupBy("run_set", "model", "task", "profile").agg(
        (((F.sum("k1") % 1000) * (F.sum("k3") % 997) + 1).cast("double") / 1e6).alias("p"))


@query("bonferroni", f"""WITH {_P_CTE}
SELECT run_set, model, task, profile, p, {rnd('least(1.0, p * count(*) OVER (PARTITION BY run_set))', 6)} AS p_bonferroni FROM pv""")
def bonferroni(t):
    return ranking.bonferroni(_p_values(t), "p", ["run_set"]).withColumn("p_bonferroni", round_to("p_bonferroni", 6))


@query("benjamini_hochberg", f"""WITH {_P_CTE}, a AS (
  SELECT *, p * count(*) OVER (PARTITION BY run_set) / row_number() OVER (PARTITION BY run_set ORDER BY p) AS adj, row_number() OVER (PARTITION BY run_set ORDER BY p) AS rk FROM pv)
SELECT run_set, model, task, profile, p, {rnd('least(1.0, min(adj) OVER (PARTITION BY run_set ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 6)} AS p_bh FROM a""")
def benjamini_hochberg(t):
    return ranking.benjamini_hochberg(_p_values(t), "p", ["run_set"]).withColumn("p_bh", round_to("p_bh", 6))


@query("mid_rank", f"""WITH {SCORED_CTE}, x AS (SELECT model, profile, composite AS value, rank() OVER (PARTITION BY model, profile ORDER BY composite) AS rk,
  count(*) OVER (PARTITION BY model, profile, composite) AS n FROM scored WHERE composite IS NOT NULL)
SELECT DISTINCT model, profile, value, n, rk + (n - 1) / 2.0 AS mid_rank FROM x""")
def mid_rank(t):
    counts = aggregates.value_counts(t.scored, ["model", "profile"], "composite").withColumnRenamed("composite", "value")
    return prefix.mid_ranks(counts, ["model", "profile"], "value")


_CAP = 40.0


@query("cumulative_cost_cap", f"""WITH {RUNS_CTE}, o AS (SELECT run_set, k1, sum(input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15) AS cost, count(*) AS n FROM runs GROUP BY 1, 2),
 c AS (SELECT *, sum(cost) OVER (PARTITION BY run_set ORDER BY k1 ROWS UNBOUNDED PRECEDING) AS total FROM o)
SELECT run_set, k1, n, {rnd('total', 4)} AS running_cost, {rnd('total', 6)} >= {_CAP} AS cap_reached, {rnd('total - cost', 6)} < {_CAP} AS started FROM c""")
def cumulative_cost_cap(t):
    """Orders complete one after the other; their runs are summed first, then totals run by range of orders."""
    orders = t.runs.groupBy("run_set", "k1").agg(
        F.sum(F.col("input_tokens") / 1e6 * 3 + F.col("output_tokens") / 1e6 * 15).alias("cost"), F.count("*").alias("n"))
    splits = prefix.range_splits(t.orders, "o_orderkey")
    capped = ranking.cost_cap(orders, ["run_set"], ["k1"], "cost", _CAP, splits)
    return capped.select("run_set", "k1", "n", r("running_cost"),
                         (round_to("running_cost", 6) >= _CAP).alias("cap_reached"),
                         (round_to(F.col("running_cost") - F.col("cost"), 6) < _CAP).alias("started"))


@query("assign_ids", """WITH x AS (SELECT 'run-' || lpad(CAST(k AS VARCHAR), 3, '0') AS run_id FROM (SELECT max(p_size) AS k FROM part)), n AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(CAST(regexp_extract(run_id, '([0-9]+)', 1) AS INT)) FROM x) AS k FROM orders)
SELECT o_orderkey, 'run-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS run_id FROM n""")
def assign_ids(t):
    size = F.col("p_size").cast("string")
    existing = t.part.select(F.explode(F.array(
        F.concat(F.lit("run-"), F.lpad(size, 3, "0")), F.lit("run-legacy"), F.concat(F.lit("old-9"), size))).alias("run_id"))
    new = t.orders.select("o_orderkey")
    return ranking.assign_ids(new, existing, "run_id", ["o_orderkey"], splits=prefix.range_splits(new, "o_orderkey"))


@query("weakest_dimension", f"""WITH {SCORED_CTE}
SELECT CASE least(test_pass_rate, lint_score, complexity_score, llm_quality) WHEN test_pass_rate THEN 'tests' WHEN lint_score THEN 'lint'
   WHEN complexity_score THEN 'complexity' ELSE 'judge' END AS weakest, profile, count(*) AS n FROM scored WHERE success GROUP BY 1, 2""")
def weakest_dimension(t):
    w = ranking.weakest([("tests", "test_pass_rate"), ("lint", "lint_score"), ("complexity", "complexity_score"), ("judge", "llm_quality")])
    return t.scored.where("success").groupBy(w.alias("weakest"), "profile").agg(F.count("*").alias("n"))


@query("top_k_details", f"""WITH {RUNS_CTE}, x AS (SELECT task, k1, k2, k3, k4, output_tokens, avg_complexity, row_number() OVER (PARTITION BY task ORDER BY avg_complexity DESC, k1, k2, k3, k4, output_tokens) AS rank,
   count(*) OVER (PARTITION BY task) AS n FROM runs)
SELECT task, k1, k2, k3, k4, avg_complexity, CAST(rank AS INT) AS rank, greatest(0, n - 8) AS n_more FROM x WHERE rank <= 8""")
def top_k_details(t):
    runs = t.runs.select("task", "k1", "k2", "k3", "k4", "output_tokens", "avg_complexity")
    top = ranking.top_k(runs, ["task"], [F.col("avg_complexity").desc(), "k1", "k2", "k3", "k4", "output_tokens"], 8)
    return top.drop("output_tokens")


@query("systematic_sample", """WITH x AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT * FROM x WHERE position % greatest(1, total // 10) = 0 OR position = total""")
def systematic_sample(t):
    events = t.events.select("event_type", "event_id")
    return ranking.systematic_sample(events, ["event_type"], ["event_id"], splits=prefix.range_splits(events, "event_id"))
