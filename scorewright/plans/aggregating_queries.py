"""Group statistics, filters and multi-level rollups over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import round_to
from ..operators import aggregates, filters, joins, ranking, reshape, rollups
from .bindings import CRITERIA, DEFAULT_PRICE, DIMS, LONG_CTE, PRICES_CTE, QUALITY_CTE, RUNS_CTE, SCORED_CTE
from .registry import query, rnd


def r(c, digits=4, name=None):
    return round_to(c, digits).alias(name or c)


def t_crit_ctes(source: str) -> str:
    """Two-sided 95 % points of Student's t for n - 1 degrees of freedom, by bisection over Simpson's rule.

    With t = sqrt(df) tan(x) the density is a power of a cosine.
    """
    inner = ("list_sum(list_transform(range(0, 201), lambda i: CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
             "* exp((v - 1) * ln(cos(m * i / 200))))) * m / 300 / (sqrt(pi()) * exp(lgamma(v / 2) - lgamma((v + 1) / 2)))")
    return f"""bisected AS (
  SELECT CAST(n - 1 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS lo, least(pi() / 2, 8 / sqrt(n - 1)) AS hi, 0 AS step FROM (SELECT DISTINCT n FROM {source} WHERE n > 1)
  UNION ALL SELECT v, CASE WHEN {inner} < 0.95 THEN m ELSE lo END, CASE WHEN {inner} < 0.95 THEN hi ELSE m END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS m FROM bisected WHERE step < 48)),
 crit AS (SELECT v + 1 AS crit_n, sqrt(v) * tan((lo + hi) / 2) AS crit FROM bisected WHERE step = 48)"""


def samp(fn: str, x: str) -> str:
    return f"coalesce({fn}({x}), CASE WHEN count({x}) > 0 THEN 0.0 END)"


_EXEC = ["duration_seconds", "input_tokens", "output_tokens", "cost"]


@query("execution_aggregate", f"""WITH {RUNS_CTE}, {PRICES_CTE}, x AS (SELECT r.*, CASE WHEN success THEN 1 END AS ok, input_tokens / 1e6 * coalesce(price_in, 3.0) + output_tokens / 1e6 * coalesce(price_out, 15.0) AS cost FROM runs r LEFT JOIN pricing p ON r.model = p.model)
SELECT task, profile, model, count(*) AS total_runs, count(ok) AS successful_runs, count(*) - count(ok) AS failed_runs,
  {rnd("count(ok) / count(*)", 6)} AS success_rate, """ + ", ".join(
    f"{rnd(f'avg({m} * ok)', 4)} AS {m}_mean, {rnd(samp('var_samp', f'{m} * ok'), 3)} AS {m}_variance, {rnd(samp('stddev_samp', f'{m} * ok'), 4)} AS {m}_stdev"
    for m in _EXEC) + " FROM x GROUP BY 1, 2, 3")
def execution_aggregate(t):
    g = aggregates.execution_stats(aggregates.with_cost(t.runs, t.pricing, DEFAULT_PRICE), ["task", "profile", "model"], _EXEC)
    return g.select("task", "profile", "model", "total_runs", "successful_runs", "failed_runs", r("success_rate", 6),
                    *[r(f"{m}_{s}", d) for m in _EXEC for s, d in [("mean", 4), ("variance", 3), ("stdev", 4)]])


@query("execution_failures", f"""WITH {RUNS_CTE}
SELECT task, profile, model, coalesce(CASE WHEN k2 <> 5 THEN error END, 'Unknown error') AS error, count(*) AS n
FROM runs WHERE NOT success GROUP BY 1, 2, 3, 4""")
def execution_failures(t):
    runs = t.runs.withColumn("error", F.when(F.col("k2") != 5, F.col("error")))
    return aggregates.failure_details(runs, ["task", "profile", "model"])


@query("mean_ci", f"""WITH RECURSIVE {SCORED_CTE}, g AS (
  SELECT task, profile, model, run_set, count(composite) AS n, avg(composite) AS mean, {samp('stddev_samp', 'composite')} AS stdev,
         min(composite) AS min, max(composite) AS max FROM scored WHERE composite IS NOT NULL GROUP BY 1, 2, 3, 4),
 {t_crit_ctes('g')},
 h AS (SELECT g.*, CASE WHEN n > 1 AND min < max THEN crit * stdev / sqrt(n) ELSE 0 END AS half FROM g LEFT JOIN crit ON n = crit_n)
SELECT task, profile, model, run_set, n, {rnd('mean', 4)} AS mean, {rnd('stdev', 4)} AS stdev, min, max,
       {rnd('mean - half', 4)} AS ci_lower, {rnd('mean + half', 4)} AS ci_upper FROM h""")
def mean_ci(t):
    g = aggregates.mean_ci(t.scored, ["task", "profile", "model", "run_set"], "composite")
    return g.select("task", "profile", "model", "run_set", "n", r("mean"), r("stdev"), "min", "max", r("ci_lower"), r("ci_upper"))


@query("value_counts", f"""WITH {SCORED_CTE}
SELECT profile, composite AS value, count(*) AS n FROM scored WHERE composite IS NOT NULL GROUP BY 1, 2""")
def value_counts(t):
    return aggregates.value_counts(t.scored, ["profile"], "composite").withColumnRenamed("composite", "value")


_PANEL = ["composite", "static_total", "test_pass_rate", "lint_score", "complexity_score", "llm_quality", *CRITERIA, "points_per_1k"]


def _panel_value(m):
    if m in CRITERIA:
        return f"CASE WHEN success THEN {m} END"
    return {"points_per_1k": rnd("composite / token_count * 1000", 2)}.get(m, m)


@query("metric_panel", f"WITH RECURSIVE {SCORED_CTE}, long AS (" + " UNION ALL ".join(
    f"SELECT task, profile, model, '{m}' AS metric, CAST({_panel_value(m)} AS DOUBLE) AS v FROM scored" for m in _PANEL) + f"""),
 g AS (SELECT task, profile, model, metric, count(v) AS n, avg(v) AS mean, {samp('stddev_samp', 'v')} AS stdev, min(v) AS min, max(v) AS max
       FROM long WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
 {t_crit_ctes('g')},
 h AS (SELECT g.*, CASE WHEN n > 1 AND min < max THEN crit * stdev / sqrt(n) ELSE 0 END AS half FROM g LEFT JOIN crit ON n = crit_n)
SELECT task, profile, model, metric, n, {rnd('mean', 4)} AS mean, {rnd('stdev', 4)} AS stdev, min, max,
       {rnd('mean - half', 4)} AS ci_lower, {rnd('mean + half', 4)} AS ci_upper FROM h""")
def metric_panel(t):
    from ..functions import scoring
    df = t.scored.withColumn("points_per_1k", F.when(F.col("composite").isNotNull(), scoring.points_per_1k(
        "composite", F.lit(0), "token_count")))
    df = df.withColumns({c: F.when(F.col("success"), F.col(c).cast("double")) for c in CRITERIA})
    g = aggregates.metric_panel(df, ["task", "profile", "model"], _PANEL)
    return g.select("task", "profile", "model", "metric", "n", r("mean"), r("stdev"), "min", "max", r("ci_lower"), r("ci_upper"))


@query("dim_mean_std", f"""WITH {LONG_CTE}
SELECT profile, task, dimension, count(*) AS n, {rnd('avg(score)', 6)} AS mean, {rnd(samp('stddev_samp', 'score'), 4)} AS std
FROM run_scores GROUP BY 1, 2, 3""")
def dim_mean_std(t):
    g = aggregates.dim_stats(t.scored, ["profile", "task"], DIMS)
    return g.select("profile", "task", "dimension", "n", r("mean", 6), r("std"))


@query("profile_macro_mean", f"""WITH {LONG_CTE}, p AS (SELECT profile, task, dimension, avg(score) AS m FROM run_scores GROUP BY 1, 2, 3),
 tok AS (SELECT profile, sum(token_count)::BIGINT AS total_tokens FROM scored GROUP BY 1)
SELECT p.profile, dimension, {rnd('avg(m)', 6)} AS macro_mean, count(*) AS tasks, any_value(total_tokens) AS total_tokens
FROM p JOIN tok ON p.profile = tok.profile GROUP BY 1, 2""")
def profile_macro_mean(t):
    macro = aggregates.macro_mean(t.scored, ["profile"], ["task"], DIMS, {"total_tokens": "token_count"})
    return macro.select("profile", "dimension", r("macro_mean", 6), F.col("groups").alias("tasks"), "total_tokens")


@query("dim_grid", f"""WITH {LONG_CTE}, x AS (SELECT * FROM run_scores),
 m AS (SELECT model, profile, dimension, avg(score) AS v FROM x GROUP BY 1, 2, 3),
 g AS (SELECT * FROM (SELECT DISTINCT model FROM x), (SELECT DISTINCT profile FROM x), (SELECT DISTINCT dimension FROM x))
SELECT g.model, g.profile, g.dimension, {rnd('coalesce(v, 0)', 6)} AS value
FROM g LEFT JOIN m ON g.model = m.model AND g.profile = m.profile AND g.dimension = m.dimension""")
def dim_grid(t):
    return aggregates.grid_mean(t.scored, ["model", "profile"], DIMS).select("model", "profile", "dimension", r("value", 6))


@query("dim_by_task", f"""WITH {LONG_CTE}
SELECT dimension, profile, task, model, {rnd('avg(score)', 6)} AS mean, count(*) AS n FROM run_scores GROUP BY 1, 2, 3, 4""")
def dim_by_task(t):
    g = reshape.agg_dims(t.scored, ["profile", "task", "model"], DIMS, {"mean": F.avg})
    return g.select("dimension", "profile", "task", "model", r("mean", 6), "n")


@query("quality_scores", f"""WITH {QUALITY_CTE}
SELECT run_set, model, profile, {rnd('coalesce(avg(quality), 0)', 6)} AS quality, count(quality) AS scored_runs, sum(token_count)::BIGINT AS total_tokens
FROM quality GROUP BY 1, 2, 3""")
def quality_scores(t):
    return aggregates.quality(t.quality, ["run_set", "model", "profile"]).select(
        "run_set", "model", "profile", r("quality", 6), "scored_runs", "total_tokens")


_PROFILES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("task_variant_heatmap", f"""WITH {SCORED_CTE}
SELECT task, """ + ", ".join(
    f"{rnd(f'''coalesce(avg(CASE WHEN profile = '{p}' THEN composite END), 0)''', 1)} AS \"{p}\"" for p in _PROFILES) + """
FROM scored GROUP BY task""")
def task_variant_heatmap(t):
    g = aggregates.heatmap(t.scored, "task", "profile", _PROFILES, "composite")
    return g.select("task", *[round_to(F.col(f"`{p}`"), 1).alias(p) for p in _PROFILES])


@query("run_health", f"""WITH {RUNS_CTE}, e AS (
  SELECT run_set, model, error, count(*) AS n, row_number() OVER (PARTITION BY run_set, model ORDER BY count(*) DESC, error) AS rk
  FROM runs WHERE NOT success AND error IS NOT NULL GROUP BY 1, 2, 3),
 c AS (SELECT run_set, model, string_agg(error || ' x' || n, '; ' ORDER BY rk) AS common_errors FROM e WHERE rk <= 3 GROUP BY 1, 2)
SELECT r.run_set, r.model, count(*) AS total_runs, count(CASE WHEN NOT success THEN 1 END) AS failed_runs,
  {rnd('count(CASE WHEN NOT success THEN 1 END) / count(*)', 6)} AS failure_rate, coalesce(any_value(common_errors), '') AS common_errors
FROM runs r LEFT JOIN c ON r.run_set = c.run_set AND r.model = c.model GROUP BY 1, 2""")
def run_health(t):
    return aggregates.run_health(t.runs, ["run_set", "model"]).select(
        "run_set", "model", "total_runs", "failed_runs", r("failure_rate", 6), "common_errors")


@query("summary_matrix", f"""WITH {RUNS_CTE}, a AS (
  SELECT profile, model, task, avg(CASE WHEN success THEN input_tokens END) AS i, avg(CASE WHEN success THEN output_tokens END) AS o,
         avg(CASE WHEN success THEN duration_seconds END) AS d, count(CASE WHEN success THEN 1 END) / count(*) AS s FROM runs GROUP BY 1, 2, 3)
SELECT profile, model, count(*) AS tasks, {rnd('avg(i)', 4)} AS avg_input_tokens, {rnd('avg(o)', 4)} AS avg_output_tokens,
       {rnd('avg(d)', 4)} AS avg_duration_seconds, {rnd('avg(s)', 6)} AS avg_success_rate FROM a GROUP BY 1, 2""")
def summary_matrix(t):
    metrics = ["duration_seconds", "input_tokens", "output_tokens"]
    return aggregates.summary_matrix(t.runs, ["profile", "model"], "task", metrics).select(
        "profile", "model", "tasks", *[r(f"avg_{m}") for m in metrics], r("avg_success_rate", 6))


_COST = f"input_tokens / 1e6 * coalesce(price_in, {DEFAULT_PRICE[0]}) + output_tokens / 1e6 * coalesce(price_out, {DEFAULT_PRICE[1]})"


@query("cost_by_model", f"""WITH {RUNS_CTE}, {PRICES_CTE}
SELECT coalesce(r.model, 'total') AS model, count(*) AS runs, {rnd(f'sum({_COST})', 4)} AS cost
FROM runs r LEFT JOIN pricing p ON r.model = p.model GROUP BY ROLLUP (r.model)""")
def cost_by_model(t):
    return aggregates.cost_by_model(t.runs, t.pricing, DEFAULT_PRICE).select("model", "runs", r("cost"))


def _plan(t):
    """What each run set planned, read back from its runs as a manifest would name it."""
    return t.runs.groupBy("run_set").agg(
        F.collect_set("task").alias("task"), F.collect_set("profile").alias("profile"),
        F.collect_set("model").alias("model"), F.max("k2").alias("reps"))


_PLAN_SQL = """axes AS (SELECT DISTINCT run_set, task FROM runs), ap AS (SELECT DISTINCT run_set, profile FROM runs),
 am AS (SELECT DISTINCT run_set, model FROM runs), ar AS (SELECT run_set, max(k2) AS reps FROM runs GROUP BY 1),
 plan AS (SELECT axes.run_set, task, profile, model, CAST(unnest(range(1, reps + 1)) AS INT) AS run_number
   FROM axes JOIN ap ON axes.run_set = ap.run_set JOIN am ON axes.run_set = am.run_set JOIN ar ON axes.run_set = ar.run_set)"""
_PLAN_KEYS = ["run_set", "task", "profile", "model", "run_number"]


@query("estimate_cost", f"""WITH {RUNS_CTE}, {PRICES_CTE}, {_PLAN_SQL}
SELECT coalesce(plan.model, 'total') AS model, count(*) AS runs, {rnd(f'sum(4000 / 1e6 * coalesce(price_in, {DEFAULT_PRICE[0]}) + 2000 / 1e6 * coalesce(price_out, {DEFAULT_PRICE[1]}))', 4)} AS cost
FROM plan LEFT JOIN pricing p ON plan.model = p.model GROUP BY ROLLUP (plan.model)""")
def estimate_cost(t):
    matrix = joins.run_matrix(_plan(t), ["task", "profile", "model"])
    return aggregates.estimate_cost(matrix, t.pricing, DEFAULT_PRICE).select("model", "runs", r("cost"))


@query("run_plan_summary", f"""WITH {RUNS_CTE}, {_PLAN_SQL}, done AS (SELECT DISTINCT run_set, task, profile, model, k2 AS run_number FROM runs),
 g AS (SELECT plan.run_set, count(DISTINCT plan.task) AS tasks, count(DISTINCT plan.profile) AS profiles, count(DISTINCT plan.model) AS models,
   count(*) AS total_runs, count(done.task) AS skipped FROM plan LEFT JOIN done USING (run_set, task, profile, model, run_number) GROUP BY 1)
SELECT *, total_runs // (tasks * profiles * models) AS reps, total_runs // models AS runs_per_model FROM g""")
def run_plan_summary(t):
    matrix = joins.run_matrix(_plan(t), ["task", "profile", "model"])
    done = t.runs.withColumnRenamed("k2", "run_number")
    return aggregates.plan_summary(matrix, done, _PLAN_KEYS, ["run_set"])


@query("cv_pct", f"""WITH {SCORED_CTE}
SELECT profile, task, {rnd("CASE WHEN avg(composite) = 0 THEN 0 ELSE stddev_samp(composite) / avg(composite) * 100 END", 1)} AS cv_pct
FROM scored WHERE composite IS NOT NULL GROUP BY 1, 2""")
def cv_pct(t):
    return aggregates.cv_pct(t.scored.where("success"), ["profile", "task"], "composite").select(
        "profile", "task", r("cv_pct", 1))


@query("token_usage_ratio", f"""WITH {SCORED_CTE}, g AS (SELECT run_set, task, sum(token_count)::BIGINT AS tk FROM scored GROUP BY 1, 2),
 x AS (SELECT run_set, arg_min(task, tk) AS cheapest, min(tk) AS cheapest_tokens, arg_max(task, tk) AS most_expensive, max(tk) AS most_expensive_tokens FROM g GROUP BY 1)
SELECT *, {rnd('most_expensive_tokens / cheapest_tokens', 4)} AS usage_ratio FROM x WHERE most_expensive_tokens / cheapest_tokens > 1.1""")
def token_usage_ratio(t):
    g = t.scored.groupBy("run_set", "task").agg(F.sum("token_count").alias("tokens"))
    return aggregates.usage_ratio(g, "task", "tokens", ["run_set"]).withColumn("usage_ratio", round_to("usage_ratio", 4))


@query("category_means", f"""WITH {QUALITY_CTE}, c AS (SELECT *, regexp_replace(task, '-[0-9]+$', '') AS category FROM quality),
 tc AS (SELECT category, count(DISTINCT task) AS task_count FROM c GROUP BY 1)
SELECT c.category, profile, {rnd('avg(quality)', 6)} AS quality, count(quality) AS n, any_value(task_count) AS task_count
FROM c JOIN tc ON c.category = tc.category WHERE quality IS NOT NULL GROUP BY 1, 2""")
def category_means(t):
    return aggregates.category_quality(t.quality, "profile").select("category", "profile", r("quality", 6), "n", "task_count")


@query("common_dimensions", f"""WITH {LONG_CTE}
SELECT run_set, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimension, string_agg(DISTINCT model, ',' ORDER BY model) AS model,
  string_agg(DISTINCT task, ',' ORDER BY task) AS task, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profile FROM run_scores GROUP BY 1""")
def common_dimensions(t):
    names = t.run_scores.select("run_set", "dimension", "model", "task", "profile").distinct()
    return aggregates.dimensions(names, ["dimension", "model", "task", "profile"], ["run_set"])


@query("conversation_rollup", """WITH m AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN trim(text, E' \\t\\n\\r') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tk FROM conversations),
 g AS (SELECT conv_id, count(CASE WHEN role = 'assistant' THEN 1 END) AS turns,
   coalesce(sum(CASE WHEN role <> 'assistant' THEN tk END), 0)::BIGINT AS input_tokens, coalesce(sum(CASE WHEN role = 'assistant' THEN tk END), 0)::BIGINT AS output_tokens,
   arg_max(text, turn) FILTER (role = 'assistant') AS result_text FROM m GROUP BY 1)
SELECT conv_id, turns, input_tokens, output_tokens, result_text, result_text IS NOT NULL AS success,
   CASE WHEN result_text IS NULL THEN 'No result message received' END AS error FROM g""")
def conversation_rollup(t):
    from ..operators import documents
    return documents.session_result(t.conversations, "conv_id", "turn")


@query("filter_results", f"""WITH {LONG_CTE}, x AS (SELECT * FROM run_scores WHERE model IN ('F', 'O') AND profile IN ('5-LOW', '2-HIGH') AND task <> 'promo-01' AND task LIKE '%-01'),
 p AS (SELECT profile, dimension, task, avg(score) AS m, count(*) AS n FROM x GROUP BY 1, 2, 3)
SELECT profile, dimension, {rnd('avg(m)', 6)} AS macro_mean, count(*) AS tasks FROM p GROUP BY 1, 2""")
def filter_results(t):
    tasks = ["economy-01", "large-01", "medium-01", "small-01", "standard-01"]
    kept = filters.filter_runs(t.scored, model=["F", "O"], profile=["5-LOW", "2-HIGH"], task=tasks)
    return aggregates.macro_mean(kept, ["profile"], ["task"], DIMS).select(
        "profile", "dimension", r("macro_mean", 6), F.col("groups").alias("tasks"))


@query("min_sample_guard", f"""WITH {SCORED_CTE}, g AS (
  SELECT model, task, run_set, loc, count(CASE WHEN profile = '5-LOW' THEN composite END) AS n_a, count(CASE WHEN profile = '1-URGENT' THEN composite END) AS n_b
  FROM scored GROUP BY 1, 2, 3, 4)
SELECT * FROM g WHERE n_a >= 2 AND n_b >= 2""")
def min_sample_guard(t):
    side = lambda p: F.count(F.when(F.col("profile") == p, F.col("composite")))
    g = t.scored.groupBy("model", "task", "run_set", "loc").agg(side("5-LOW").alias("n_a"), side("1-URGENT").alias("n_b"))
    return filters.having_n(g, 2)


@query("rescore_candidates", f"""WITH {RUNS_CTE}, x AS (
  SELECT model, profile, task, k2, success, CASE WHEN k2 % 3 = 0 THEN 'x' END AS scores, k2 % 6 = 0 AS degraded FROM runs),
 c AS (SELECT *, CASE WHEN k2 = 7 THEN 'missing required fields' WHEN task = 'promo-01' THEN 'unknown task' WHEN profile = '4-NOT SPECIFIED' THEN 'unknown profile' END AS reason
   FROM x WHERE success AND (scores IS NULL OR degraded))
SELECT coalesce(reason, 'selected') AS outcome, model, count(*) AS n FROM c GROUP BY 1, 2""")
def rescore_candidates(t):
    runs = t.runs.select(
        "model", "profile", "task", F.when(F.col("k2") != 7, F.col("k2")).alias("run_number"),
        F.when(F.col("success"), "success").otherwise("failure").alias("status"),
        F.when(F.col("k2") % 3 == 0, "x").alias("scores"), (F.col("k2") % 6 == 0).alias("degraded"))
    tasks = t.part.select(F.concat(F.lower("p_type"), F.lit("-0"), (F.col("p_size") % 3 + 1).cast("string")).alias("task")).where("task <> 'promo-01'")
    profiles = t.orders.select(F.col("o_orderpriority").alias("profile")).distinct().where("profile <> '4-NOT SPECIFIED'")
    marked = filters.rescore_reasons(runs, tasks, profiles, rerun_empty=True)
    return marked.groupBy(F.coalesce("reason", F.lit("selected")).alias("outcome"), "model").agg(F.count("*").alias("n"))


@query("source_file_filter", """WITH x AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'src/' || source || '/mod_' || doc_id || '.py' WHEN 1 THEN 'src/test_' || doc_id || '.py'
   WHEN 2 THEN 'src/__pycache__/m.py' WHEN 3 THEN 'pkg/core_test.py' ELSE 'notes/' || doc_id || '.md' END AS path FROM documents)
SELECT lang, count(*) AS files, min(path) AS first_path FROM x
WHERE path LIKE '%.py' AND path NOT LIKE '%\\_\\_pycache\\_\\_%' ESCAPE '\\' AND NOT regexp_matches(path, '(^|/)test_[^/]*$') AND NOT regexp_matches(path, '_test\\.py$') GROUP BY lang""")
def source_file_filter(t):
    k = F.col("doc_id") % 5
    path = (F.when(k == 0, F.concat(F.lit("src/"), "source", F.lit("/mod_"), F.col("doc_id").cast("string"), F.lit(".py")))
            .when(k == 1, F.concat(F.lit("src/test_"), F.col("doc_id").cast("string"), F.lit(".py")))
            .when(k == 2, "src/__pycache__/m.py").when(k == 3, "pkg/core_test.py")
            .otherwise(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md"))))
    kept = filters.source_files(t.documents.select("lang", path.alias("path")), "path")
    return kept.groupBy("lang").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query("quality_grouping_sets", f"""WITH {QUALITY_CTE}, c AS (SELECT *, regexp_replace(task, '-[0-9]+$', '') AS category FROM quality)
SELECT model, profile, category, CAST(grouping(model, profile, category) AS BIGINT) AS level, count(quality) AS scored_runs, count(*) AS runs,
  sum(token_count)::BIGINT AS total_tokens, {rnd('coalesce(avg(quality), 0)', 6)} AS quality
FROM c GROUP BY GROUPING SETS ((), (profile), (model), (model, profile), (category, profile))""")
def quality_grouping_sets(t):
    return rollups.quality_cube(t.quality).withColumn("quality", round_to("quality", 6))


@query("cost_rollup", f"""WITH {RUNS_CTE}, {PRICES_CTE}
SELECT run_set, r.model AS model, profile, CAST(grouping(run_set, r.model, profile) AS BIGINT) AS level, count(*) AS runs, {rnd(f'sum({_COST})', 4)} AS cost,
  sum(input_tokens + output_tokens)::BIGINT AS total_tokens
FROM runs r LEFT JOIN pricing p ON r.model = p.model GROUP BY ROLLUP (run_set, r.model, profile)""")
def cost_rollup(t):
    fine = t.runs.groupBy("run_set", "model", "profile").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = aggregates.with_cost(fine, t.pricing, DEFAULT_PRICE)
    g = priced.rollup("run_set", "model", "profile").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("runs"), F.sum("cost").alias("cost"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))
    return g.withColumn("cost", round_to("cost", 4))


@query("dimension_cube", f"""WITH {LONG_CTE}
SELECT model, profile, dimension, CAST(grouping(model, profile, dimension) AS BIGINT) AS level, count(*) AS n, {rnd('avg(score)', 6)} AS mean
FROM run_scores GROUP BY CUBE (model, profile, dimension)""")
def dimension_cube(t):
    return rollups.dim_cube(t.scored, ["model", "profile"], DIMS).withColumn("mean", round_to("mean", 6))
