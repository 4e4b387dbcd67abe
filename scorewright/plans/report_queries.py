"""Report frames over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import round_to
from ..operators import aggregates, findings, joins, ranking, reshape, stats
from ..session import pin
from .aggregating_queries import r
from .bindings import BASELINE, DIMS, LONG_CTE, QUALITY_CTE, RUNS_CTE, SCORED_CTE
from .registry import query, rnd
from .testing_queries import _SIDES, _VARIANT, COMPARE_CTE, mwu_sql

_LABEL = "CASE dimension WHEN 'composite' THEN 'Overall' WHEN 'test_pass_rate' THEN 'Tests' WHEN 'lint_score' THEN 'Lint' WHEN 'complexity_score' THEN 'Complexity' ELSE 'LLM Quality' END"
_Q = """q AS (SELECT run_set, profile, avg(quality) AS v, sum(token_count)::BIGINT AS tk FROM quality GROUP BY 1, 2),
 s AS (SELECT run_set, arg_min(profile, (-round(v, 9), profile)) AS best, max(v) AS bv, arg_min(profile, (round(v, 9), profile)) AS worst, min(v) AS wv,
   arg_min(profile, (-round(v / tk * 1e9, 9), profile)) AS eff, count(*) AS n, max(CASE WHEN profile = '5-LOW' THEN v END) AS cv FROM q GROUP BY 1)"""
_TIER = "CASE WHEN bv >= 90 THEN 'excellent' WHEN bv >= 70 THEN 'good' WHEN bv >= 50 THEN 'fair' ELSE 'poor' END"


def _quality(t):
    return aggregates.quality(t.quality, ["run_set", "profile"])


def _out(df):
    return df.select("run_set", "kind", "subject", r("value", 4), "text")


_TOKEN_SQL = f"""SELECT run_set, 'token_usage' AS kind, hi AS subject, {rnd('ht / lt', 4)} AS value, printf('Token usage varies %.1fx (%s: %d, %s: %d)', ht / lt, lo, lt, hi, ht) AS text
  FROM (SELECT run_set, arg_min(profile, (tk, profile)) AS lo, min(tk) AS lt, arg_max(profile, (tk, profile)) AS hi, max(tk) AS ht FROM q GROUP BY 1) WHERE ht / lt > 1.1"""


@query("findings_report", f"""WITH {QUALITY_CTE}, {_Q}, b AS (SELECT q.run_set, count(*) AS n, string_agg(profile, ', ' ORDER BY profile) AS names FROM q JOIN s ON q.run_set = s.run_set WHERE profile <> '{BASELINE}' AND round(v, 9) > round(cv, 9) GROUP BY 1)
SELECT run_set, 'best' AS kind, best AS subject, {rnd('bv', 4)} AS value, printf('%s scored %.1f of 100 overall: %s', best, bv, {_TIER}) AS text FROM s
UNION ALL SELECT s.run_set, 'token_winner', eff, {rnd('q.v', 4)}, CASE WHEN eff = best THEN printf('%s is also the most token-efficient', best) ELSE printf('%s is the most token-efficient (%.1f of 100), not %s', eff, q.v, best) END FROM s JOIN q ON s.run_set = q.run_set AND s.eff = q.profile
UNION ALL SELECT run_set, 'spread', best, {rnd('bv - wv', 4)}, printf('Quality spread of %.1f points: %s differences', bv - wv, CASE WHEN bv - wv < 5 THEN 'minimal' WHEN bv - wv < 15 THEN 'moderate' ELSE 'significant' END) FROM s WHERE n >= 2
UNION ALL SELECT s.run_set, 'beats_baseline', names, {rnd('coalesce(b.n, 0)', 4)}, CASE WHEN b.n > 0 THEN printf('%d beat the baseline: %s', b.n, names) ELSE 'None beats the baseline' END FROM s LEFT JOIN b ON s.run_set = b.run_set""")
def findings_report(t):
    return _out(findings.quality_findings(_quality(t), ["run_set"], "profile", BASELINE))


_REG = f"""{_SIDES}, {mwu_sql('src', 'task, dimension, profile', 'side', 'greater')},
 rg AS (SELECT *, (mean_b - mean_a) / mean_a AS delta, p < 0.05 AND (mean_b - mean_a) / mean_a < -0.005 AS flag FROM tested)"""


def _regressions(t):
    return stats.detect_regressions(t.run_scores, "profile", BASELINE, ["task", "dimension"], delta_threshold=0.005)


@query("findings_regressions", f"""WITH {_REG}, f AS (SELECT * FROM rg WHERE flag)
SELECT task, 'regression' AS kind, profile AS subject, {rnd('delta', 4)} AS value, printf('%s on %s/%s: %+.1f%% (p=%.3f)', profile, task, dimension, delta * 100, p) AS text FROM f
UNION ALL SELECT task, 'regression_count', (SELECT string_agg(DISTINCT profile, ', ' ORDER BY profile) FROM f WHERE f.task = rg.task), {rnd('count(CASE WHEN flag THEN 1 END)', 4)},
  CASE WHEN count(CASE WHEN flag THEN 1 END) > 0 THEN printf('%d regression(s) in %d profile(s): %s', count(CASE WHEN flag THEN 1 END), count(DISTINCT CASE WHEN flag THEN profile END), (SELECT string_agg(DISTINCT profile, ', ' ORDER BY profile) FROM f WHERE f.task = rg.task)) ELSE 'No regressions detected' END
FROM rg GROUP BY task""")
def findings_regressions(t):
    return findings.regression_findings(_regressions(t), "profile", ["task"]).select("task", "kind", "subject", r("value", 4), "text")


@query("findings_experiment", f"""WITH {_VARIANT}, quality AS (SELECT run_set, profile, composite AS quality, token_count FROM scored), {mwu_sql('src', 'run_set, profile', 'side', 'two-sided')}, {_Q},
 c AS (SELECT run_set, count(CASE WHEN p < 0.05 THEN 1 END) AS sig FROM tested GROUP BY 1)
SELECT run_set, 'best' AS kind, best AS subject, {rnd('bv', 4)} AS value, printf('Best variant: %s with %.1f', best, bv) AS text FROM s WHERE bv > 0
UNION ALL SELECT run_set, 'spread', best, {rnd('bv - wv', 4)}, printf('Spread across variants: %.1f points (%s over %s)', bv - wv, best, worst) FROM s WHERE n > 1 AND bv - wv > 1
UNION ALL SELECT run_set, 'no_difference', NULL, 0.0, 'No significant differences between variants' FROM c WHERE sig = 0
UNION ALL SELECT run_set, 'significant', profile, {rnd('mean_b - mean_a', 4)}, printf('%s scored %.1f points %s than control (p=%.3f, d=%.2f)', profile, abs(mean_b - mean_a), CASE WHEN mean_b > mean_a THEN 'higher' ELSE 'lower' END, p, d) FROM tested WHERE p < 0.05
UNION ALL {_TOKEN_SQL}""")
def findings_experiment(t):
    runs = t.scored
    table = stats.variant_table(runs, "profile", BASELINE, "composite", ["run_set"], with_power=False)
    quality = aggregates.quality(runs, ["run_set", "profile"], "composite")
    return _out(findings.experiment_findings(table, quality, ["run_set"], "profile"))


@query("findings_comparison", f"""WITH {COMPARE_CTE},
 quality AS (SELECT *, (composite + test_pass_rate + lint_score + complexity_score + llm_quality) / 5 AS quality FROM scored), q AS (SELECT model AS run_set, run_set::VARCHAR AS profile, avg(quality) AS v, sum(token_count)::BIGINT AS tk FROM quality GROUP BY 1, 2),
 s AS (SELECT run_set, arg_min(profile, (-round(v, 9), profile)) AS best, max(v) AS bv, arg_min(profile, (round(v, 9), profile)) AS worst, min(v) AS wv, count(*) AS n FROM q GROUP BY 1)
SELECT run_set AS model, 'best' AS kind, best AS subject, {rnd('bv', 4)} AS value, printf('Best run set: %s with %.1f', best, bv) AS text FROM s
UNION ALL SELECT run_set, 'spread', best, {rnd('bv - wv', 4)}, printf('Spread across run sets: %.1f points (%s over %s)', bv - wv, best, worst) FROM s WHERE n > 1 AND bv - wv > 0.5
UNION ALL SELECT run_set, 'no_difference', NULL, 0.0, 'No significant differences between run sets' FROM s WHERE run_set NOT IN (SELECT model FROM compared WHERE is_significant)
UNION ALL SELECT model, 'significant', dimension, count(*)::DOUBLE, printf('%d significant difference(s) in %s', count(*), {_LABEL}) FROM compared WHERE is_significant GROUP BY model, dimension
UNION ALL SELECT * FROM ({_TOKEN_SQL})""")
def findings_comparison(t):
    scored = t.quality
    q = aggregates.quality(scored, ["model", "run_set"])
    c = stats.compare_run_sets(reshape.to_long(scored.select("model", "profile", "task", "run_set", *DIMS), DIMS), "run_set", ["model", "profile", "task"], method="asymptotic")
    return findings.comparison_findings(c, q, ["model"], "run_set").select("model", "kind", "subject", r("value", 4), "text")


@query("chart_series", f"""WITH {LONG_CTE}, q AS (SELECT profile, {rnd("(avg(composite) + avg(test_pass_rate) + avg(lint_score) + avg(complexity_score) + avg(llm_quality)) / 5", 4)} AS v, sum(token_count)::BIGINT AS tk FROM scored GROUP BY 1),
 f AS (SELECT *, max(v) OVER (ORDER BY tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q)
SELECT 'radar' AS chart, profile AS series, model || '/' || {_LABEL} AS point, {rnd('avg(score)', 4)} AS value, NULL::BOOLEAN AS on_frontier FROM run_scores GROUP BY profile, model, dimension
UNION ALL SELECT 'bar', profile, dimension || '/' || task, {rnd('avg(score)', 4)}, NULL FROM run_scores GROUP BY profile, dimension, task
UNION ALL SELECT 'scatter', profile, CAST(tk AS VARCHAR), v, v > coalesce(before, -1) FROM f""")
def chart_series(t):
    cells = pin(reshape.cell_sums(t.quality, ["model", "profile", "task"], [*DIMS, "quality"], ["token_count"]), "cells")
    radar = findings.radar_series(cells, DIMS, summed=True).select(
        F.lit("radar").alias("chart"), F.col("profile").alias("series"), F.concat_ws("/", "model", "axis").alias("point"), r("value"), F.lit(None).cast("boolean").alias("on_frontier"))
    bar = findings.bar_series(cells, DIMS, summed=True).select(
        F.lit("bar").alias("chart"), F.col("profile").alias("series"), F.concat_ws("/", "dimension", "task").alias("point"), r("value"), F.lit(None).cast("boolean").alias("on_frontier"))
    q = aggregates.quality(cells, ["profile"], summed=True).withColumn("quality", round_to("quality", 4))
    scatter = findings.scatter_series(q, "profile").select(
        F.lit("scatter").alias("chart"), F.col("profile").alias("series"), F.col("total_tokens").cast("string").alias("point"), F.col("quality").alias("value"), "on_frontier")
    return radar.unionByName(bar).unionByName(scatter)


_NARRATIVE = ("struct<best_profile_overall:struct<profile:string,score:double>,token_efficiency_winner:string,"
              "profiles:array<struct<name:string,quality:double,tokens:bigint>>,"
              "category_analysis:array<struct<category:string,winner:string,winner_score:double,margin:double>>,"
              "regressions:array<struct<profile:string,task:string,dimension:string,delta_pct:double,p_value:double>>>")

_SIDES_BY_SET = LONG_CTE + f""", names AS (SELECT DISTINCT run_set, profile FROM run_scores WHERE profile <> '{BASELINE}'),
 src AS (SELECT r.run_set, task, dimension, n.profile, score AS v, 'a' AS side FROM run_scores r JOIN names n ON r.run_set = n.run_set WHERE r.profile = '{BASELINE}'
   UNION ALL SELECT run_set, task, dimension, profile, score, 'b' FROM run_scores WHERE profile <> '{BASELINE}')"""


@query("narrative_context", f"""WITH {_SIDES_BY_SET}, {mwu_sql('src', 'run_set, task, dimension, profile', 'side', 'greater')},
 quality AS (SELECT *, (composite + test_pass_rate + lint_score + complexity_score + llm_quality) / 5 AS quality FROM scored), {_Q},
 cells AS (SELECT run_set, regexp_replace(task, '-[0-9]+$', '') AS category, profile, avg(quality) AS v FROM quality GROUP BY 1, 2, 3 HAVING avg(quality) IS NOT NULL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY run_set, category ORDER BY round(v, 9) DESC, profile) AS rn FROM cells),
 cats AS (SELECT run_set, category, max(CASE WHEN rn = 1 THEN profile END) AS winner, max(CASE WHEN rn = 1 THEN v END) AS top, max(CASE WHEN rn = 2 THEN v END) AS second FROM ranked GROUP BY 1, 2)
SELECT run_set, 'best' AS part, best AS subject, eff AS detail, {rnd('bv', 1)} AS value, NULL::DOUBLE AS other FROM s
UNION ALL SELECT run_set, 'profile', profile, NULL, {rnd('v', 2)}, tk::DOUBLE FROM q
UNION ALL SELECT run_set, 'category', category, winner, {rnd('top', 1)}, {rnd('top - second', 1)} FROM cats
UNION ALL SELECT run_set, 'regression', profile, task || '/' || dimension, {rnd('(mean_b - mean_a) / mean_a * 100', 1)}, {rnd('p', 3)} FROM tested WHERE p < 0.05 AND (mean_b - mean_a) / mean_a < -0.05""")
def narrative_context(t):
    """The JSON context read back into rows."""
    q = _quality(t)
    cells = t.quality.withColumn("category", labels.task_category("task")).groupBy("run_set", "category", "profile").agg(F.avg("quality").alias("quality")).where("quality IS NOT NULL")
    cats = ranking.winner_margin(cells, ["run_set", "category"], "profile", "quality")
    reg = stats.detect_regressions(t.run_scores, "profile", BASELINE, ["run_set", "task", "dimension"])
    doc = findings.narrative(q, cats, reg, ["run_set"], "profile").select("run_set", F.from_json("context", _NARRATIVE).alias("c"))

    def rows(part, c, subject, detail, value, other):
        named = lambda x, kind: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(kind)
        source = doc if c is None else doc.select("run_set", F.explode(f"c.{c}").alias("e"))
        return source.select("run_set", F.lit(part).alias("part"), named(subject, "string").alias("subject"), named(detail, "string").alias("detail"),
                             named(value, "double").alias("value"), named(other, "double").alias("other"))

    return (rows("best", None, "c.best_profile_overall.profile", "c.token_efficiency_winner", "c.best_profile_overall.score", None)
            .unionByName(rows("profile", "profiles", "e.name", None, "e.quality", "e.tokens"))
            .unionByName(rows("category", "category_analysis", "e.category", "e.winner", "e.winner_score", "e.margin"))
            .unionByName(rows("regression", "regressions", "e.profile", F.concat_ws("/", "e.task", "e.dimension"), "e.delta_pct", "e.p_value")))


@query("comparison_rows", f"""WITH {COMPARE_CTE}
SELECT model || '/' || profile || '/' || task AS key, dimension, run_set_a::VARCHAR AS run_a, run_set_b::VARCHAR AS run_b, {rnd('mean_a', 2)} AS run_a_mean, {rnd('mean_b', 2)} AS run_b_mean,
  printf('%+.1f%%', {rnd('delta * 100', 1)}) AS delta_pct, {rnd('adj', 4)} AS p_value, effect_label, is_significant FROM compared""")
def comparison_rows(t):
    c = stats.compare_run_sets(t.run_scores, "run_set", ["model", "profile", "task"])
    return findings.comparison_rows(c, "run_set")


@query("comparison_document", f"""WITH {LONG_CTE}, g AS (SELECT model, task, profile, dimension, {rnd('avg(score)', 2)} AS m FROM run_scores GROUP BY 1, 2, 3, 4)
SELECT a.model, a.task, a.dimension, a.profile AS profile_a, b.profile AS profile_b, a.m AS mean_a, b.m AS mean_b, printf('%+.1f', {rnd('b.m - a.m', 1)}) AS delta,
  CASE WHEN a.m >= 90 THEN 'excellent' WHEN a.m >= 70 THEN 'good' WHEN a.m >= 50 THEN 'fair' ELSE 'poor' END AS tier_a,
  CASE WHEN b.m >= 90 THEN 'excellent' WHEN b.m >= 70 THEN 'good' WHEN b.m >= 50 THEN 'fair' ELSE 'poor' END AS tier_b
FROM g a JOIN g b ON a.model = b.model AND a.task = b.task AND a.dimension = b.dimension AND a.profile < b.profile""")
def comparison_document(t):
    means = reshape.agg_dims(t.scored, ["model", "task", "profile"], DIMS, {"mean": lambda c: round_to(F.avg(c), 2)})
    return findings.comparison_pairs(means, ["model", "task"], "profile").select(
        "model", "task", "dimension", "profile_a", "profile_b", "mean_a", "mean_b", "delta", "tier_a", "tier_b")


@query("comparison_json", f"""WITH {LONG_CTE}
SELECT model, task, profile, dimension, {rnd('avg(score)', 2)} AS mean FROM run_scores GROUP BY 1, 2, 3, 4""")
def comparison_json(t):
    """The JSON documents read back into rows."""
    means = reshape.agg_dims(t.scored, ["model", "task", "profile"], DIMS, {"mean": lambda c: round_to(F.avg(c), 2)})
    docs = findings.comparison_document(means, ["model", "task"], "profile")
    per_profile = docs.select("model", "task", F.explode(F.from_json("scores", "map<string,map<string,double>>")).alias("profile", "dims"))
    return per_profile.select("model", "task", "profile", F.explode("dims").alias("dimension", "mean"))


_DRILL_TIES = "k1, k2, k3, k4, loc, input_tokens, output_tokens"


@query("drilldown", f"""WITH {SCORED_CTE}, b AS (SELECT *, row_number() OVER (PARTITION BY task, profile ORDER BY coalesce(composite, 0) DESC, {_DRILL_TIES}) AS rn FROM scored),
 g AS (SELECT task, profile, count(composite) AS n, {rnd('avg(composite)', 4)} AS mean, min(composite) AS low, max(composite) AS high FROM scored GROUP BY 1, 2)
SELECT b.task, b.profile, tests_passed, tests_total, test_pass_rate, lint_score, lint_errors, complexity_score, avg_complexity, llm_quality AS judge_normalized, judge_avg AS judge_average, token_count AS tokens,
  composite, static_total, loc > 0 AS has_output, g.n AS scored_runs, g.mean AS mean_composite, g.low AS lowest, g.high AS highest
FROM b JOIN g ON b.task = g.task AND b.profile = g.profile WHERE rn = 1""")
def drilldown(t):
    d = findings.drilldown(t.scored, ["task", "profile"], ["k1", "k2", "k3", "k4", "loc", "input_tokens", "output_tokens"])
    return d.select("task", "profile", "d.tests.passed", "d.tests.total", "d.tests.pass_rate", F.col("d.lint.score").alias("lint_score"),
                    F.col("d.lint.errors").alias("lint_errors"), F.col("d.complexity.score").alias("complexity_score"),
                    F.col("d.complexity.avg").alias("avg_complexity"), F.col("d.judge.normalized").alias("judge_normalized"),
                    F.col("d.judge.average").alias("judge_average"), "d.tokens", "d.composite", "d.static_total", "d.has_output",
                    F.col("d.runs.n").alias("scored_runs"), round_to("d.runs.mean", 4).alias("mean_composite"),
                    F.col("d.runs.low").alias("lowest"), F.col("d.runs.high").alias("highest")).withColumnsRenamed(
        {"passed": "tests_passed", "total": "tests_total", "pass_rate": "test_pass_rate"})


@query("report_metadata", f"""WITH {RUNS_CTE}, x AS (SELECT *, CASE WHEN k2 > 5 THEN 'v' || k2 END AS variant_label FROM runs)
SELECT run_set, max(run_set || '-12-31') AS date, string_agg(DISTINCT model, ',' ORDER BY model) AS models, coalesce(string_agg(DISTINCT variant_label, ',' ORDER BY variant_label), '') AS variants,
  count(DISTINCT profile) AS profile_count, count(*) AS total_runs, 7 AS planned_profiles FROM x GROUP BY 1""")
def report_metadata(t):
    runs = t.runs.withColumn("variant_label", F.when(F.col("k2") > 5, F.concat(F.lit("v"), F.col("k2").cast("string"))))
    planned = t.orders.select(F.year("o_orderdate").alias("run_set")).distinct().withColumn("planned_profiles", F.lit(7))
    return findings.report_metadata(runs, ["run_set"], F.concat(F.col("run_set").cast("string"), F.lit("-12-31")), planned)
