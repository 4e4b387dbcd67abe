"""Scoring expressions over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, scoring, text
from ..functions.numeric import finite, round_to, sanitized
from ..operators import filters
from .bindings import CRITERIA, DEFAULT_PRICE, DIMS, PRICES_CTE, QUALITY_CTE, RUNS_CTE, SCORED_CTE
from .registry import query, rnd

KEY = ["model", "profile", "task", "run_set"]


@query("norm_test_pass_rate", f"""WITH {RUNS_CTE}
SELECT task, count(*) AS n, {rnd("avg(CAST(tests_passed AS DOUBLE) / tests_total * 100)", 6)} AS mean_rate,
       max(CAST(tests_passed AS DOUBLE) / tests_total * 100) AS max_rate,
       count(CASE WHEN k2 = 3 THEN 1 END) AS n_without_tests
FROM runs GROUP BY task""")
def norm_test_pass_rate(t):
    rate = scoring.test_pass_rate("tests_passed", "tests_total")
    untested = scoring.test_pass_rate(F.col("tests_passed"), F.lit(0))
    return t.runs.groupBy("task").agg(
        F.count("*").alias("n"), round_to(F.avg(rate), 6).alias("mean_rate"), F.max(rate).alias("max_rate"),
        F.count_if((F.col("k2") == 3) & (untested == 0)).alias("n_without_tests"))


@query("norm_lint", f"""WITH {RUNS_CTE}, x AS (SELECT loc % 7 AS loc, lint_errors FROM runs)
SELECT loc, lint_errors, count(*) AS n,
       {rnd("CASE WHEN loc = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 - CAST(lint_errors AS DOUBLE) / loc * 1000)) END", 4)} AS lint_score
FROM x GROUP BY loc, lint_errors""")
def norm_lint(t):
    runs = t.runs.select((F.col("loc") % 7).alias("loc"), "lint_errors")
    return runs.groupBy("loc", "lint_errors").agg(F.count("*").alias("n")).withColumn(
        "lint_score", round_to(scoring.lint_score("lint_errors", "loc"), 4))


@query("norm_complexity", f"""WITH {RUNS_CTE}, x AS (SELECT avg_complexity * 1.1 - 1 AS c FROM runs)
SELECT {rnd("c", 4)} AS avg_complexity, count(*) AS n,
  {rnd('''CASE WHEN c <= 1 THEN 100.0 WHEN c <= 5 THEN 100 - 5 * (c - 1) WHEN c <= 10 THEN 80 - 4 * (c - 5)
       WHEN c <= 20 THEN 60 - 2 * (c - 10) WHEN c <= 30 THEN 40 - 2 * (c - 20)
       WHEN c <= 40 THEN 20 - 1.5 * (c - 30) ELSE greatest(0.0, 5 - 0.5 * (c - 40)) END''', 4)} AS complexity_score
FROM x GROUP BY c""")
def norm_complexity(t):
    x = t.runs.select((F.col("avg_complexity") * 1.1 - 1).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return x.select(round_to("c", 4).alias("avg_complexity"), "n",
                    round_to(scoring.complexity_score("c"), 4).alias("complexity_score"))


@query("complexity_grade", f"""WITH {RUNS_CTE}
SELECT CASE WHEN avg_complexity <= 5 THEN 'A' WHEN avg_complexity <= 10 THEN 'B' WHEN avg_complexity <= 20 THEN 'C'
            WHEN avg_complexity <= 30 THEN 'D' WHEN avg_complexity <= 40 THEN 'E' ELSE 'F' END AS grade,
       CASE WHEN avg_complexity <= 5 THEN '80–100' WHEN avg_complexity <= 10 THEN '60–80' WHEN avg_complexity <= 20 THEN '40–60'
            WHEN avg_complexity <= 30 THEN '20–40' WHEN avg_complexity <= 40 THEN '5–20' ELSE '0–5' END AS score_range,
       count(*) AS n, min(avg_complexity) AS lowest, max(avg_complexity) AS highest
FROM runs GROUP BY 1, 2""")
def complexity_grade(t):
    return t.runs.groupBy(
        scoring.complexity_grade("avg_complexity").alias("grade"),
        scoring.complexity_range("avg_complexity").alias("score_range")).agg(
        F.count("*").alias("n"), F.min("avg_complexity").alias("lowest"), F.max("avg_complexity").alias("highest"))


@query("static_weighted_total", f"""WITH {SCORED_CTE}, x AS (
  SELECT model, task, r_tp, r_li, r_co,
     {rnd("CASE WHEN task LIKE 'economy%' THEN 0.2 * tp + 0.2 * li + 0.6 * co ELSE 0.5 * tp + 0.3 * li + 0.2 * co END", 2)} AS total
  FROM (SELECT model, task, CASE WHEN tests_passed >= 5 THEN tp ELSE 0 END AS tp, CASE WHEN tests_passed >= 5 THEN li ELSE 0 END AS li,
          CASE WHEN tests_passed >= 5 THEN co ELSE 0 END AS co,
          CASE WHEN tests_passed >= 5 THEN r_tp ELSE 0 END AS r_tp, CASE WHEN tests_passed >= 5 THEN r_li ELSE 0 END AS r_li,
          CASE WHEN tests_passed >= 5 THEN r_co ELSE 0 END AS r_co FROM parts))
SELECT model, task, count(*) AS n, {rnd("avg(total)", 4)} AS mean_total, {rnd("avg(r_tp)", 4)} AS mean_tests,
       {rnd("avg(r_li)", 4)} AS mean_lint, {rnd("avg(r_co)", 4)} AS mean_complexity
FROM x GROUP BY model, task""")
def static_weighted_total(t):
    """Per-task weight table: one category weighs complexity, one override is invalid and ignored."""
    tasks = t.part.select(F.concat(F.lower("p_type"), F.lit("-0"), (F.col("p_size") % 3 + 1).cast("string")).alias("task")).distinct()
    own = F.col("task").startswith("economy")
    bad = F.col("task").startswith("promo")
    weights = tasks.where(own | bad).select(
        "task", F.when(own, 0.2).otherwise(0.9).alias("w_test_pass_rate"),
        F.when(own, 0.2).otherwise(0.9).alias("w_lint_score"), F.lit(0.6).alias("w_complexity_score"))
    runs = t.runs.withColumns({
        "test_pass_rate": scoring.test_pass_rate("tests_passed", "tests_total"),
        "lint_score": scoring.lint_score("lint_errors", "loc"),
        "complexity_score": scoring.complexity_score("avg_complexity")})
    total = scoring.static_total(runs, weights, has_output=F.col("tests_passed") >= 5)
    return total.groupBy("model", "task").agg(
        F.count("*").alias("n"), round_to(F.avg("static_total"), 4).alias("mean_total"),
        round_to(F.avg("test_pass_rate"), 4).alias("mean_tests"), round_to(F.avg("lint_score"), 4).alias("mean_lint"),
        round_to(F.avg("complexity_score"), 4).alias("mean_complexity"))


@query("judge_normalize", f"""WITH {RUNS_CTE}
SELECT c_readability + c_architecture + c_adherence + c_correctness AS criteria_sum, count(*) AS n,
       {rnd("((c_readability + c_architecture + c_adherence + c_correctness) / 4.0 - 1) * 25", 2)} AS normalized,
       {rnd("avg(((c_readability + c_architecture + c_adherence + c_correctness + k2) / 5.0 - 1) * 25)", 4)} AS with_custom
FROM runs GROUP BY 1, 3""")
def judge_normalize(t):
    total = sum((F.col(c) for c in CRITERIA), F.lit(0))
    norm = scoring.judge_normalized(scoring.judge_average(CRITERIA))
    custom = (scoring.judge_average_array(F.array(*CRITERIA, "k2")) - 1.0) * 25.0
    return t.runs.groupBy(total.cast("int").alias("criteria_sum"), norm.alias("normalized")).agg(
        F.count("*").alias("n"), round_to(F.avg(custom), 4).alias("with_custom"))


@query("composite_score", f"""WITH {SCORED_CTE}, x AS (
  SELECT model, r_st, CASE WHEN k2 <> 2 THEN r_lq END AS lq FROM parts)
SELECT model, lq IS NULL AS static_only, count(*) AS n,
       {rnd(f"avg(CASE WHEN lq IS NULL THEN r_st ELSE {rnd('0.5 * r_st + 0.5 * lq', 2)} END)", 4)} AS mean_composite,
       {rnd(f"avg(CASE WHEN lq IS NULL THEN r_st ELSE {rnd('0.8 * r_st + 0.2 * lq', 2)} END)", 4)} AS mean_custom
FROM x GROUP BY 1, 2""")
def composite_score(t):
    runs = t.runs.withColumns({
        "test_pass_rate": scoring.test_pass_rate("tests_passed", "tests_total"),
        "lint_score": scoring.lint_score("lint_errors", "loc"),
        "complexity_score": scoring.complexity_score("avg_complexity"),
        "judge": F.when(F.col("k2") != 2, scoring.judge_normalized(scoring.judge_average(CRITERIA)))})
    df = scoring.static_total(runs)
    return df.groupBy("model", scoring.static_only("judge").alias("static_only")).agg(
        F.count("*").alias("n"),
        round_to(F.avg(scoring.composite("static_total", "judge")), 4).alias("mean_composite"),
        round_to(F.avg(scoring.composite("static_total", "judge", 0.8, 0.2)), 4).alias("mean_custom"))


@query("scoring_status", f"""WITH {RUNS_CTE}, x AS (
  SELECT model, k2 <> 1 AS has_static, k2 NOT IN (1, 2, 3) AS has_judge, k2 = 3 AS skip FROM runs)
SELECT model, concat_ws(',', CASE WHEN NOT has_static THEN 'static' END, CASE WHEN NOT skip AND NOT has_judge THEN 'llm_judge' END) AS failed_scorers,
       NOT has_static OR (NOT skip AND NOT has_judge) AS degraded, count(*) AS n,
       count(CASE WHEN has_static THEN 1 END) AS n_composite
FROM x GROUP BY 1, 2, 3""")
def scoring_status(t):
    s = F.when(F.col("k2") != 1, 1.0)
    j = F.when(~F.col("k2").isin(1, 2, 3), 1.0)
    failed = scoring.failed_scorers(s, j, F.col("k2") == 3)
    return t.runs.groupBy("model", F.concat_ws(",", failed).alias("failed_scorers"),
                          (F.size(failed) > 0).alias("degraded")).agg(
        F.count("*").alias("n"), F.count_if(s.isNotNull()).alias("n_composite"))


@query("token_efficiency", f"""WITH {SCORED_CTE}
SELECT profile, count(*) AS n, sum(CASE WHEN k2 = 7 THEN 0 ELSE input_tokens + output_tokens END)::BIGINT AS total_tokens,
       {rnd(f"avg(CASE WHEN k2 = 7 THEN 0 ELSE {rnd('composite / (input_tokens + output_tokens) * 1000', 2)} END)", 4)} AS mean_points_per_1k
FROM scored WHERE composite IS NOT NULL GROUP BY profile""")
def token_efficiency(t):
    empty = F.col("k2") == 7
    ctx = F.when(empty, 0).otherwise(F.col("input_tokens"))
    io = F.when(empty, 0).otherwise(F.col("output_tokens"))
    return t.scored.where("success").groupBy("profile").agg(
        F.count("*").alias("n"), F.sum(ctx + io).alias("total_tokens"),
        round_to(F.avg(scoring.points_per_1k("composite", ctx, io)), 4).alias("mean_points_per_1k"))


@query("approx_tokens", """SELECT lang, count(*) AS n,
       sum(CASE WHEN text = '' THEN 0 WHEN trim(text, E' \\t\\n\\r') = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens,
       sum(greatest(1, length(split_part(text, ' ', 1)) // 4))::BIGINT AS first_word_tokens
FROM documents GROUP BY lang""")
def approx_tokens(t):
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(text.approx_tokens("text")).alias("tokens"),
        F.sum(F.greatest(F.lit(1), text.approx_tokens(F.split_part("text", F.lit(" "), F.lit(1))))).alias("first_word_tokens"))


@query("run_cost", f"""WITH {RUNS_CTE}, {PRICES_CTE}
SELECT r.model, r.profile, count(*) AS n,
   {rnd(f"sum(input_tokens / 1e6 * coalesce(price_in, {DEFAULT_PRICE[0]}) + output_tokens / 1e6 * coalesce(price_out, {DEFAULT_PRICE[1]}))", 4)} AS cost
FROM runs r LEFT JOIN pricing p ON r.model = p.model GROUP BY 1, 2""")
def run_cost(t):
    from ..operators import aggregates
    return aggregates.with_cost(t.runs, t.pricing, DEFAULT_PRICE).groupBy("model", "profile").agg(
        F.count("*").alias("n"), round_to(F.sum("cost"), 4).alias("cost"))


_ERRORS = """CASE k2 % 7 WHEN 0 THEN error WHEN 1 THEN 'HTTP 529: overloaded' WHEN 2 THEN 'No Python files found in output directory'
   WHEN 3 THEN 'Unable to locate credentials' WHEN 4 THEN 'rate limit; token expired' WHEN 5 THEN 'no python files found' ELSE 'Timeout' END"""


@query("classify_error", f"""WITH {RUNS_CTE}, x AS (SELECT {_ERRORS} AS e FROM runs WHERE NOT success), y AS (
  SELECT e, CASE WHEN lower(e) LIKE '%expired%' OR lower(e) LIKE '%unable to locate credentials%' THEN 'auth'
     WHEN lower(e) LIKE '%rate limit%' OR lower(e) LIKE '%529%' OR lower(e) LIKE '%too many requests%' THEN 'transient'
     WHEN e LIKE '%No Python files found%' THEN 'deterministic' ELSE 'other' END AS c FROM x)
SELECT e AS error, c AS error_class, c = 'transient' AS retryable,
       CASE WHEN c = 'auth' THEN 'Authentication failed: ' || e ELSE e END AS message, count(*) AS n
FROM y GROUP BY 1, 2, 3, 4""")
def classify_error(t):
    x = t.runs.where(~F.col("success")).select(F.expr(_ERRORS).alias("error"))
    return x.groupBy("error").agg(F.count("*").alias("n")).select(
        "error", labels.error_class("error").alias("error_class"), labels.is_retryable("error").alias("retryable"),
        labels.error_message("error").alias("message"), "n")


@query("run_key", f"""WITH {RUNS_CTE}
SELECT concat_ws('/', model, profile, task, CASE WHEN run_set % 2 = 0 THEN 'v' || run_set END, 'run-' || k2) AS run_key, count(*) AS n
FROM runs GROUP BY 1""")
def run_key(t):
    variant = F.when(F.col("run_set") % 2 == 0, F.concat(F.lit("v"), F.col("run_set")))
    return t.runs.groupBy(labels.run_key("model", "profile", "task", "k2", variant).alias("run_key")).agg(F.count("*").alias("n"))


@query("variant_key", f"""WITH {RUNS_CTE}
SELECT profile || CASE WHEN k2 > 3 THEN ':temp-0.' || k2 ELSE '' END AS variant_key,
       CASE WHEN k2 > 3 THEN 'temp-0.' || k2 ELSE profile END AS variant_label, count(*) AS n
FROM runs GROUP BY 1, 2""")
def variant_key(t):
    variant = F.when(F.col("k2") > 3, F.concat(F.lit("temp-0."), F.col("k2")))
    keyed = t.runs.groupBy(labels.variant_key("profile", variant).alias("variant_key")).agg(F.count("*").alias("n"))
    return keyed.withColumn("variant_label", labels.variant_label("variant_key"))


@query("task_category", f"""WITH {RUNS_CTE}
SELECT regexp_replace(task, '-[0-9]+$', '') AS category, count(DISTINCT task) AS tasks, count(*) AS n FROM runs GROUP BY 1""")
def task_category(t):
    per_task = t.runs.groupBy("task").agg(F.count("*").alias("n"))
    return per_task.groupBy(labels.task_category("task").alias("category")).agg(
        F.count("*").alias("tasks"), F.sum("n").alias("n"))


@query("dimension_label", f"""WITH {RUNS_CTE}, x AS (
  SELECT CASE k2 WHEN 1 THEN 'composite' WHEN 2 THEN 'test_pass_rate' WHEN 3 THEN 'lint_score' WHEN 4 THEN 'llm_quality'
     WHEN 5 THEN 'token_efficiency' WHEN 6 THEN 'edge_case_depth' ELSE 'complexity_score' END AS dimension FROM runs)
SELECT dimension, CASE dimension WHEN 'composite' THEN 'Overall' WHEN 'test_pass_rate' THEN 'Tests' WHEN 'lint_score' THEN 'Lint'
   WHEN 'llm_quality' THEN 'LLM Quality' WHEN 'token_efficiency' THEN 'Efficiency' WHEN 'complexity_score' THEN 'Complexity'
   ELSE 'Edge Case Depth' END AS label, count(*) AS n FROM x GROUP BY 1, 2""")
def dimension_label(t):
    names = F.array(*[F.lit(x) for x in ["composite", "test_pass_rate", "lint_score", "llm_quality", "token_efficiency",
                                         "edge_case_depth", "complexity_score"]])
    return t.runs.groupBy(F.element_at(names, F.col("k2")).alias("dimension")).agg(F.count("*").alias("n")).withColumn(
        "label", labels.dimension_label("dimension"))


@query("score_tier", f"""WITH {SCORED_CTE}
SELECT CASE WHEN composite IS NULL THEN NULL WHEN composite >= 90 THEN 'excellent' WHEN composite >= 70 THEN 'good'
            WHEN composite >= 50 THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n, min(composite) AS lowest, max(composite) AS highest
FROM scored GROUP BY 1""")
def score_tier(t):
    return t.scored.groupBy(labels.score_tier("composite").alias("tier")).agg(
        F.count("*").alias("n"), F.min("composite").alias("lowest"), F.max("composite").alias("highest"))


@query("effect_label", f"""WITH {SCORED_CTE}, x AS (SELECT (composite - 50) / 40 AS d FROM scored)
SELECT CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
       count(*) AS n FROM x GROUP BY 1""")
def effect_label(t):
    return t.scored.groupBy(labels.effect_label((F.col("composite") - 50) / 40).alias("effect")).agg(F.count("*").alias("n"))


@query("sanitize_nonfinite", f"""WITH {SCORED_CTE}
SELECT model, count(*) AS n, count(CASE WHEN k2 NOT IN (1, 2, 3) THEN composite END) AS n_finite,
       {rnd("avg(CASE WHEN k2 NOT IN (1, 2, 3) THEN composite END)", 4)} AS mean_finite FROM scored GROUP BY model""")
def sanitize_nonfinite(t):
    raw = (F.when(F.col("k2") == 1, float("nan")).when(F.col("k2") == 2, float("inf"))
           .when(F.col("k2") == 3, float("-inf")).otherwise(F.col("composite")))
    return t.scored.withColumn("v", finite(raw)).groupBy("model").agg(
        F.count("*").alias("n"), F.count("v").alias("n_finite"), round_to(F.avg("v"), 4).alias("mean_finite"))


@query("sanitize_nested", f"""WITH {SCORED_CTE}, x AS (SELECT model, CASE WHEN k2 NOT IN (1, 2, 3) THEN composite END AS v, composite AS c FROM scored)
SELECT model, count(*) AS n, count(v) AS in_struct, 2 * count(v) + count(c) AS in_array, count(v) AS in_map, {rnd('avg(v)', 4)} AS mean_finite FROM x GROUP BY model""")
def sanitize_nested(t):
    """Numbers that are not finite in a struct, in an array of structs and in a map, all cleaned in one walk over the schema."""
    raw = (F.when(F.col("k2") == 1, float("nan")).when(F.col("k2") == 2, float("inf"))
           .when(F.col("k2") == 3, float("-inf")).otherwise(F.col("composite")))
    named = F.struct(raw.alias("value"), F.lit("points").alias("unit"))
    report = F.struct(named.alias("total"), F.array(named, F.struct(F.col("composite").alias("value"), F.lit("x").alias("unit")), named).alias("parts"),
                      F.map_from_arrays(F.array(F.lit("composite")), F.array(raw)).alias("scores"))
    clean = sanitized(t.scored.select("model", report.alias("report")))
    some = F.filter("report.parts", lambda p: p["value"].isNotNull() & ~F.isnan(p["value"]))
    return clean.groupBy("model").agg(
        F.count("*").alias("n"), F.count("report.total.value").alias("in_struct"), F.sum(F.size(some)).alias("in_array"),
        F.count(F.col("report.scores")["composite"]).alias("in_map"), round_to(F.avg("report.total.value"), 4).alias("mean_finite"))


@query("flatten_scores", f"""WITH {SCORED_CTE}
SELECT CASE WHEN k2 = 1 THEN 'none' WHEN k2 = 2 THEN 'broken' WHEN k2 % 2 = 0 THEN 'flat' ELSE 'nested' END AS layout,
   count(*) AS n, {rnd("sum(CASE WHEN k2 > 2 THEN composite END)", 2)} AS composite, {rnd("sum(CASE WHEN k2 > 2 THEN llm_quality END)", 2)} AS llm_quality,
   {rnd("sum(CASE WHEN k2 > 2 AND k2 % 2 = 1 THEN lint_score END)", 2)} AS lint_score,
   sum(CASE WHEN k2 <= 2 THEN 0 WHEN k2 % 2 = 0 THEN 2 ELSE 5 END)::BIGINT AS dimensions
FROM scored WHERE success GROUP BY 1""")
def flatten_scores(t):
    nested = F.to_json(F.struct(
        F.struct("test_pass_rate", "lint_score", "complexity_score").alias("static"),
        F.struct(F.col("llm_quality").alias("normalized")).alias("llm"),
        F.struct("composite", F.lit(False).alias("static_only")).alias("composite"),
        F.lit(False).alias("degraded")))
    flat = F.to_json(F.struct("composite", "llm_quality", F.lit(True).alias("degraded"), F.lit("high").alias("note")))
    # A third of the flat records name a score twice; the last value is the one.
    flat = F.when(F.col("k1") % 3 == 0, F.regexp_replace(flat, r"^\{", '{"composite": 1.5, ')).otherwise(flat)
    layout = (F.when(F.col("k2") == 1, "none").when(F.col("k2") == 2, "broken")
              .when(F.col("k2") % 2 == 0, "flat").otherwise("nested"))
    raw = (F.when(layout == "broken", F.lit('{"composite": 1')).when(layout == "flat", flat).when(layout == "nested", nested))
    records = t.scored.where("success").select(layout.alias("layout"), raw.alias("raw"))
    df = records.select("layout", scoring.flatten_scores("raw").alias("m"))
    return df.groupBy("layout").agg(
        F.count("*").alias("n"), round_to(F.sum(F.col("m")["composite"]), 2).alias("composite"),
        round_to(F.sum(F.col("m")["llm_quality"]), 2).alias("llm_quality"),
        round_to(F.sum(F.col("m")["lint_score"]), 2).alias("lint_score"),
        F.sum(F.size("m")).alias("dimensions"))


@query("run_composite", f"""WITH {QUALITY_CTE}
SELECT model, profile, {rnd("avg(quality)", 6)} AS mean_all, {rnd("avg(CASE WHEN k2 = 1 THEN (llm_quality + lint_score) / 2 ELSE composite END)", 6)} AS prefer_composite,
   count(*) AS n, count(quality) AS scored FROM quality GROUP BY 1, 2""")
def run_composite(t):
    every = F.map_from_arrays(F.array(*[F.lit(d) for d in DIMS]), F.array(*DIMS))
    two = F.map_from_arrays(F.array(F.lit("llm_quality"), F.lit("lint_score")), F.array("llm_quality", "lint_score"))
    scores = F.when(F.col("k2") == 1, two).otherwise(every)
    df = t.scored.select("model", "profile", scoring.run_quality(every).alias("q"),
                         scoring.run_quality(scores, "prefer_composite").alias("c"))
    return df.groupBy("model", "profile").agg(
        round_to(F.avg("q"), 6).alias("mean_all"), round_to(F.avg("c"), 6).alias("prefer_composite"),
        F.count("*").alias("n"), F.count("q").alias("scored"))


@query("score_bounds_check", f"""WITH {SCORED_CTE}, x AS (SELECT *, composite * 1.3 AS inflated FROM scored)
SELECT * FROM (
  SELECT 'score_in_0_100' AS rule, count(CASE WHEN inflated < 0 OR inflated > 100 THEN 1 END) AS n_bad, count(*) AS n FROM x
  UNION ALL SELECT 'criterion_in_1_5', count(CASE WHEN c_correctness + (k2 // 6) > 5 THEN 1 END), count(*) FROM x
  UNION ALL SELECT 'passed_within_total', count(CASE WHEN tests_passed > 45 THEN 1 END), count(*) FROM x
  UNION ALL SELECT 'spread_not_negative', count(CASE WHEN k2 - 2 < 0 THEN 1 END), count(*) FROM x
  UNION ALL SELECT 'count_positive', count(CASE WHEN loc - 1 < 1 THEN 1 END), count(*) FROM x
  UNION ALL SELECT 'weights_add_up', count(CASE WHEN k2 % 3 = 0 THEN 1 END), count(*) FROM x
  UNION ALL SELECT 'failed_run_has_error', count(CASE WHEN NOT success AND error IS NULL THEN 1 END), count(*) FROM x) v""")
def score_bounds_check(t):
    return filters.violations(t.scored, {
        "score_in_0_100": F.coalesce((F.col("composite") * 1.3).between(0, 100), F.lit(True)),
        "criterion_in_1_5": (F.col("c_correctness") + F.floor(F.col("k2") / 6)).between(1, 5),
        "passed_within_total": F.col("tests_passed") <= 45,
        **filters.statistic_rules(F.col("k2") - 2, F.col("loc") - 1, [F.lit(0.5), F.lit(0.3), F.when(F.col("k2") % 3 == 0, 0.3).otherwise(0.2)]),
        "failed_run_has_error": F.col("success") | F.col("error").isNotNull(),
    })


@query("task_rules_check", """WITH t AS (SELECT p_partkey AS id, ['bug-fix', 'refactor', 'instruction', 'code-gen'][p_partkey % 4 + 1] AS task_type,
   CASE WHEN p_size % 3 > 0 THEN p_name END AS starter_code, CASE WHEN p_size % 5 = 0 THEN p_type END AS starter_files, CASE WHEN p_size % 2 = 0 THEN p_brand END AS rules,
   CASE WHEN p_size > 45 THEN 'system' WHEN p_size > 20 THEN 'module' ELSE 'function' END AS size FROM part)
SELECT * FROM (SELECT 'starter_present' AS rule, count(CASE WHEN task_type IN ('bug-fix', 'refactor') AND starter_code IS NULL AND starter_files IS NULL THEN 1 END) AS n_bad, count(*) AS n FROM t
 UNION ALL SELECT 'rules_present', count(CASE WHEN task_type = 'instruction' AND rules IS NULL THEN 1 END), count(*) FROM t
 UNION ALL SELECT 'size_known', count(CASE WHEN size NOT IN ('function', 'module') THEN 1 END), count(*) FROM t) v""")
def task_rules_check(t):
    k = F.col("p_partkey") % 4
    tasks = t.part.select(
        F.when(k == 0, "bug-fix").when(k == 1, "refactor").when(k == 2, "instruction").otherwise("code-gen").alias("task_type"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("starter_code"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("starter_files"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("task_rules"), F.lit(None).cast("string").alias("prompt_rules"),
        F.when(F.col("p_size") > 45, "system").when(F.col("p_size") > 20, "module").otherwise("function").alias("size"))
    return filters.violations(tasks, filters.task_rules())
