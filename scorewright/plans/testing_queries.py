"""Statistical tests and judge calibration over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, tails
from ..functions.numeric import round_to
from ..operators import calibration, filters, prefix, stats
from ..session import pin
from .aggregating_queries import r
from .bindings import BASELINE, JUDGED_CTE, LONG_CTE, QUALITY_CTE, SCORED_CTE
from .registry import query, rnd
from .source_queries import CATALOG_SQL, catalog_of

_JUDGE_CRITERIA = ["readability", "architecture", "adherence", "correctness"]


def sf_sql(z: str) -> str:
    """Normal tail for the SQL side: Simpson's rule over the density from 0 to |z|, cut off at 9."""
    return (f"(SELECT CASE WHEN zz >= 0 THEN 0.5 - h ELSE 0.5 + h END FROM (SELECT zz, y / 600 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201), "
            f"lambda i: CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(y * i / 200, 2) / 2))) AS h "
            f"FROM (SELECT {z} AS zz, least(9.0, abs({z})) AS y)))")


def t_tail_sql(t: str, df: str) -> str:
    """Student's t tail above |t|: with t = sqrt(df) tan(x) its density is a power of a cosine; Simpson's rule again."""
    return (f"(SELECT 0.5 - x / 1200 * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp((v - 1) * ln(cos(x * i / 400))))) / (sqrt(pi()) * exp(lgamma(v / 2) - lgamma((v + 1) / 2))) FROM (SELECT {df} AS v, atan(abs({t}) / sqrt({df})) AS x))")


def mwu_sql(source: str, keys: str, side: str, alternative: str) -> str:
    """U, z and p by ranking the raw rows of both sides; `side` is 'a' or 'b' per row of `source`."""
    big = "greatest(u, n_a * n_b - u)" if alternative == "two-sided" else "u"
    mult = "2 *" if alternative == "two-sided" else ""
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0 AS mr,
   count(*) OVER (PARTITION BY {keys}, v) AS t FROM {source}),
 agg AS (SELECT {keys}, count(CASE WHEN {side} = 'a' THEN 1 END) AS n_a, count(CASE WHEN {side} = 'b' THEN 1 END) AS n_b,
   sum(CASE WHEN {side} = 'a' THEN mr END) AS ra, sum(CAST(t AS DOUBLE) * t - 1) AS ties,
   avg(CASE WHEN {side} = 'a' THEN v END) AS mean_a, avg(CASE WHEN {side} = 'b' THEN v END) AS mean_b,
   coalesce(var_samp(CASE WHEN {side} = 'a' THEN v END), 0) AS var_a, coalesce(var_samp(CASE WHEN {side} = 'b' THEN v END), 0) AS var_b FROM rk GROUP BY {keys}),
 us AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM agg WHERE n_a >= 2 AND n_b >= 2),
 vs AS (SELECT *, CAST(n_a AS DOUBLE) * n_b / 12 * (n_a + n_b + 1 - ties / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1))) AS uv FROM us),
 zs AS (SELECT *, CASE WHEN uv > 1e-10 THEN ({big} - CAST(n_a AS DOUBLE) * n_b / 2 - 0.5) / sqrt(uv) END AS z FROM vs),
 tested AS (SELECT *, coalesce(least(1.0, {mult} {sf_sql('z')}), 1.0) AS p,
   CASE WHEN var_a + var_b > 1e-18 THEN (mean_b - mean_a) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) ELSE 0 END AS d FROM zs)"""


_SIDES = LONG_CTE + f""", names AS (SELECT DISTINCT profile FROM run_scores WHERE profile <> '{BASELINE}'),
 src AS (SELECT task, dimension, n.profile, score AS v, 'a' AS side FROM run_scores r JOIN names n ON true WHERE r.profile = '{BASELINE}'
   UNION ALL SELECT task, dimension, profile, score, 'b' FROM run_scores WHERE profile <> '{BASELINE}')"""


@query("mann_whitney", f"""WITH {_SIDES}, {mwu_sql('src', 'task, dimension, profile', 'side', 'two-sided')}
SELECT task, dimension, profile, n_a, n_b, u, {rnd('z', 4)} AS z, {rnd('p', 5)} AS p_value FROM tested""")
def mann_whitney(t):
    hist = stats.histogram(t.run_scores, ["task", "dimension", "profile"])
    pairs = stats.versus(hist, ["task", "dimension"], "profile", BASELINE)
    return stats.mann_whitney(pairs, "two-sided", "asymptotic").select(
        "task", "dimension", "profile", "n_a", "n_b", "u", r("z"), r("p_value", 5))


@query("mann_whitney_unbounded", f"""WITH {QUALITY_CTE}, src AS (SELECT model, token_count / 7.0 AS v, CASE WHEN success THEN 'a' ELSE 'b' END AS side FROM quality),
 {mwu_sql('src', 'model', 'side', 'greater')}
SELECT model, n_a, n_b, u, {rnd('z', 4)} AS z, {rnd('p', 5)} AS p_value FROM tested""")
def mann_whitney_unbounded(t):
    """Values without a bound on how many distinct ones there are: running sums split by value range."""
    runs = t.runs.select("model", ((F.col("input_tokens") + F.col("output_tokens")) / 7.0).alias("value"), "success")
    splits = prefix.range_splits(runs, "value")
    sides = runs.groupBy("model", "value").agg(
        F.count_if("success").alias("n_a"), F.count_if(~F.col("success")).alias("n_b"))
    return stats.mann_whitney(stats.two_sample(sides, ["model"], splits), "greater", "asymptotic").select(
        "model", "n_a", "n_b", "u", r("z"), r("p_value", 5))


def _two(t):
    hist = stats.histogram(t.run_scores, ["task", "dimension", "profile"])
    return stats.versus(hist, ["task", "dimension"], "profile", BASELINE)


_AGG2 = LONG_CTE + f""", g AS (SELECT task, dimension, profile, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM run_scores GROUP BY 1, 2, 3),
 ab AS (SELECT b.task, b.dimension, b.profile, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb
   FROM g a JOIN g b ON a.task = b.task AND a.dimension = b.dimension AND a.profile = '{BASELINE}' AND b.profile <> '{BASELINE}')"""


@query("welch_t", f"""WITH {_AGG2}
SELECT task, dimension, profile, {rnd('(ma - mb) / sqrt(va / na + vb / nb)', 4)} AS t,
  {rnd('pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1))', 3)} AS df FROM ab""")
def welch_t(t):
    return stats.welch(_two(t)).select("task", "dimension", "profile", r("t"), r("df", 3))


@query("welch_p", f"""WITH {_AGG2}, w AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM ab)
SELECT task, dimension, profile, {rnd(f"least(1.0, 2 * {t_tail_sql('t', 'df')})", 6)} AS p_value, 'welch-t-test' AS test_used FROM w""")
def welch_p(t):
    return stats.welch_p(stats.welch(_two(t))).select("task", "dimension", "profile", r("p_value", 6), "test_used")


@query("cohens_d_pooled", f"""WITH {_AGG2}
SELECT task, dimension, profile, {rnd('(mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))', 5)} AS d FROM ab""")
def cohens_d_pooled(t):
    return _two(t).select("task", "dimension", "profile", round_to(stats.cohens_d(), 5).alias("d"))


@query("cohens_d_average", f"""WITH {_AGG2}
SELECT task, dimension, profile, {rnd('(ma - mb) / sqrt((va + vb) / 2)', 5)} AS d FROM ab""")
def cohens_d_average(t):
    return _two(t).select("task", "dimension", "profile", round_to(stats.cohens_d("average"), 5).alias("d"))


@query("label_effect", """WITH x AS (SELECT lang, quality, CAST(length(text) AS DOUBLE) AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 g AS (SELECT lang, quality, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY 1, 2)
SELECT a.lang, a.n AS n_a, b.n AS n_b, """ + rnd("(b.m - a.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2))", 4) + """ AS d
FROM g a JOIN g b ON a.lang = b.lang AND a.quality = 0 AND b.quality = 1 WHERE a.n >= 2 AND b.n >= 2""")
def label_effect(t):
    """Do labelled-good texts differ in length from the others?"""
    docs = t.documents.select("doc_id", "lang", F.length("text").cast("double").alias("score"))
    hist = stats.histogram(docs.join(t.labels, "doc_id"), ["lang", "quality"])
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    sides = hist.select("lang", "value", F.when(bad, F.col("n")).otherwise(0).alias("n_a"), F.when(good, F.col("n")).otherwise(0).alias("n_b"))
    pairs = stats.two_sample(sides, ["lang"]).where("n_a >= 2 AND n_b >= 2")
    return pairs.select("lang", "n_a", "n_b", round_to(stats.cohens_d(), 4).alias("d"))


@query("post_hoc_power")
def post_hoc_power(t):
    rows = _two(t).withColumn("d", stats.cohens_d())
    power = tails.post_hoc_power("d", "n_a", "n_b", 0.05)
    return rows.select("task", "dimension", "profile", r("d"), round_to(power, 4).alias("power"))


def spearman_sql(source: str, keys: str) -> str:
    return f"""sr AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM {source}),
 sp AS (SELECT {keys}, count(*) AS n, corr(rx, ry) AS rho FROM sr GROUP BY {keys})"""


@query("spearman", f"""WITH {SCORED_CTE}, s AS (SELECT model, profile, tests_passed AS x, composite AS y FROM scored WHERE composite IS NOT NULL), {spearman_sql('s', 'model, profile')}
SELECT model, profile, n, {rnd('rho', 6)} AS rho FROM sp""")
def spearman(t):
    counts = t.scored.where("success").groupBy("model", "profile", "tests_passed", "composite").agg(F.count("*").alias("n"))
    return stats.spearman(counts, ["model", "profile"], "tests_passed", "composite").select("model", "profile", "n", r("rho", 6))


@query("detect_regressions", f"""WITH {_SIDES}, {mwu_sql('src', 'task, dimension, profile', 'side', 'greater')}
SELECT task, dimension, profile, n_a, n_b, {rnd('mean_a', 4)} AS baseline_mean, {rnd('mean_b', 4)} AS profile_mean, {rnd('(mean_b - mean_a) / mean_a', 6)} AS delta_pct,
  {rnd('p', 5)} AS p_value, p < 0.05 AND (mean_b - mean_a) / mean_a < -0.005 AS is_regression, 'mann-whitney-u' AS test_used FROM tested""")
def detect_regressions(t):
    found = stats.detect_regressions(t.run_scores, "profile", BASELINE, ["task", "dimension"], delta_threshold=0.005)
    return found.select("task", "dimension", "profile", "n_a", "n_b", r("mean_a", 4, "baseline_mean"), r("mean_b", 4, "profile_mean"),
                        r("delta_pct", 6), r("p_value", 5), "is_regression", "test_used")


@query("score_detail", f"""WITH {_SIDES}, {mwu_sql('src', 'task, dimension, profile', 'side', 'greater')},
 det AS (SELECT dimension, task, profile, model, avg(score) AS m, stddev_pop(score) AS s FROM run_scores GROUP BY 1, 2, 3, 4)
SELECT det.dimension, det.task, det.profile, det.model, {rnd('m', 6)} AS mean, {rnd('s', 4)} AS std, coalesce(p < 0.05 AND (mean_b - mean_a) / mean_a < -0.005, false) AS regression
FROM det LEFT JOIN tested ON det.task = tested.task AND det.dimension = tested.dimension AND det.profile = tested.profile""")
def score_detail(t):
    """Means and flags from one table of value counts."""
    by = ["dimension", "task", "profile", "model"]
    hist = pin(stats.histogram(t.run_scores, by), "histogram")
    whole = hist.groupBy("task", "dimension", "profile", "value").agg(F.sum("n").alias("n"))
    found = stats.regressions_in(whole, "profile", BASELINE, ["task", "dimension"], delta_threshold=0.005)
    flags = found.where("is_regression").select("task", "dimension", "profile", F.lit(True).alias("regression"))
    detail = stats.moments(hist, by).withColumn("std", F.sqrt(F.col("var") * (F.col("n") - 1) / F.col("n")))
    return detail.join(flags, ["task", "dimension", "profile"], "left").select(
        "dimension", "task", "profile", "model", r("mean", 6), r("std"), F.coalesce("regression", F.lit(False)).alias("regression"))


_VARIANT = SCORED_CTE + f""", base AS (SELECT run_set, profile, composite AS v FROM scored WHERE composite IS NOT NULL),
 names AS (SELECT DISTINCT run_set, profile FROM base WHERE profile <> '{BASELINE}'),
 src AS (SELECT n.run_set, n.profile, v, 'a' AS side FROM base b JOIN names n ON b.run_set = n.run_set WHERE b.profile = '{BASELINE}'
   UNION ALL SELECT run_set, profile, v, 'b' FROM base WHERE profile <> '{BASELINE}')"""


@query("variant_vs_control", f"""WITH {_VARIANT}, {mwu_sql('src', 'run_set, profile', 'side', 'two-sided')},
 x AS (SELECT *, least(1.0, p * count(*) OVER (PARTITION BY run_set)) AS adj FROM tested)
SELECT run_set, profile, n_a AS n_control, n_b AS n_variant, {rnd('mean_b', 4)} AS mean, {rnd('mean_a', 4)} AS control_mean, {rnd('mean_b - mean_a', 4)} AS delta,
  {rnd('(mean_b - mean_a) / mean_a', 6)} AS delta_pct, {rnd('p', 5)} AS p_value, {rnd('d', 4)} AS effect_size, {rnd('sqrt(var_b) / mean_b * 100', 3)} AS cv_pct, {rnd('adj', 5)} AS adjusted_p_value,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_label,
  p < 0.05 AS is_significant, adj < 0.05 AS is_significant_adjusted FROM x""")
def variant_vs_control(t):
    v = stats.variant_table(t.scored, "profile", BASELINE, "composite", ["run_set"], with_power=False)
    return v.select("run_set", "profile", "n_control", "n_variant", r("mean"), r("control_mean"), r("delta"), r("delta_pct", 6), r("p_value", 5),
                    r("effect_size"), r("cv_pct", 3), r("adjusted_p_value", 5), "effect_label", "is_significant", "is_significant_adjusted")


_DELTA = "CASE WHEN mean_a = 0 THEN 0 ELSE (mean_b - mean_a) / mean_a END"
def compare_cte(where: str = "") -> str:
    """Raw scores of both sides of every two run sets, the U test over them and its correction."""
    return f""", b AS (SELECT model, profile, task, dimension, run_set, score FROM run_scores{where}),
 sets AS (SELECT DISTINCT model, profile, task, dimension, run_set FROM b),
 prs AS (SELECT x.model, x.profile, x.task, x.dimension, x.run_set AS run_set_a, y.run_set AS run_set_b FROM sets x JOIN sets y
   ON x.model = y.model AND x.profile = y.profile AND x.task = y.task AND x.dimension = y.dimension AND x.run_set < y.run_set),
 src AS (SELECT p.*, b.score AS v, CASE WHEN b.run_set = run_set_a THEN 'a' ELSE 'b' END AS side FROM prs p JOIN b
   ON p.model = b.model AND p.profile = b.profile AND p.task = b.task AND p.dimension = b.dimension AND (b.run_set = run_set_a OR b.run_set = run_set_b)),
 {mwu_sql('src', 'model, profile, task, dimension, run_set_a, run_set_b', 'side', 'two-sided')},
 keys AS (SELECT model, profile, task FROM (SELECT DISTINCT model, profile, task, run_set FROM b) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 nom AS (SELECT (SELECT count(DISTINCT run_set) FROM b) AS e, (SELECT count(*) FROM keys) AS k, (SELECT count(DISTINCT dimension) FROM b) AS dd),
 compared AS (SELECT *, e * (e - 1) // 2 * k * dd AS n_comparisons, least(1.0, p * (e * (e - 1) // 2 * k * dd)) AS adj, {_DELTA} AS delta,
   CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_label,
   p * (e * (e - 1) // 2 * k * dd) < 0.05 AND abs({_DELTA}) > 0.05 AS is_significant FROM tested CROSS JOIN nom)"""


COMPARE_CTE = LONG_CTE + compare_cte()
_COMPARED = f"""SELECT model, profile, task, dimension, run_set_a, run_set_b, n_a, n_b, u, {rnd('mean_a', 4)} AS mean_a, {rnd('mean_b', 4)} AS mean_b, {rnd('delta', 5)} AS delta_pct,
  {rnd('z', 4)} AS z, {rnd('d', 4)} AS effect_size, {rnd('p', 5)} AS raw_p_value, {rnd('adj', 4)} AS p_value, effect_label, is_significant, n_comparisons FROM compared"""


def _compared(c):
    return c.select("model", "profile", "task", "dimension", "run_set_a", "run_set_b", "n_a", "n_b", "u", r("mean_a"), r("mean_b"),
                    r("delta_pct", 5), r("z"), r("effect_size"), r("raw_p_value", 5), r("p_value", 4), "effect_label", "is_significant", F.col("n_comparisons").cast("bigint").alias("n_comparisons"))


@query("compare_run_sets", f"WITH {COMPARE_CTE} {_COMPARED}")
def compare_run_sets(t):
    return _compared(stats.compare_run_sets(t.run_scores, "run_set", ["model", "profile", "task"], method="asymptotic"))


@query("compare_chosen_run_sets", f"""WITH {LONG_CTE}, {CATALOG_SQL},
 chosen AS (SELECT DISTINCT run_set FROM cat WHERE run_id = 'run-005' OR run_set % 2 = 0){compare_cte(" WHERE run_set IN (SELECT run_set FROM chosen)")} {_COMPARED}""")
def compare_chosen_run_sets(t):
    """The run sets that the catalog finds by id or tag, each with each."""
    found = filters.catalog_find(catalog_of(t), ["run-005"], ["even"])
    chosen = found.select(F.right("name", F.lit(4)).cast("int").alias("run_set"))
    return _compared(stats.compare_run_sets(t.run_scores, "run_set", ["model", "profile", "task"], chosen=chosen))


@query("judge_variance", f"""WITH {JUDGED_CTE}, c AS (""" + " UNION ALL ".join(
    f"SELECT model, task, tier, '{c}' AS criterion, {c} AS s FROM judgements" for c in _JUDGE_CRITERIA) + f"""),
 g AS (SELECT model, task, tier, criterion, var_samp(s) AS v FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
SELECT model, {rnd('avg(v)', 6)} AS mean_variance, count(*) AS groups, {rnd('count(CASE WHEN v = 0 THEN 1 END) / count(*) * 100', 4)} AS pct_deterministic FROM g GROUP BY 1""")
def judge_variance(t):
    return calibration.determinism(t.judgements, _JUDGE_CRITERIA).select("model", r("mean_variance", 6), "groups", r("pct_deterministic"))


@query("judge_discrimination", f"""WITH {JUDGED_CTE}, c AS (""" + " UNION ALL ".join(
    f"SELECT model, tier, '{c}' AS measure, CAST({c} AS DOUBLE) AS s FROM judgements" for c in ["normalized", *_JUDGE_CRITERIA]) + f"""),
 g AS (SELECT model, measure, avg(s) FILTER (tier = 'gold') AS g, avg(s) FILTER (tier = 'mild') AS m, avg(s) FILTER (tier = 'severe') AS v,
   var_samp(s) FILTER (tier = 'gold') AS vg, var_samp(s) FILTER (tier = 'severe') AS vs FROM c GROUP BY 1, 2)
SELECT model, measure, {rnd('g', 6)} AS gold_mean, {rnd('m', 6)} AS mild_mean, {rnd('v', 6)} AS severe_mean, {rnd('(g - v) / sqrt((vg + vs) / 2)', 6)} AS d FROM g""")
def judge_discrimination(t):
    d = calibration.discrimination(t.judgements, ["normalized", *_JUDGE_CRITERIA])
    return d.select("model", "measure", r("gold_mean", 6), r("mild_mean", 6), r("severe_mean", 6), r("d", 6))


_TIER = "CASE tier WHEN 'severe' THEN 1 WHEN 'mild' THEN 2 ELSE 3 END"


@query("tier_correlation", f"""WITH {JUDGED_CTE}, s AS (SELECT model, {_TIER} AS x, normalized AS y FROM judgements), {spearman_sql('s', 'model')}
SELECT model, n, {rnd('rho', 6)} AS rho FROM sp""")
def tier_correlation(t):
    return calibration.tier_correlation(t.judgements).select("model", "n", r("rho", 6))


_AGREE = f"""jm AS (SELECT model, task, tier, round(avg(normalized), 9) AS m FROM judgements GROUP BY 1, 2, 3),
 s AS (SELECT a.model AS ma, b.model AS mb, a.m AS x, b.m AS y FROM jm a JOIN jm b ON a.task = b.task AND a.tier = b.tier AND a.model < b.model), {spearman_sql('s', 'ma, mb')}"""


@query("inter_rater_agreement", f"""WITH {JUDGED_CTE}, {_AGREE}
SELECT (SELECT count(DISTINCT model) FROM jm) AS judges, count(*) AS pairs, {rnd('avg(rho)', 6)} AS agreement FROM sp WHERE n >= 3""")
def inter_rater_agreement(t):
    return calibration.inter_rater(t.judgements).select("judges", "pairs", r("agreement", 6))


@query("judge_recommendation", f"""WITH {JUDGED_CTE}, jj AS (SELECT *, CASE WHEN rep <> 7 THEN normalized END AS nz FROM judgements), c AS (""" + " UNION ALL ".join(
    f"SELECT model, task, tier, '{c}' AS criterion, {c} AS s FROM jj WHERE nz IS NOT NULL" for c in _JUDGE_CRITERIA) + f"""),
 gv AS (SELECT model, task, tier, criterion, var_samp(s) AS v FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
 det AS (SELECT model, avg(v) AS mv, count(CASE WHEN v = 0 THEN 1 END) / count(*) * 100 AS pd FROM gv GROUP BY 1),
 dis AS (SELECT model, (avg(nz) FILTER (tier = 'gold') - avg(nz) FILTER (tier = 'severe')) / sqrt((var_samp(nz) FILTER (tier = 'gold') + var_samp(nz) FILTER (tier = 'severe')) / 2) AS d,
   count(nz) AS successful, count(*) - count(nz) AS failed FROM jj GROUP BY 1),
 ts AS (SELECT model, {_TIER} AS x, nz AS y FROM jj WHERE nz IS NOT NULL), {spearman_sql('ts', 'model')},
 m AS (SELECT *, 0.4 * d / CASE WHEN max(d) OVER () > 0 THEN max(d) OVER () ELSE 1 END + 0.3 * pd / CASE WHEN max(pd) OVER () > 0 THEN max(pd) OVER () ELSE 1 END
   + 0.3 * (1 - mv / CASE WHEN max(mv) OVER () > 0 THEN max(mv) OVER () ELSE 1 END) AS sc FROM det JOIN dis USING (model))
SELECT model, {rnd('d', 6)} AS d, {rnd('pd', 4)} AS pct_deterministic, {rnd('mv', 6)} AS mean_variance, {rnd('sc', 6)} AS recommendation_score, successful, failed, {rnd('rho', 6)} AS tier_correlation,
  row_number() OVER (ORDER BY round(sc, 9) DESC, model) = 1 AS recommended,
  CASE WHEN row_number() OVER (ORDER BY round(sc, 9) DESC, model) = 1 THEN printf('%s scored highest overall (score=%.2f): discrimination=%.2f, determinism=%.0f%%, variance=%.3f', model, sc, d, pd, mv) END AS reasoning
FROM m JOIN sp USING (model)""")
def judge_recommendation(t):
    j = t.judgements.withColumn("normalized", F.when(F.col("rep") != 7, F.col("normalized")))
    rec = calibration.recommend(j, _JUDGE_CRITERIA)
    return rec.select("model", r("d", 6), r("pct_deterministic"), r("mean_variance", 6), r("recommendation_score", 6), "successful", "failed", r("tier_correlation", 6), "recommended", "reasoning")
