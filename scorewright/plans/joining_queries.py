"""Baselines, overlaps, pairs, run matrices and catalog joins over the sample runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import round_to
from ..operators import joins, ranking, reshape
from ..session import pin
from .aggregating_queries import _PLAN_KEYS, _PLAN_SQL, _plan, r
from .bindings import BASELINE, DIMS, LONG_CTE, QUALITY_CTE, RUNS_CTE, SCORED_CTE
from .registry import query, rnd


@query("baseline_join", f"""WITH {LONG_CTE}, g AS (SELECT task, dimension, profile, avg(score) AS m, count(*) AS n FROM run_scores GROUP BY 1, 2, 3)
SELECT a.task, a.dimension, a.profile, a.n, b.n AS baseline_n, {rnd('a.m', 6)} AS mean, {rnd('b.m', 6)} AS baseline_mean, {rnd('(a.m - b.m) / b.m', 6)} AS delta_pct
FROM g a JOIN g b ON a.task = b.task AND a.dimension = b.dimension AND b.profile = '{BASELINE}' WHERE a.profile <> '{BASELINE}'""")
def baseline_join(t):
    g = reshape.agg_dims(t.scored, ["task", "profile"], DIMS, {"mean": F.avg})
    j = joins.vs_baseline(g, "profile", BASELINE, ["task", "dimension"], ["mean", "n"])
    j = j.withColumn("delta_pct", joins.delta_pct("mean", "baseline_mean"))
    return j.select("task", "dimension", "profile", "n", "baseline_n", r("mean", 6), r("baseline_mean", 6), r("delta_pct", 6))


@query("pairwise_run_sets", f"""WITH {LONG_CTE}, g AS (SELECT model, profile, task, dimension, run_set, avg(score) AS m, count(*) AS n FROM run_scores GROUP BY 1, 2, 3, 4, 5)
SELECT a.model, a.profile, a.task, a.dimension, a.run_set AS run_set_a, b.run_set AS run_set_b, a.n AS n_a, b.n AS n_b,
  {rnd('a.m', 6)} AS mean_a, {rnd('b.m', 6)} AS mean_b
FROM g a JOIN g b ON a.model = b.model AND a.profile = b.profile AND a.task = b.task AND a.dimension = b.dimension AND a.run_set < b.run_set""")
def pairwise_run_sets(t):
    on = ["model", "profile", "task"]
    g = reshape.agg_dims(t.scored, [*on, "run_set"], DIMS, {"mean": F.avg})
    p = joins.pairwise(g, "run_set", [*on, "dimension"], ["n", "mean"])
    return p.select(*on, "dimension", "run_set_a", "run_set_b", "n_a", "n_b", r("mean_a", 6), r("mean_b", 6))


@query("overlap_keys", f"""WITH {RUNS_CTE}, p AS (SELECT DISTINCT model, profile, task, loc, run_set FROM runs)
SELECT model, profile, task, loc, count(*) AS run_sets FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")
def overlap_keys(t):
    return joins.overlap(t.runs, "run_set", ["model", "profile", "task", "loc"])


@query("unique_keys", f"""WITH {RUNS_CTE}, p AS (SELECT DISTINCT model, profile, task, loc, run_set FROM runs)
SELECT model, profile, task, loc, min(run_set) AS run_set FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) = 1""")
def unique_keys(t):
    return joins.unique_keys(t.runs, "run_set", ["model", "profile", "task", "loc"])


@query("intersect_all_sets", f"""WITH {RUNS_CTE}, p AS (SELECT DISTINCT model, profile, task, loc, run_set FROM runs),
 c AS (SELECT *, count(*) OVER (PARTITION BY model, profile, task, loc) AS s FROM p)
SELECT run_set, count(*) AS combinations, count(CASE WHEN s = 1 THEN 1 END) AS unique_combinations,
  count(CASE WHEN s = (SELECT count(DISTINCT run_set) FROM p) THEN 1 END) AS in_all_sets FROM c GROUP BY 1""")
def intersect_all_sets(t):
    return joins.intersect_all(t.runs, "run_set", ["model", "profile", "task", "loc"])


@query("cross_variant_expand", f"""WITH {LONG_CTE}, x AS (SELECT run_set || ':' || profile || ':v' || (k2 % 2) AS rs, model, task, dimension, score FROM run_scores),
 g AS (SELECT rs, model, task, dimension, avg(score) AS m, count(*) AS n FROM x WHERE dimension = 'composite' GROUP BY 1, 2, 3, 4)
SELECT a.rs AS run_set_a, b.rs AS run_set_b, '_all' AS profile, a.model, a.task, a.n AS n_a, b.n AS n_b, {rnd('b.m - a.m', 6)} AS delta
FROM g a JOIN g b ON a.model = b.model AND a.task = b.task AND a.rs < b.rs""")
def cross_variant_expand(t):
    scored = t.scored.withColumn("variant", F.concat(F.lit("v"), (F.col("k2") % 2).cast("string")))
    virtual = joins.expand_variants(scored)
    on = ["model", "profile", "task"]
    g = virtual.where("success").groupBy(*on, "run_set").agg(
        F.avg("composite").alias("mean"), F.count("*").alias("n"))
    p = joins.pairwise(g, "run_set", on, ["mean", "n"])
    return p.select("run_set_a", "run_set_b", "profile", "model", "task", "n_a", "n_b",
                    round_to(F.col("mean_b") - F.col("mean_a"), 6).alias("delta"))


@query("cross_variant_chosen", f"""WITH {LONG_CTE}, x AS (SELECT run_set || ':' || profile || ':v' || (k2 % 2) AS rs, model, task, dimension, score FROM run_scores WHERE run_set = 1997),
 g AS (SELECT rs, model, task, dimension, avg(score) AS m, count(*) AS n FROM x GROUP BY 1, 2, 3, 4)
SELECT a.rs AS run_set_a, b.rs AS run_set_b, a.model, a.task, a.dimension, a.n AS n_a, b.n AS n_b, {rnd('b.m - a.m', 6)} AS delta
FROM g a JOIN g b ON a.model = b.model AND a.task = b.task AND a.dimension = b.dimension AND a.rs < b.rs""")
def cross_variant_chosen(t):
    """All dimensions of the virtual run sets of one year, each with each; the others are not paired."""
    scored = t.scored.withColumn("variant", F.concat(F.lit("v"), (F.col("k2") % 2).cast("string")))
    virtual = joins.expand_variants(scored)
    means = pin(reshape.agg_dims(virtual, ["model", "task", "run_set"], DIMS, {"mean": F.avg}), "means")
    chosen = means.select("run_set").distinct().where(F.col("run_set").startswith("1997:"))
    p = joins.pairwise(means, "run_set", ["model", "task", "dimension"], ["mean", "n"], chosen)
    return p.select("run_set_a", "run_set_b", "model", "task", "dimension", "n_a", "n_b",
                    round_to(F.col("mean_b") - F.col("mean_a"), 6).alias("delta"))


@query("resume_remaining", f"""WITH {RUNS_CTE}, {_PLAN_SQL}, done AS (SELECT DISTINCT run_set, task, profile, model, k2 AS run_number FROM runs WHERE success)
SELECT run_set, model, count(*) AS remaining FROM (SELECT * FROM plan ANTI JOIN done USING (run_set, task, profile, model, run_number)) GROUP BY 1, 2""")
def resume_remaining(t):
    matrix = joins.run_matrix(_plan(t), ["task", "profile", "model"])
    done = t.runs.withColumnRenamed("k2", "run_number")
    left = joins.remaining(matrix, done, _PLAN_KEYS, retry_failures=True)
    return left.groupBy("run_set", "model").agg(F.count("*").alias("remaining"))


@query("run_matrix", f"""WITH {RUNS_CTE}, {_PLAN_SQL}
SELECT concat_ws('/', run_set, model, profile, task, 'run-' || run_number) AS run_key, model, run_number FROM plan""")
def run_matrix(t):
    matrix = joins.run_matrix(_plan(t), ["task", "profile", "model"])
    key = F.concat_ws("/", F.col("run_set").cast("string"), labels.run_key("model", "profile", "task", "run_number"))
    return matrix.select(key.alias("run_key"), "model", "run_number")


@query("experiment_expand", """WITH v AS (
  SELECT DISTINCT p_brand AS label, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN 'think: ' END AS prompt_prefix,
    CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 = 0 THEN 'pad ' END AS padding,
    CASE WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 0 THEN 0.7 END AS temperature, CAST(substr(p_brand, 7) AS INT) % 4 = 0 AS own FROM part),
 m AS (SELECT label, unnest(CASE WHEN own THEN ['O'] ELSE ['F', 'O', 'P'] END) AS model FROM v),
 d AS (SELECT DISTINCT lower(p_type) AS task FROM part)
SELECT v.label AS variant_label, model, task, CAST(unnest([1, 2, 3]) AS INT) AS run_number, 'base' AS profile, CAST(coalesce(temperature, 0.2) AS DOUBLE) AS temperature,
  nullif(coalesce(padding, '') || coalesce(prompt_prefix, ''), '') AS prompt_prefix
FROM v JOIN m ON v.label = m.label CROSS JOIN d""")
def experiment_expand(t):
    num = F.substring("p_brand", 7, 10).cast("int")
    variants = t.part.select("p_brand").distinct().select(
        F.col("p_brand").alias("label"), F.when(num % 2 == 0, "think: ").alias("prompt_prefix"),
        F.when(num % 5 == 0, "pad ").alias("padding"), F.when(num % 3 == 0, 0.7).alias("temperature"),
        F.when(num % 4 == 0, F.array(F.lit("O"))).alias("models"))
    tasks = t.part.agg(F.collect_set(F.lower("p_type")))
    defaults = {"models": F.array(F.lit("F"), F.lit("O"), F.lit("P")), "tasks": F.col("tasks"),
                "profiles": F.array(F.lit("base")), "reps": F.lit(3), "temperature": F.lit(0.2)}
    return joins.expand_experiment(variants.withColumn("tasks", tasks.scalar()), defaults).select(
        "variant_label", "model", "task", "run_number", "profile", "temperature", "prompt_prefix")


@query("reference_integrity", f"""WITH {RUNS_CTE}
SELECT task AS name, 'task' AS kind, count(*) AS uses FROM runs WHERE task NOT IN (SELECT lower(p_type) || '-01' FROM part) GROUP BY 1
UNION ALL SELECT profile, 'profile', count(*) FROM runs WHERE profile NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3') GROUP BY 1""")
def reference_integrity(t):
    tasks = t.part.select(F.concat(F.lower("p_type"), F.lit("-01")).alias("task")).distinct()
    profiles = t.orders.select(F.col("o_orderpriority").alias("profile")).where("profile < '3'").distinct()
    used = pin(t.runs.groupBy("task", "profile").agg(F.count("*").alias("n")), "used")
    a = joins.missing_refs(used, tasks, "task", "n").select(F.col("task").alias("name"), F.lit("task").alias("kind"), "uses")
    b = joins.missing_refs(used, profiles, "profile", "n").select(F.col("profile").alias("name"), F.lit("profile").alias("kind"), "uses")
    return a.unionByName(b)


_TIES = ["k1", "k2", "k3", "k4", "loc", "input_tokens", "output_tokens"]
_BEST_CTE = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, task, profile ORDER BY coalesce(composite, 0) DESC, k1, k2, k3, k4, loc, input_tokens, output_tokens) AS rn FROM scored) WHERE rn = 1)"""


def best_runs(t, by=("model", "task", "profile")):
    return ranking.best_row(t.scored, list(by), "composite", _TIES, ["composite", *_TIES])


@query("profile_pairs", f"""WITH {SCORED_CTE}, {_BEST_CTE}, b AS (SELECT *, CASE WHEN k1 % 10 <> 0 THEN 'out-' || k1 || '-' || k2 ELSE '' END AS code_output FROM best)
SELECT x.model, x.task, x.profile AS profile_a, y.profile AS profile_b, x.code_output AS code_output_a, y.code_output AS code_output_b
FROM b x JOIN b y ON x.model = y.model AND x.task = y.task AND x.profile < y.profile WHERE x.code_output <> '' AND y.code_output <> ''""")
def profile_pairs(t):
    out = F.when(F.col("k1") % 10 != 0, F.concat(F.lit("out-"), F.col("k1").cast("string"), F.lit("-"), F.col("k2").cast("string"))).otherwise("")
    return joins.output_pairs(best_runs(t).withColumn("code_output", out), ["model", "task"])


@query("variant_config_join", f"""WITH {RUNS_CTE}, x AS (SELECT CASE WHEN k2 < 7 THEN 'temp-' || (k2 % 4) END AS variant_label, CASE WHEN k2 = 2 THEN 0.9 END AS t FROM runs),
 v(label, prompt_prefix, temperature) AS (VALUES ('temp-0', 'short', 0.0), ('temp-1', NULL, 0.3), ('temp-2', 'long', 0.6))
SELECT variant_label, prompt_prefix, CAST(coalesce(t, temperature) AS DOUBLE) AS temperature, count(*) AS n FROM x LEFT JOIN v ON variant_label = label GROUP BY 1, 2, 3""")
def variant_config_join(t):
    variants = t.spark.sql("""SELECT * FROM VALUES ('temp-0', 'short', 0.0D), ('temp-1', NULL, 0.3D), ('temp-2', 'long', 0.6D)
        AS v(variant_label, prompt_prefix, temperature)""")
    runs = t.runs.select(F.when(F.col("k2") < 7, F.concat(F.lit("temp-"), (F.col("k2") % 4).cast("string"))).alias("variant_label"),
                         F.when(F.col("k2") == 2, 0.9).alias("temperature"))
    return joins.with_variant_config(runs, variants).groupBy("variant_label", "prompt_prefix", "temperature").agg(F.count("*").alias("n"))
