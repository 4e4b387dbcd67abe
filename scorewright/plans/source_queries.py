"""Reading, writing and cataloguing runs: records are derived from the sample runs, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators import filters
from ..session import pin, scratch
from ..sources import catalog, dimensions, runs as src, sinks
from .aggregating_queries import r
from .bindings import DIMS, RUNS_CTE, SCORED_CTE
from .registry import query, rnd

_LINES = {"pattern": "part-*", "multi_line": False}
_ORDER = ["k1", "k2", "k3", "k4"]
#: How record files are written: a record as text takes some ten times what it takes packed.
PACKED = {"compression": "gzip"}


def parallel_records(scored):
    """Parallel-layout records of runs; odd lines nest their scores, even ones have them flat."""
    flat = F.to_json(F.struct(*DIMS))
    nest = F.to_json(F.struct(
        F.struct("test_pass_rate", "lint_score", "complexity_score").alias("static"),
        F.struct(F.col("llm_quality").alias("normalized")).alias("llm"), F.struct("composite").alias("composite")))
    scores = F.when(F.col("success"), F.when(F.col("k2") % 2 == 0, flat).otherwise(nest))
    # The scores are already JSON, so the record is put together as text around them.
    head = F.to_json(F.struct(
        F.when(F.col("k2") != 7, F.col("task")).alias("task_name"), F.col("profile").alias("profile_name"), "model",
        F.col("k2").alias("run_number"), F.when(F.col("success"), "success").otherwise("failure").alias("status"), "error",
        "input_tokens", "output_tokens", F.col("token_count").alias("total_tokens"), "duration_seconds",
        F.when(F.col("run_set") % 2 == 0, F.concat(F.lit("v"), F.col("run_set").cast("string"))).alias("variant_label")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "scores": '), F.coalesce(scores, F.lit("null")), F.lit("}"))


def _write(df, spark, name):
    path = scratch(spark, name)
    df.write.options(**PACKED).text(path)
    return path


@query("scan_parallel_runs", f"""WITH {SCORED_CTE}
SELECT model, profile, CASE WHEN k2 <> 7 THEN task ELSE 'unknown' END AS task, CASE WHEN run_set % 2 = 0 THEN 'v' || run_set END AS variant_label,
  count(*) AS n, count(CASE WHEN success THEN 1 END) AS succeeded, sum(token_count)::BIGINT AS token_count, {rnd('sum(composite)', 2)} AS composite, {rnd('sum(llm_quality)', 2)} AS llm_quality
FROM scored GROUP BY 1, 2, 3, 4""")
def scan_parallel_runs(t):
    path = _write(t.scored.select(parallel_records(t.scored).alias("value")), t.spark, "parallel")
    runs = src.read_runs(t.spark, path, "parallel", **_LINES)
    return runs.groupBy("model", "profile", "task", "variant_label").agg(
        F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.sum("token_count").alias("token_count"),
        round_to(F.sum(F.col("scores")["composite"]), 2).alias("composite"),
        round_to(F.sum(F.col("scores")["llm_quality"]), 2).alias("llm_quality"))


def storage_records(runs):
    return F.struct(
        F.col("k2").alias("run_number"), "success", F.col("duration_seconds").alias("wall_clock_seconds"),
        F.struct("input_tokens", "output_tokens", F.lit(1000000).alias("cache_read_input_tokens")).alias("usage"),
        F.when(F.col("k2") % 2 == 0, F.create_map(F.lit("note.md"), F.lit("n"), F.lit("main.py"), F.lit("code"))).alias("output_files"), "error")


@query("scan_storage_runs", f"""WITH {RUNS_CTE}
SELECT model, profile, task, CASE WHEN k2 % 2 = 0 THEN 'code' ELSE '' END AS code_output, count(*) AS n, count(CASE WHEN success THEN 1 END) AS succeeded,
  sum(input_tokens + output_tokens)::BIGINT AS token_count, 0::BIGINT AS dimensions FROM runs GROUP BY 1, 2, 3, 4""")
def scan_storage_runs(t):
    runs = t.runs
    path = scratch(t.spark, "storage")
    (runs.select("model", "profile", "task", F.to_json(storage_records(runs)).alias("value"))
     .hint("rebalance", "model", "profile", "task").write.options(**PACKED).partitionBy("model", "profile", "task").text(f"{path}/runs"))
    back = src.read_runs(t.spark, path, "storage", **_LINES)
    return back.groupBy("model", "profile", "task", "code_output").agg(
        F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.sum("token_count").alias("token_count"),
        F.sum(F.size("scores")).cast("bigint").alias("dimensions"))


def _mixed(t):
    """Records of both layouts with broken and foreign ones between them."""
    scored = t.scored
    k = F.col("k1") % 10
    value = (F.when(k < 4, parallel_records(scored)).when(k < 8, F.to_json(storage_records(scored)))
             .when(k == 8, F.lit('{"status": "succ')).otherwise(F.lit('{"hello": 1}')))
    return _write(scored.select(value.alias("value")), t.spark, "mixed")


@query("union_run_formats", f"""WITH {RUNS_CTE}
SELECT CASE WHEN k1 % 10 < 4 THEN model ELSE 'unknown' END AS model, success, count(*) AS n, sum(input_tokens + output_tokens)::BIGINT AS token_count
FROM runs WHERE k1 % 10 < 8 GROUP BY 1, 2""")
def union_run_formats(t):
    runs = src.read_runs(t.spark, _mixed(t), **_LINES)
    return runs.groupBy("model", "success").agg(F.count("*").alias("n"), F.sum("token_count").alias("token_count"))


@query("quarantine_corrupt", f"""WITH {RUNS_CTE}
SELECT CASE k1 % 10 WHEN 8 THEN 'corrupt' ELSE 'unrecognized' END AS reason, count(*) AS n, CASE k1 % 10 WHEN 8 THEN '{{"status": "succ' END AS record
FROM runs WHERE k1 % 10 >= 8 GROUP BY 1, 3""")
def quarantine_corrupt(t):
    _, bad = src.split_valid(src.scan_run_files(t.spark, _mixed(t), **_LINES))
    return bad.groupBy("reason", "record").agg(F.count("*").alias("n"))


@query("manifest_merge", f"""WITH {RUNS_CTE}, f AS (SELECT DISTINCT run_set, model, task FROM runs WHERE run_set > 1995),
 m AS (SELECT DISTINCT run_set, model || '-x' AS model, task FROM runs WHERE run_set < 2000 AND task LIKE '%-02'),
 u AS (SELECT * FROM f UNION SELECT * FROM m)
SELECT run_set, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks, count(DISTINCT model) * count(DISTINCT task) AS total_combinations FROM u GROUP BY 1""")
def manifest_merge(t):
    names = pin(t.runs.select("run_set", "model", "task").distinct(), "names")
    found = src.observed(names.where("run_set > 1995"), ["run_set"], {"models": "model", "tasks": "task"})
    planned = names.where("run_set < 2000 AND task LIKE '%-02'").withColumn("model", F.concat("model", F.lit("-x")))
    manifests = src.observed(planned, ["run_set"], {"models": "model", "tasks": "task"})
    merged = src.merge_manifest(found, manifests, ["run_set"], ["models", "tasks"])
    return merged.select("run_set", F.array_join("models", ",").alias("models"), F.array_join("tasks", ",").alias("tasks"), "total_combinations")


@query("latest_run_set", f"""WITH {RUNS_CTE}, s AS (SELECT model, profile, loc, run_set, count(*) AS runs, count(CASE WHEN NOT success THEN 1 END) AS failed FROM runs GROUP BY 1, 2, 3, 4)
SELECT model, profile, loc, max(run_set) AS run_set, arg_max(runs, run_set) AS runs FROM s WHERE failed < 2 GROUP BY 1, 2, 3""")
def latest_run_set(t):
    sets = t.runs.groupBy("model", "profile", "loc", "run_set").agg(
        F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failed"))
    return src.latest_per_group(sets, ["model", "profile", "loc"], "run_set", F.col("failed") < 2, ["run_set", "runs"])


@query("task_dimension", """WITH d AS (SELECT p_partkey, p_name, lower(p_type) AS task_type, CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 35 THEN 'medium' ELSE 'hard' END AS difficulty,
   CASE WHEN p_size % 7 > 0 THEN 'About ' || p_brand END AS description FROM part)
SELECT p_name || '-' || p_partkey AS name, description FROM d WHERE task_type IN ('economy', 'promo') AND difficulty = 'hard' AND p_name LIKE '% widget' AND description IS NOT NULL""")
def task_dimension(t):
    size = F.col("p_size")
    df = t.part.select(
        F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.lower("p_type").alias("task_type"),
        F.when(size <= 15, "easy").when(size <= 35, "medium").otherwise("hard").alias("difficulty"),
        F.when(size % 7 > 0, F.concat(F.lit("About "), "p_brand")).alias("description"), F.split("p_name", " ").alias("tags"))
    return dimensions.Tasks(df).by_type("economy", "promo").by_difficulty("hard").by_tag("widget").descriptions()


@query("export_json", f"""WITH {SCORED_CTE}
SELECT profile, task, count(*) AS runs, count(CASE WHEN k2 <> 3 THEN composite END) AS finite_scores, {rnd('sum(CASE WHEN k2 <> 3 THEN composite END)', 2)} AS composite FROM scored GROUP BY 1, 2""")
def export_json(t):
    score = F.when(F.col("k2") == 3, float("nan")).otherwise(F.col("composite"))
    runs = t.scored.withColumn("scores", F.create_map(F.lit("composite"), score))
    path = scratch(t.spark, "json")
    sinks.write_json(runs, path, ["model", "success", "token_count", *_ORDER])
    back = t.spark.read.schema("profile string, task string, runs array<struct<model:string,scores:map<string,double>>>").json(path)
    flat = back.select("profile", "task", F.explode("runs").alias("r")).withColumn("c", F.col("r.scores")["composite"])
    return flat.groupBy("profile", "task").agg(
        F.count("*").alias("runs"), F.count("c").alias("finite_scores"), round_to(F.sum("c"), 2).alias("composite"))


@query("export_csv_wide", f"""WITH {SCORED_CTE}
SELECT model, success, coalesce(error, '') AS error, CASE WHEN run_set % 2 = 0 THEN 'v' || run_set END AS variant_label, count(*) AS n, sum(token_count)::BIGINT AS token_count,
  min('say "' || k1 || '",' || chr(10) || k2) AS first_output, {rnd('sum(composite)', 2)} AS score_composite, {rnd('sum(lint_score)', 2)} AS score_lint_score FROM scored GROUP BY 1, 2, 3, 4""")
def export_csv_wide(t):
    scores = F.map_from_arrays(F.array(F.lit("composite"), F.lit("lint_score")), F.array("composite", "lint_score"))
    runs = t.scored.select(
        "profile", "task", "model", "success", "error", "token_count", scores.alias("scores"),
        F.concat(F.lit('say "'), F.col("k1").cast("string"), F.lit('",\n'), F.col("k2").cast("string")).alias("code_output"),
        F.when(F.col("run_set") % 2 == 0, F.concat(F.lit("v"), F.col("run_set").cast("string"))).alias("variant_label"))
    wide = sinks.to_wide(runs, ["composite", "lint_score"])
    path = scratch(t.spark, "csv")
    sinks.write_csv(wide, path)
    back = sinks.read_csv(t.spark, path, wide._jdf.schema().toDDL())
    return back.groupBy("model", "success", F.coalesce("error", F.lit("")).alias("error"), "variant_label").agg(
        F.count("*").alias("n"), F.sum("token_count").alias("token_count"), F.min("code_output").alias("first_output"),
        round_to(F.sum("score_composite"), 2).alias("score_composite"), round_to(F.sum("score_lint_score"), 2).alias("score_lint_score"))


@query("partitioned_store", f"""WITH {RUNS_CTE}
SELECT model, profile, count(*) AS n, sum(CASE WHEN model = 'O' THEN 1 ELSE input_tokens END)::BIGINT AS tokens FROM runs WHERE model IN ('F', 'O') GROUP BY 1, 2""")
def partitioned_store(t):
    """Write all runs, write those of one model again with other values, read two models."""
    path = scratch(t.spark, "store")
    runs = t.runs.select("model", "profile", "task", *_ORDER, "input_tokens")
    sinks.write_runs(runs, path)
    sinks.write_runs(runs.where("model = 'O'").withColumn("input_tokens", F.lit(1).cast("bigint")), path)
    back = t.spark.read.parquet(path).where("model IN ('F', 'O')")
    return back.groupBy("model", "profile").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


@query("store_aggregates", f"""WITH {RUNS_CTE}, x AS (SELECT model, profile, task, CASE WHEN model = 'O' THEN loc * 2 ELSE input_tokens END AS v FROM runs),
 m AS (SELECT count(DISTINCT profile) AS profiles, count(DISTINCT task) AS tasks, count(*) AS total_runs FROM x)
SELECT model, profile, count(*) AS runs, count(v) AS n, {rnd('avg(v)', 4)} AS mean, {rnd('stddev_samp(v)', 3)} AS stdev, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high,
 any_value(profiles) AS profiles, any_value(tasks) AS tasks, any_value(total_runs) AS total_runs FROM x CROSS JOIN m GROUP BY 1, 2""")
def store_aggregates(t):
    """Store all runs, store those of one model again with other values; statistics and manifest come from the stored sums."""
    path = scratch(t.spark, "store")
    runs = t.runs.select("model", "profile", "task", *_ORDER, "loc", F.col("input_tokens").alias("v"))
    sinks.store_runs(runs, path, ["v"])
    sinks.store_runs(runs.where("model = 'O'").withColumn("v", F.col("loc").cast("bigint") * 2), path, ["v"])
    found = sinks.read_sums(t.spark, path, ["model", "profile"], ["v"])
    names = sinks.read_manifest(t.spark, path).select(
        F.size("profiles").cast("bigint").alias("profiles"), F.size("tasks").cast("bigint").alias("tasks"), "total_runs")
    return found.select("model", "profile", "runs", F.col("v_n").alias("n"), round_to("v_mean", 4).alias("mean"), round_to("v_stdev", 3).alias("stdev"),
                        F.col("v_min").alias("low"), F.col("v_max").alias("high")).withColumns(
        {c: names.select(c).scalar() for c in ("profiles", "tasks", "total_runs")})


@query("results_validity", f"""WITH {RUNS_CTE}, s AS (SELECT DISTINCT year(o_orderdate) + x AS run_set FROM orders, (VALUES (0), (50)) v(x)), c AS (SELECT run_set, count(*) AS n FROM runs GROUP BY 1)
SELECT CAST(s.run_set AS INT) AS run_set, coalesce(n, 0) AS runs, CASE WHEN s.run_set % 3 = 0 THEN 'missing manifest' WHEN n IS NULL THEN 'no run records' ELSE '' END AS reason,
  s.run_set % 3 <> 0 AND n IS NOT NULL AS is_valid FROM s LEFT JOIN c ON s.run_set = c.run_set""")
def results_validity(t):
    year = F.year("o_orderdate")
    sets = t.orders.select(F.explode(F.array(year, year + 50)).alias("run_set")).distinct()
    return src.validate_run_sets(sets, t.runs, sets.where("run_set % 3 <> 0"))


def catalog_of(t):
    """Run sets as catalog entries: one per year and model."""
    g = t.runs.groupBy("run_set", "model").agg(
        F.array_sort(F.collect_set("profile")).alias("profiles"), F.array_sort(F.collect_set("task")).alias("tasks"), F.count("*").alias("total_runs"))
    label = F.concat_ws("-", F.lower("model"), F.col("run_set").cast("string"))
    return g.select(
        F.concat(F.lit("run-"), F.lpad(((F.col("run_set") - 1994) * 3 + F.instr(F.lit("FOP"), F.col("model")) - 1).cast("string"), 3, "0")).alias("run_id"),
        F.concat(F.lit("Sweep "), label).alias("name"), F.concat(F.col("run_set").cast("string"), F.lit("-07-01T12:00:00")).alias("timestamp"),
        F.concat(F.lit("/results/"), label).alias("results_path"),
        F.when(F.col("run_set") % 2 == 0, F.array(F.lit("even"), F.lit("sweep"))).otherwise(F.array(F.lit("sweep"))).alias("tags"),
        F.array("model").alias("models"), "profiles", "tasks", F.array().cast("array<string>").alias("variants"), "total_runs",
        F.lit(None).cast("string").alias("experiment_name"), F.lit("2024-01-01").alias("intake_timestamp"))


CATALOG_SQL = """cat AS (SELECT 'run-' || lpad(CAST((run_set - 1994) * 3 + strpos('FOP', model) - 1 AS VARCHAR), 3, '0') AS run_id, 'Sweep ' || lower(model) || '-' || run_set AS name,
  run_set || '-07-01T12:00:00' AS timestamp, '/results/' || lower(model) || '-' || run_set AS results_path, run_set, model, count(DISTINCT task) AS task_count, count(*) AS total_runs FROM runs GROUP BY run_set, model)"""
_CATALOG_CTE = RUNS_CTE + ", " + CATALOG_SQL


@query("catalog_find", f"""WITH {_CATALOG_CTE}
SELECT run_id, name, CASE WHEN run_id IN ('run-005', 'run-010') THEN 1 WHEN run_set % 2 = 0 THEN 2 ELSE 3 END AS match_rank FROM cat
WHERE run_id IN ('run-005', 'run-010') OR run_set % 2 = 0 OR lower(name) LIKE '%p-199%'""")
def catalog_find(t):
    return filters.catalog_find(catalog_of(t), ["run-005", "run-010", "run-999"], ["even", "none"], ["P-199"]).select("run_id", "name", "match_rank")


@query("catalog_list", f"""WITH {_CATALOG_CTE}
SELECT run_id, name, left(timestamp, 10) AS date, task_count, total_runs FROM cat WHERE run_set % 2 = 0 AND model = 'O'""")
def catalog_list(t):
    return filters.catalog_list(catalog_of(t), ["even"], "O", "promo-01").select(
        "run_id", "name", "date", F.col("task_count").cast("bigint").alias("task_count"), "total_runs")


@query("catalog_upsert", f"""WITH {_CATALOG_CTE}, old AS (SELECT * FROM cat WHERE run_set <= 1998), fresh AS (SELECT *, row_number() OVER (ORDER BY results_path) AS rn FROM cat WHERE run_set > 1996),
 mx AS (SELECT max(CAST(substr(run_id, 5) AS INT)) AS m FROM old)
SELECT 'run-' || lpad(CAST(m + rn AS VARCHAR), 3, '0') AS run_id, lower(model) || '-' || run_set AS name, results_path, 'new' AS tags FROM fresh CROSS JOIN mx
UNION ALL SELECT run_id, name, results_path, CASE WHEN model = 'F' THEN 'a,' || CASE WHEN run_set % 2 = 0 THEN 'even,sweep' ELSE 'sweep' END WHEN run_set % 2 = 0 THEN 'even,sweep' ELSE 'sweep' END
 FROM old WHERE run_set <= 1996 AND run_id <> 'run-005'""")
def catalog_upsert(t):
    """Replace known paths and add new ones, remove one entry, tag the entries of a model."""
    cat = catalog_of(t)
    year = F.right("name", F.lit(4)).cast("int")
    old = cat.where(year <= 1998)
    new = cat.where(year > 1996).withColumn("name", F.lit(None).cast("string")).withColumn("tags", F.array(F.lit("new")))
    merged, _ = catalog.intake(old, new, force=True)
    left = catalog.remove(merged, cat.where("run_id = 'run-005'"))
    tags = left.where(F.array_contains("models", "F") & ~F.array_contains("tags", "new")).select(
        "run_id", F.array(F.lit("a"), F.lit("sweep")).alias("tags"))
    return catalog.tag(left, tags).select("run_id", "name", "results_path", F.array_join("tags", ",").alias("tags"))
