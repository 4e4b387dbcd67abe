"""Both record layouts on disk, broken files, exports and the catalog."""

import json

import pytest
from pyspark.sql import functions as F

from scorewright.operators import filters
from scorewright.sources import catalog, dimensions, runs as src, schemas, sinks


@pytest.fixture()
def results(tmp_path):
    """A results folder with runs of both layouts, a broken file and a foreign one."""
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))

    put("set1/sonnet/my profile/code-gen-01/run-1.json", {
        "task_name": "code-gen-01", "profile_name": "my profile", "model": "sonnet", "run_number": 1, "status": "success",
        "input_tokens": 10, "output_tokens": 5, "total_tokens": 15, "cost": 0.5, "variant_label": "v1",
        "scores": {"composite": {"composite": 72.5}, "static": {"test_pass_rate": 90.0, "lint_score": 80.0,
                   "complexity_score": 70.0}, "llm": {"normalized": 60.0}, "degraded": False}})
    put("set1/sonnet/my profile/code-gen-01/run-2.json", {"status": "failure", "error": "Rate limit", "run_number": 2, "scores": None})
    put("set1/runs/opus/my profile/bug-fix-01/run_001.json", {
        "run_number": 1, "success": True, "wall_clock_seconds": 2.5, "error": None,
        "usage": {"input_tokens": 7, "output_tokens": 3, "cache_read_input_tokens": 1000},
        "output_files": {"notes.md": "n", "main.py": "print(1)"}, "timestamp": "2026-01-01T00:00:00Z"})
    put("set1/elsewhere/run_002.json", {"run_number": 2, "success": False})
    put("set1/x/run-3.json", '{"status": "succ')
    put("set1/x/run-4.json", {"hello": 1})
    put("set1/x/run-5.json", "[1, 2]")
    put("set1/other.json", {"status": "success"})
    put("set1/manifest.json", {"timestamp": "2026-01-01", "models": ["sonnet", "haiku"], "tasks": ["code-gen-01"], "profiles": ["my profile"]})
    put("set2/manifest.json", "{broken")
    return str(tmp_path)


def test_read_both_layouts(spark, results):
    got = {(r.model, r.profile, r.task, r.run_number): r for r in src.read_runs(spark, results).collect()}
    assert set(got) == {("sonnet", "my profile", "code-gen-01", 1), ("unknown", "unknown", "unknown", 2),
                        ("opus", "my profile", "bug-fix-01", 1)} or len(got) == 3
    a = got[("sonnet", "my profile", "code-gen-01", 1)]
    assert a.success and a.token_count == 15 and a.variant_label == "v1"
    assert a.scores == {"composite": 72.5, "test_pass_rate": 90.0, "lint_score": 80.0, "complexity_score": 70.0, "llm_quality": 60.0}
    b = got[("opus", "my profile", "bug-fix-01", 1)]
    assert (b.token_count, b.code_output, b.scores, b.success) == (10, "print(1)", {}, True)
    assert src.read_runs(spark, results, "parallel").count() == 2
    assert src.read_runs(spark, results, "storage").count() == 2


def test_quarantine(spark, results):
    good, bad = src.split_valid(src.scan_run_files(spark, results))
    assert good.count() == 4
    reasons = sorted((r.source_file.rsplit("/", 1)[1], r.reason) for r in bad.collect())
    assert ("run-3.json", "corrupt") in reasons and ("run-4.json", "unrecognized") in reasons
    assert any(name == "run-5.json" for name, _ in reasons)


def test_manifests(spark, results):
    manifests = src.read_manifests(spark, results)
    assert [r.run_set for r in manifests.collect()] == ["set1"]
    runs = src.read_runs(spark, results).withColumn("run_set", F.lit("set1"))
    merged = src.merge_manifest(
        src.observed(runs, ["run_set"], {"models": "model", "tasks": "task"}), manifests, ["run_set"], ["models", "tasks"]).first()
    assert merged.models == ["haiku", "opus", "sonnet", "unknown"]
    assert merged.total_combinations == len(merged.models) * len(merged.tasks)
    named = spark.createDataFrame([("set1",), ("set2",)], "run_set string")
    got = {r.run_set: (r.is_valid, r.reason) for r in src.validate_run_sets(named, runs, manifests).collect()}
    assert got == {"set1": (True, ""), "set2": (False, "missing manifest")}


def test_latest(spark):
    df = spark.createDataFrame([("m", "2026-01", True), ("m", "2026-03", False), ("m", "2026-02", True)], "model string, name string, ok boolean")
    assert src.latest_per_group(df, ["model"], "name", F.col("ok"), ["name"]).first().name == "2026-02"


def test_csv_round_trip(spark, tmp_path):
    runs = spark.createDataFrame(
        [("p", "t", "m", True, None, 5, 'say "hi",\nthere', None, {"x": float("nan"), "y": 2.0})],
        "profile string, task string, model string, success boolean, error string, token_count long, code_output string, variant_label string, scores map<string,double>")
    wide = sinks.to_wide(runs, ["x", "y"])
    sinks.write_csv(wide, str(tmp_path / "csv"))
    row = sinks.read_csv(spark, str(tmp_path / "csv"), wide._jdf.schema().toDDL()).first()
    assert (row.code_output, row.score_x, row.score_y, row.token_count) == ('say "hi",\nthere', None, 2.0, 5)
    sinks.write_csv(wide.limit(0), str(tmp_path / "empty"))


def test_json_pages_hold_every_run_once(spark, tmp_path):
    runs = spark.range(1000).select(
        F.lit("p").alias("profile"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("task"), "id",
        F.create_map(F.lit("x"), F.when(F.col("id") == 1, float("inf")).otherwise(F.col("id").cast("double"))).alias("scores"))
    sinks.write_json(runs.withColumn("id", F.col("id")), str(tmp_path / "j"), ["id"])
    paged = sinks.nested(runs, ["id"], size=100)
    assert paged.where("task = 'hot'").count() > 5
    assert paged.select(F.explode("runs.id")).distinct().count() == 1000
    assert paged.agg(F.sum(F.size("runs"))).first()[0] == 1000
    assert paged.agg(F.max(F.size("runs"))).first()[0] < 200


def test_store_overwrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", "p", "t", 1), ("b", "p", "t", 2)], "model string, profile string, task string, v int")
    sinks.write_runs(df, path)
    sinks.write_runs(df.where("model = 'b'").withColumn("v", F.lit(9)), path)
    assert {(r.model, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}


def test_profiles(spark, tmp_path):
    (tmp_path / "terse.md").write_text('---\nname: Terse\ndescription: "Short: yes"\nvariant: b\n---\n\n# Be brief\n---\nmore\n')
    (tmp_path / "plain.md").write_text("Just text\n")
    (tmp_path / "empty.md").write_text("")
    got = {r.slug: r for r in dimensions.read_profiles(spark, str(tmp_path)).collect()}
    assert (got["terse"].name, got["terse"].description, got["terse"].variant) == ("Terse", "Short: yes", "b")
    assert got["terse"].content == "# Be brief\n---\nmore"
    assert (got["plain"].name, got["plain"].description, got["plain"].content, got["plain"].tokens) == (
        "plain", "Custom profile (plain.md)", "Just text", 2)


def entries(spark, *rows):
    blank = dict.fromkeys(["timestamp", "experiment_name", "intake_timestamp"])
    base = {**blank, "tags": [], "models": [], "profiles": [], "tasks": [], "variants": [], "total_runs": 1}
    return spark.createDataFrame([{**base, **r} for r in rows], schemas.CATALOG)


def test_catalog(spark):
    cat = entries(spark, {"run_id": "run-001", "name": "First sweep", "results_path": "/r/one", "tags": ["a"]},
                  {"run_id": "run-004", "name": "Second", "results_path": "/r/two", "tags": ["b"]})
    new = entries(spark, {"run_id": None, "name": None, "results_path": "/r/two"}, {"run_id": None, "name": None, "results_path": "/r/three"})
    merged, rejected = catalog.intake(cat, new)
    assert {(r.run_id, r.name) for r in merged.collect()} == {("run-001", "First sweep"), ("run-004", "Second"), ("run-005", "three")}
    assert [r.results_path for r in rejected.collect()] == ["/r/two"]
    forced, _ = catalog.intake(cat, new, force=True)
    assert {(r.run_id, r.results_path) for r in forced.collect()} == {("run-001", "/r/one"), ("run-005", "/r/three"), ("run-006", "/r/two")}
    assert catalog.remove(cat, cat.where("run_id = 'run-001'")).count() == 1
    tags = spark.createDataFrame([("run-001", ["z", "a"])], "run_id string, tags array<string>")
    assert {r.run_id: r.tags for r in catalog.tag(cat, tags).collect()} == {"run-001": ["a", "z"], "run-004": ["b"]}
    found = filters.catalog_find(cat, ["run-004"], ["a"], ["SWEEP"]).orderBy("match_rank").collect()
    assert [(r.run_id, r.match_rank) for r in found] == [("run-004", 1), ("run-001", 2)]


def test_sums_beside_the_store(spark, tmp_path):
    import pathlib
    import statistics

    path = str(tmp_path / "store")
    rows = [(m, p, t, float(i) if i % 7 else None) for i, (m, p, t) in enumerate((m, p, t) for m in "mn" for p in "pq" for t in "tu" for _ in range(9))]
    make = lambda some: spark.createDataFrame(some, "model string, profile string, task string, v double")
    sinks.store_runs(make(rows), path, ["v"])
    stamps = lambda: {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet") if "model=n" in str(f)}
    before = stamps()
    again = [(m, p, t, 5.0) for m, p, t, _ in rows if m == "m"][:20]
    sinks.store_runs(make(again), path, ["v"])
    assert stamps() == before and len(before) == 8  # of four partitions the runs and the sums
    # The rewrite replaced the partitions it holds.
    now = [r for r in rows if r[0] == "n" or r[:3] not in {a[:3] for a in again}] + again
    assert spark.read.parquet(path).count() == len(now)
    found = sinks.read_sums(spark, path, ["model"], ["v"])
    assert all("/_sums/" in f for f in found.inputFiles())
    for r in found.collect():
        v = [x[3] for x in now if x[0] == r["model"] and x[3] is not None]
        assert (r["runs"], r["v_n"], r["v_min"], r["v_max"]) == (sum(x[0] == r["model"] for x in now), len(v), min(v), max(v))
        assert r["v_mean"] == pytest.approx(statistics.mean(v)) and r["v_stdev"] == pytest.approx(statistics.stdev(v))
    manifest = sinks.read_manifest(spark, path).first()
    assert tuple(manifest) == (["m", "n"], ["p", "q"], ["t", "u"], len(now))


def test_record_files_are_packed(spark):
    import pathlib

    import __spark_entry__ as entry

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    for name, folder in (("scan_parallel_runs", "parallel"), ("scan_storage_runs", "storage"), ("incremental_ingest", "arrivals")):
        before = set(base.glob(f"{folder}-*"))
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        (fresh,) = set(base.glob(f"{folder}-*")) - before
        parts = list(fresh.rglob("part-*"))
        assert parts and all(p.name.endswith(".gz") for p in parts)


def test_scores_need_not_travel_with_a_run(spark):
    raw = spark.createDataFrame([("m", '{"composite": 1.5, "other": "2"}'), ("n", None)], "model string, scores string")
    raw = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in spark.createDataFrame([], schemas.RUN_RECORD).schema], F.lit("f").alias("source_file"))
    fields, whole = src.parallel_fields(raw), src.parse_parallel(raw)
    assert not any(f.dataType.typeName() == "map" for f in fields.schema)
    assert whole.columns == src.with_scores(fields.dropDuplicates(["model"])).columns
    assert {r["model"]: r["scores"] for r in whole.collect()} == {"m": {"composite": 1.5, "other": 2.0}, "n": {}}
