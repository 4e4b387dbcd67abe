"""Scoring expressions at their boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import labels, scoring
from scorewright.functions.numeric import finite, round_to
from scorewright.operators import filters


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_test_pass_rate(spark):
    got = values(spark, [(0, 0), (3, 4), (5, 5)], "p int, t int", scoring.test_pass_rate("p", "t"))
    assert got == [(0.0,), (75.0,), (100.0,)]


def test_lint_score(spark):
    got = values(spark, [(0, 0), (5, 100), (1000, 10), (0, 10)], "e int, n int", scoring.lint_score("e", "n"))
    assert got == [(100.0,), (50.0,), (0.0,), (100.0,)]


def test_complexity_score(spark):
    xs = [(0.0,), (0.5,), (1.0,), (5.0,), (10.0,), (20.0,), (30.0,), (40.0,), (50.0,), (90.0,)]
    got = values(spark, xs, "x double", scoring.complexity_score("x"))
    assert [g[0] for g in got] == [100, 100, 100, 80, 60, 40, 20, 5, 0, 0]


def test_complexity_grade(spark):
    got = values(spark, [(5.0,), (5.1,), (41.0,), (None,)], "x double",
                 scoring.complexity_grade("x"), scoring.complexity_label("x"))
    assert got == [("A", "Simple"), ("B", "Moderate"), ("F", "Untestable"), (None, None)]


def test_composite_falls_back_to_static(spark):
    got = values(spark, [(80.0, 60.0), (80.0, None)], "s double, j double",
                 scoring.composite("s", "j"), scoring.static_only("j"))
    assert got == [(70.0, False), (80.0, True)]


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        scoring.composite("s", "j", 0.5, 0.6)
    scoring.check_weights({"a": 0.5, "b": 0.5005})


def test_static_total_with_overrides(spark):
    runs = spark.createDataFrame([("a", 100.0, 50.0, 0.0), ("b", 100.0, 50.0, 0.0), ("c", 100.0, 50.0, 0.0)],
                                 "task string, test_pass_rate double, lint_score double, complexity_score double")
    weights = spark.createDataFrame([("b", 0.0, 1.0, 0.0), ("c", 0.9, 0.9, 0.9)],
                                    "task string, w_test_pass_rate double, w_lint_score double, w_complexity_score double")
    got = {r.task: r.static_total for r in scoring.static_total(runs, weights).collect()}
    assert got == {"a": 65.0, "b": 50.0, "c": 65.0}


def test_judge_normalized(spark):
    got = values(spark, [(3, 4, 3, 4), (1, 1, 1, 1), (5, None, 5, 5)], "a int, b int, c int, d int",
                 scoring.judge_normalized(scoring.judge_average(["a", "b", "c", "d"])))
    assert [g[0] for g in got] == [62.5, 0.0, 100.0]


def test_points_per_1k(spark):
    got = values(spark, [(70.0, 1000, 4000), (70.0, 0, 0)], "s double, c int, i int", scoring.points_per_1k("s", "c", "i"))
    assert [g[0] for g in got] == [14.0, 0.0]


@pytest.mark.parametrize("prices, cost", [((1.0, 5.0), 0.014), ((3.0, 15.0), 0.042), ((5.0, 25.0), 0.07)])
def test_run_cost(spark, prices, cost):
    row = spark.range(1).select(scoring.run_cost(F.lit(4000), F.lit(2000), F.lit(prices[0]), F.lit(prices[1]))).first()
    assert row[0] == pytest.approx(cost)


def test_failed_scorers(spark):
    got = values(spark, [(1.0, 1.0), (None, 1.0), (1.0, None)], "s double, j double",
                 scoring.failed_scorers("s", "j"), scoring.failed_scorers("s", "j", skip_judge=True))
    assert got == [([], []), (["static"], ["static"]), (["llm_judge"], [])]


def test_flatten_scores(spark):
    nested = ('{"static": {"test_pass_rate": 50, "lint_score": 1.5, "complexity_score": 2}, "llm": {"normalized": 75},'
              ' "composite": {"composite": 72.5, "static_only": false}, "degraded": false}')
    rows = [(nested,), ('{"composite": 80, "llm_quality": 75.5, "degraded": true, "note": "x", "more": {"a": 1}}',),
            ('{"composite": null, "degraded": true}',), ("broken {",), (None,), ('{"a": "95"}',)]
    got = [g[0] for g in values(spark, rows, "raw string", scoring.flatten_scores("raw"))]
    assert got == [
        {"composite": 72.5, "test_pass_rate": 50.0, "lint_score": 1.5, "complexity_score": 2.0, "llm_quality": 75.0},
        {"composite": 80.0, "llm_quality": 75.5}, {}, {}, {}, {"a": 95.0}]


def test_run_quality_policies(spark):
    rows = [({"composite": 90.0, "x": 10.0},), ({"x": 10.0, "y": 20.0},), ({},), ({"composite": float("nan")},)]
    got = values(spark, rows, "m map<string,double>", scoring.run_quality("m"), scoring.run_quality("m", "prefer_composite"))
    assert got == [(50.0, 90.0), (15.0, 15.0), (None, None), (None, None)]


def test_finite(spark):
    got = values(spark, [(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double", finite("x"))
    assert [g[0] for g in got] == [1.0, None, None, None, None]


def test_round_to_is_stable_at_ties(spark):
    rows = [(0.125,), (0.125 - 1e-15,), (2.675,), (-0.5,)]
    got = values(spark, rows, "x double", round_to("x", 2))
    assert [g[0] for g in got] == [0.13, 0.13, 2.68, -0.5]


def test_error_class(spark):
    cases = {
        "Rate limit exceeded": "transient", "HTTP 529": "transient", "SSO session has EXPIRED": "auth",
        "rate limit, then token expired": "auth", "No Python files found in x": "deterministic",
        "no python files found": "other", "Timeout": "other", "": None, None: None}
    got = values(spark, [(k,) for k in cases], "e string", "e", labels.error_class("e"))
    assert dict(got) == cases


def test_keys_and_labels(spark):
    row = spark.range(1).select(
        labels.run_key(F.lit("m"), F.lit("p"), F.lit("t"), F.lit(3), F.lit("")),
        labels.run_key(F.lit("m"), F.lit("p"), F.lit("t"), F.lit(3), F.lit("v")),
        labels.variant_key(F.lit("empty"), F.lit("temp-0.0")), labels.variant_label(F.lit("empty:temp-0.0")),
        labels.variant_label(F.lit("plain")), labels.task_category(F.lit("bug-fix-01")),
        labels.task_category(F.lit("fizzbuzz")), labels.task_category(F.lit("task-abc")),
        labels.dimension_label(F.lit("llm_quality")), labels.dimension_label(F.lit("edge_case_depth")),
        labels.short_tokens(F.lit(1234)), labels.short_tokens(F.lit(999)), labels.signed_pct(F.lit(0.034))).first()
    assert list(row) == ["m/p/t/run-3", "m/p/t/v/run-3", "empty:temp-0.0", "temp-0.0", "plain", "bug-fix", "fizzbuzz",
                         "task-abc", "LLM Quality", "Edge Case Depth", "1.2k", "999", "+3.4%"]


def test_tiers_and_effects(spark):
    got = values(spark, [(90.0, 0.1), (70.0, -0.3), (50.0, 0.5), (49.9, 0.8), (None, None)], "s double, d double",
                 labels.score_tier("s"), labels.effect_label("d"))
    assert got == [("excellent", "negligible"), ("good", "small"), ("fair", "medium"), ("poor", "large"), (None, None)]


def test_violations(spark):
    df = spark.createDataFrame([(101.0,), (50.0,), (-1.0,)], "s double")
    got = filters.violations(df, {"in_range": F.col("s").between(0, 100), "positive": F.col("s") > -5}).collect()
    assert {r.rule: (r.n_bad, r.n) for r in got} == {"in_range": (2, 3), "positive": (0, 3)}


def test_repeated_keys_and_values_that_are_not_finite(spark):
    from scorewright.functions import scoring, text as tx
    from scorewright.functions.numeric import round_to

    df = spark.createDataFrame([('{"a": 1, "b": 5, "a": 2}', "---\nname: old\nname: new\n---\nbody")], "raw string, doc string")
    row = df.select(scoring.flatten_scores("raw"), tx.front_matter_map("doc")).first()
    assert (row[0], row[1]) == ({"a": 2.0, "b": 5.0}, {"name": "new"})
    got = spark.range(1).select(*[round_to(F.lit(x), 2) for x in (float("nan"), float("inf"), float("-inf"), 1e300, -1.005, 2.675)]).first()
    assert list(got)[:4] == [None] * 4 and list(got)[4:] == [-1.0, 2.68]


def test_rules_on_tasks_and_statistics(spark):
    from scorewright.operators import filters

    rows = [("bug-fix", None, None, None, None, "function"), ("refactor", "x", None, None, None, "module"), ("instruction", None, None, "", None, "huge"),
            ("instruction", None, None, None, "p", None), (None, None, None, None, None, "function")]
    df = spark.createDataFrame(rows, "task_type string, starter_code string, starter_files string, task_rules string, prompt_rules string, size string")
    assert {r.rule: r.n_bad for r in filters.violations(df, filters.task_rules()).collect()} == {"starter_present": 1, "rules_present": 1, "size_known": 2}
    stat = spark.createDataFrame([(-1.0, 0, 0.5), (0.0, 3, 0.6)], "s double, n int, w double")
    got = {r.rule: r.n_bad for r in filters.violations(stat, filters.statistic_rules(F.col("s"), F.col("n"), [F.col("w"), F.lit(0.4)])).collect()}
    assert got == {"spread_not_negative": 1, "count_positive": 1, "weights_add_up": 1}


def test_sanitizing_at_any_depth(spark):
    from scorewright.functions.numeric import sanitized

    nan, inf = float("nan"), float("inf")
    schema = ("id int, `a.b` double, f float, s struct<x:double,y:struct<z:array<double>>,name:string>, m map<string,array<struct<v:double>>>, "
              "plain array<int>, k map<double,string>")
    row = (1, nan, inf, (inf, ([1.0, nan, None, -inf],), "n"), {"a": [(nan,), (2.0,), None], "b": None}, [1, None], {1.5: "x"})
    df = spark.createDataFrame([row, (2, 0.5, 1.5, None, None, None, None)], schema)
    got = sanitized(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    one, two = got.orderBy("id").collect()
    assert one.asDict(recursive=True) == {
        "id": 1, "a.b": None, "f": None, "s": {"x": None, "y": {"z": [1.0, None, None, None]}, "name": "n"},
        "m": {"a": [{"v": None}, {"v": 2.0}, None], "b": None}, "plain": [1, None], "k": {1.5: "x"}}
    assert tuple(two) == (2, 0.5, 1.5, None, None, None, None)
