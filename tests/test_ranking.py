"""Running totals, frontiers, samples and identifiers, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from scorewright.operators import aggregates, joins, prefix, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", i, rng.randint(1, 9)) for i in range(800)]
    return rows, spark.createDataFrame(rows, "g string, i int, v int").repartition(5)


def test_bucket_of_matches_bisect(spark):
    import bisect
    splits = [1.0, 2.5, 2.75, 4.0, 8.0, 9.0, 11.0]
    xs = [0.0, 1.0, 1.5, 2.5, 2.6, 3.0, 4.0, 8.5, 9.0, 10.0, 11.0, 12.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = dict(df.select("x", prefix.bucket_of("x", splits)).collect())
    assert got == {x: bisect.bisect_left(splits, x) for x in xs}


@pytest.mark.parametrize("buckets", [None, 2, 7, 64])
def test_running_sum(skewed, buckets):
    rows, df = skewed
    splits = prefix.range_splits(df, "i", buckets) if buckets else None
    got = {r.i: r.s for r in prefix.running(df, ["g"], ["i"], {"s": F.col("v")}, splits).collect()}
    totals, want = {}, {}
    for g, i, v in rows:
        totals[g] = totals.get(g, 0) + v
        want[i] = totals[g]
    assert got == want


@pytest.mark.parametrize("buckets", [None, 5])
def test_frontier(skewed, buckets):
    rows, df = skewed
    splits = prefix.range_splits(df, "i", buckets) if buckets else None
    got = {r.i for r in ranking.frontier(df, "i", "v", ["g"], splits=splits).collect()}
    best, want = {}, set()
    for g, i, v in rows:
        if v > best.get(g, -1):
            want.add(i)
            best[g] = v
    assert got == want


@pytest.mark.parametrize("buckets", [None, 5])
def test_cost_cap(skewed, buckets):
    rows, df = skewed
    splits = prefix.range_splits(df, "i", buckets) if buckets else None
    got = ranking.cost_cap(df, ["g"], ["i"], "v", 100.0, splits)
    for r in got.where("started").collect():
        assert r.running_cost - r.v < 100
    # The cap is reached at or above, and the run that reaches it still counts as started.
    hot = sorted((r.i, r.running_cost, r.cap_reached, r.started) for r in got.where("g = 'hot'").collect())
    first = next(x for x in hot if x[2])
    assert first[1] >= 100 and first[3]
    assert all(not x[3] for x in hot if x[0] > first[0])


def test_systematic_sample(skewed):
    rows, df = skewed
    splits = prefix.range_splits(df, "i", 6)
    got = ranking.systematic_sample(df, ["g"], ["i"], splits=splits).collect()
    by = {}
    for g, i, _ in rows:
        by.setdefault(g, []).append(i)
    want = {x for ids in by.values() for k, x in enumerate(ids, 1) if k % max(1, len(ids) // 10) == 0 or k == len(ids)}
    assert {r.i for r in got} == want


def test_assign_ids(spark):
    new = spark.createDataFrame([("b",), ("a",), ("c",)], "p string")
    old = spark.createDataFrame([("run-007",), ("run-legacy",), ("old-999",)], "run_id string")
    got = {r.p: r.run_id for r in ranking.assign_ids(new, old, "run_id", ["p"]).collect()}
    assert got == {"a": "run-008", "b": "run-009", "c": "run-010"}
    first = ranking.assign_ids(new.limit(1), old.where("run_id = 'x'"), "run_id", ["p"]).first().run_id
    assert first == "run-001"
    big = old.withColumn("run_id", F.lit("run-999"))
    assert ranking.assign_ids(new.limit(1), big, "run_id", ["p"]).first().run_id == "run-1000"


def test_top_k(skewed):
    rows, df = skewed
    got = ranking.top_k(df, ["g"], [F.col("v").desc(), "i"], 3).collect()
    hot = sorted(((-v, i) for g, i, v in rows if g == "hot"))[:3]
    assert [r.i for r in sorted((r for r in got if r.g == "hot"), key=lambda r: r.rank)] == [i for _, i in hot]
    assert {r.n_more for r in got if r.g == "hot"} == {sum(g == "hot" for g, _, _ in rows) - 3}


def test_top_k_cuts_before_the_shuffle(skewed):
    _, df = skewed
    plan = ranking.top_k(df, ["g"], ["i"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_best_row_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 5.0), ("a", 3, None), ("b", 1, None)], "g string, i int, s double")
    got = {r.g: (r.i, r.best_score) for r in ranking.best_row(df, ["g"], "s", ["i"], ["i"]).collect()}
    assert got == {"a": (1, 5.0), "b": (1, 0.0)}


def test_winners(spark):
    q = spark.createDataFrame([("p", 0.0, 5), ("q", 0.0, 0)], "profile string, quality double, tokens long")
    assert ranking.winners(q, "profile", "quality").first().profile == "N/A"
    assert ranking.efficiency_winner(q, "profile", "quality", "tokens", ["profile"]).count() in (0, 1)


def test_winner_margin_of_one_candidate(spark):
    df = spark.createDataFrame([("c", "p", 70.0)], "category string, profile string, quality double")
    row = ranking.winner_margin(df, ["category"], "profile", "quality").first()
    assert (row.winner, row.runner_up, row.margin, row.spread) == ("p", "p", 0.0, 0.0)


def test_weakest(spark):
    df = spark.createDataFrame([(10.0, 10.0, 50.0), (None, 80.0, 20.0)], "a double, b double, c double")
    w = ranking.weakest([("a", "a"), ("b", "b"), ("c", "c")])
    assert [r[0] for r in df.select(w).collect()] == ["a", "c"]


def test_overlap_and_pairs(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("B", 3), ("C", 2), ("C", 3)], "rs string, k int")
    assert joins.overlap(df, "rs", ["k"]).count() == 3
    assert joins.unique_keys(df, "rs", ["k"]).count() == 0
    pairs = joins.pairwise(df.select("rs", "k"), "rs", ["k"], [])
    assert {(r.rs_a, r.rs_b, r.k) for r in pairs.collect()} == {("A", "B", 1), ("A", "C", 2), ("B", "C", 3)}
    got = {r.rs: (r.combinations, r.unique_combinations, r.in_all_sets) for r in joins.intersect_all(df, "rs", ["k"]).collect()}
    assert got == {"A": (2, 0, 0), "B": (2, 0, 0), "C": (2, 0, 0)}


def test_matrix_and_resume(spark):
    plan = spark.sql("SELECT array('t1','t2') task, array('p') profile, array('m1','m2') model, 2 reps")
    matrix = joins.run_matrix(plan, ["task", "profile", "model"])
    assert matrix.count() == 8
    done = spark.createDataFrame([("t1", "p", "m1", 1, True), ("t1", "p", "m1", 2, False)],
                                 "task string, profile string, model string, run_number int, success boolean")
    keys = ["task", "profile", "model", "run_number"]
    assert joins.remaining(matrix, done, keys).count() == 6
    assert joins.remaining(matrix, done, keys, retry_failures=True).count() == 7
    summary = aggregates.plan_summary(matrix.withColumn("x", F.lit(1)), done, keys, ["x"]).first()
    assert (summary.tasks, summary.models, summary.total_runs, summary.reps, summary.skipped) == (2, 2, 8, 2, 2)


def test_grid_fills_missing_cells(spark):
    df = spark.createDataFrame([("m1", "p1", 5.0), ("m2", "p2", 7.0)], "model string, profile string, x double")
    got = {(r.model, r.profile): r.value for r in aggregates.grid_mean(df, ["model", "profile"], ["x"]).collect()}
    assert got == {("m1", "p1"): 5.0, ("m1", "p2"): 0.0, ("m2", "p1"): 0.0, ("m2", "p2"): 7.0}
    assert aggregates.grid_mean(df, ["model", "profile"], ["x"], fill=None).count() == 2
