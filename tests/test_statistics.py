"""Tests and effect sizes against enumeration, published values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import tails
from scorewright.operators import aggregates, calibration, prefix, ranking, stats


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def scores(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, score double")


def compared(spark, a, b, **kw):
    hist = stats.histogram(scores(spark, {"a": a, "b": b}), ["g"]).withColumn("k", F.lit(1))
    return stats.versus(hist, ["k"], "g", "a", **kw)


def test_normal_tail(spark):
    for z, p in [(0.0, 0.5), (1.96, 0.0249979), (-1.96, 0.9750021), (4.0, 3.16712e-5)]:
        assert one(spark, tails.normal_sf(F.lit(z))) == pytest.approx(p, rel=1e-5)


def test_t_critical(spark):
    for df, t in [(1, 12.7062047), (2, 4.3026527), (9, 2.2621572), (30, 2.0422725), (31, 2.0395134), (100, 1.9839715), (10**6, 1.9599664)]:
        assert one(spark, tails.t_critical(F.lit(df))) == pytest.approx(t, rel=1e-6)


def test_t_tail_and_power(spark):
    assert one(spark, tails.t_sf(F.lit(2.0), F.lit(10))) == pytest.approx(0.03669402, rel=1e-6)
    # With one degree of freedom the tail is that of an angle, with two it is algebraic, with many it is normal.
    for t in (-3.0, 0.0, 0.5, 12.0, 4000.0):
        assert one(spark, tails.t_sf(F.lit(t), F.lit(1))) == pytest.approx(0.5 - math.atan(t) / math.pi, rel=1e-9)
        assert one(spark, tails.t_sf(F.lit(t), F.lit(2))) == pytest.approx(
            0.5 - t / (2 * math.sqrt(2 + t * t)) if t < 1000 else 0.5 / t ** 2, rel=1e-6)
    assert one(spark, tails.t_sf(F.lit(4.0), F.lit(1e9))) == pytest.approx(math.erfc(4 / math.sqrt(2)) / 2, rel=1e-6)
    assert one(spark, tails.t_critical(F.lit(1), 0.999)) == pytest.approx(1 / math.tan(math.pi * 0.0005), rel=1e-9)
    power = lambda d, a, b: one(spark, tails.post_hoc_power(F.lit(d), F.lit(a), F.lit(b), 0.05))
    assert power(0.5, 64, 64) == pytest.approx(0.8014596, abs=1e-5)
    assert power(0.0, 64, 64) == power(1.0, 1, 64) == pytest.approx(0.05)


def test_u_distribution_is_exact():
    m, n = 3, 4
    counts = np.zeros(m * n + 1)
    for pick in itertools.combinations(range(m + n), m):
        counts[sum(p - i for i, p in enumerate(pick))] += 1
    assert list(tails.u_distribution(m, n)) == list(counts)


def test_exact_p_by_enumeration(spark):
    a, b = [1.0, 4.0, 6.0, 9.0], [2.0, 3.0, 5.0, 7.0, 8.0]
    u = sum(x > y for x in a for y in b)
    pool, hits, total = a + b, 0, 0
    for pick in itertools.combinations(range(9), 4):
        x = [pool[i] for i in pick]
        y = [pool[i] for i in range(9) if i not in pick]
        hits += sum(p > q for p in x for q in y) >= u
        total += 1
    row = stats.mann_whitney(compared(spark, a, b), "greater", "exact").first()
    assert (row.u, row.p_method) == (u, "exact")
    assert row.p_value == pytest.approx(hits / total)


def test_two_paths_agree_with_brute_force(spark):
    rng = random.Random(7)
    groups = {g: [round(rng.gauss(m, 9)) for _ in range(n)] for g, m, n in [("a", 50, 60), ("b", 47, 80), ("c", 55, 45)]}
    hist = stats.histogram(scores(spark, groups), ["g"]).withColumn("k", F.lit(1))
    splits = prefix.range_splits(hist, "value", 5)
    for s in (None, splits):
        got = {r.g: r for r in stats.mann_whitney(stats.versus(hist, ["k"], "g", "a", s), "two-sided", "asymptotic").collect()}
        for g in ("b", "c"):
            a, b = groups["a"], groups[g]
            u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
            t = [a.count(v) + b.count(v) for v in set(a + b)]
            n = len(a) + len(b)
            var = len(a) * len(b) / 12 * (n + 1 - sum(x**3 - x for x in t) / (n * (n - 1)))
            z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / math.sqrt(var)
            assert got[g].u == u
            assert got[g].z == pytest.approx(z)
            assert got[g].p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
            assert got[g].var_b == pytest.approx(np.var(b, ddof=1))
            assert got[g].mean_a == pytest.approx(np.mean(a))


def test_equal_values_give_p_one(spark):
    row = stats.mann_whitney(compared(spark, [5, 5, 5], [5, 5]), "two-sided").first()
    assert row.p_value == 1.0


@pytest.mark.parametrize("base, other, flagged", [
    ([90, 92, 91, 93, 90], [60, 62, 58, 61, 59], True),
    ([80, 81, 80, 81, 80], [78, 79, 78.5, 79, 78.5], False),
    ([60, 62, 58, 61, 59], [90, 92, 91, 93, 90], False),
])
def test_regressions(spark, base, other, flagged):
    df = scores(spark, {"empty": base, "x": other}).withColumn("task", F.lit("t")).withColumn("dimension", F.lit("d"))
    rows = stats.detect_regressions(df, "g", "empty", ["task", "dimension"]).collect()
    assert [r.is_regression for r in rows] == [flagged]
    assert rows[0].p_method == "asymptotic"


def test_regressions_need_two_scores_and_a_baseline(spark):
    df = scores(spark, {"empty": [1, 2], "x": [3]}).withColumn("task", F.lit("t")).withColumn("dimension", F.lit("d"))
    assert stats.detect_regressions(df, "g", "empty", ["task", "dimension"]).count() == 0
    assert stats.detect_regressions(df, "g", "absent", ["task", "dimension"]).count() == 0


def test_zero_baseline_is_no_regression(spark):
    df = scores(spark, {"empty": [0, 0, 0], "x": [-5, -6, -7]}).withColumn("task", F.lit("t")).withColumn("dimension", F.lit("d"))
    row = stats.detect_regressions(df, "g", "empty", ["task", "dimension"]).first()
    assert (row.delta_pct, row.is_regression) == (0.0, False)


def test_compare_run_sets(spark):
    rows = [(rs, "m", "p", "t", "composite", float(v)) for rs, vs in [("r1", [80, 82]), ("r2", [90, 92])] for v in vs]
    df = spark.createDataFrame(rows, "run_set string, model string, profile string, task string, dimension string, score double")
    row = stats.compare_run_sets(df, "run_set", ["model", "profile", "task"], method="exact").first()
    assert (row.mean_a, row.mean_b, row.n_comparisons) == (81.0, 91.0, 1.0)
    assert row.delta_pct > 0 and row.effect_size == pytest.approx(10 / math.sqrt(2))
    assert row.p_value == pytest.approx(2 / 6)


def test_cohens_d(spark):
    row = compared(spark, [1, 2, 3], [2, 3, 4]).select(stats.cohens_d().alias("p"), stats.cohens_d("average").alias("a")).first()
    assert (row.p, row.a) == (pytest.approx(1.0), pytest.approx(-1.0))
    flat = compared(spark, [5, 5], [7, 7]).select(stats.cohens_d().alias("p"), stats.cohens_d("average").alias("a")).first()
    assert (flat.p, flat.a) == (0.0, 10.0)
    single = compared(spark, [5], [7, 8]).select(stats.cohens_d().alias("p"), stats.cohens_d("average").alias("a")).first()
    assert (single.p, single.a) == (0.0, 0.0)


def test_variant_table_neutral_row(spark):
    df = scores(spark, {"control": [1, 2, 3], "one": [9], "two": [4, 5, 6]}).withColumn("rs", F.lit(1))
    got = {r.g: r for r in stats.variant_table(df, "g", "control", "score", ["rs"], method="exact").collect()}
    assert (got["one"].p_value, got["one"].delta, got["one"].power, got["one"].adjusted_p_value) == (1.0, 0.0, 0.0, 1.0)
    assert got["two"].p_value == pytest.approx(0.1)
    assert got["two"].adjusted_p_value == pytest.approx(0.2)
    assert 0 < got["two"].power <= 1


@pytest.mark.parametrize("splits", [None, [-0.045, -0.02]])
def test_benjamini_hochberg(spark, splits):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([.01, .04, .03, .05])], "i int, p double")
    got = {r.i: r.p_bh for r in ranking.benjamini_hochberg(df, "p", [], splits=splits).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([.04, .05, .05, .05])


def test_bonferroni(spark):
    df = spark.createDataFrame([(.01,), (.5,)], "p double")
    assert sorted(r.p_bonferroni for r in ranking.bonferroni(df, "p", []).collect()) == [.02, 1.0]


def test_spearman(spark):
    rng = random.Random(3)
    pts = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(60)]
    df = spark.createDataFrame([(1, x, y, 1) for x, y in pts], "k int, x int, y int, n int")

    def ranks(v):
        return [sum(o < x for o in v) + (v.count(x) + 1) / 2 for x in v]

    want = np.corrcoef(ranks([p[0] for p in pts]), ranks([p[1] for p in pts]))[0, 1]
    assert stats.spearman(df, ["k"], "x", "y").first().rho == pytest.approx(want)
    assert stats.spearman(df.limit(2), ["k"], "x", "y").first().rho == 0.0


def test_mean_ci(spark):
    df = spark.createDataFrame([("a", 70.0), ("a", 80.0), ("a", 90.0), ("b", 85.0), ("c", 5.0), ("c", 5.0), ("d", None)], "g string, v double")
    got = {r.g: r for r in aggregates.mean_ci(df, ["g"], "v").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].stdev) == (3, 80.0, 10.0)
    assert got["a"].ci_lower == pytest.approx(80 - 4.3026527 * 10 / math.sqrt(3)) and got["a"].ci_upper > 90
    assert (got["b"].ci_lower, got["b"].ci_upper, got["b"].stdev) == (85.0, 85.0, 0.0)
    assert (got["c"].ci_lower, got["c"].ci_upper) == (5.0, 5.0)
    assert "d" not in got


def test_unknown_tiers_take_no_part(spark):
    rows = [("j", "t", tier, r, s) for tier, s in [("gold", 90.0), ("mild", 70.0), ("severe", 40.0), ("broken", 5.0)] for r in (1, 2)]
    df = spark.createDataFrame(rows, "model string, task string, tier string, rep int, normalized double").withColumn("c", F.col("normalized"))
    assert calibration.tier_correlation(df).first().n == 6
    assert calibration.determinism(df, ["c"]).first().pct_deterministic == 100.0
    row = calibration.discrimination(df, ["normalized"]).first()
    assert (row.gold_mean, row.severe_mean, row.d) == (90.0, 40.0, 10.0)
    assert calibration.inter_rater(df).first().agreement == 1.0


def test_statistics_without_a_part(spark):
    hist = stats.histogram(scores(spark, {"a": [1, 2, 3, 4], "b": [3, 4, 5], "c": [0, 9]}), ["g"])
    plain = {r.g: (r.u, r.n_b) for r in stats.versus(hist, [], "g", "a").collect()}
    assert plain == {"b": (2.0, 3), "c": (4.0, 2)}
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 9, 2)], "x int, y int, n int")
    assert stats.spearman(df, [], "x", "y").first().rho == pytest.approx(1.0)


def test_one_method_at_every_size(spark):
    rng = random.Random(11)
    b = [rng.gauss(52, 9) for _ in range(50)]
    for n in (3, 50, 51):
        a = [rng.gauss(50, 9) for _ in range(n)]
        rows = [stats.mann_whitney(compared(spark, a, b), "two-sided", m).first() for m in ("asymptotic", "exact")]
        assert [r.p_method for r in rows] == ["asymptotic", "exact"]
        assert rows[0].p_value == pytest.approx(rows[1].p_value, abs=0.03)


def test_regressions_by_the_test_the_caller_chose(spark):
    df = scores(spark, {"empty": [90, 92, 91, 93, 90], "x": [60, 62, 58, 61, 59]}).withColumns({"task": F.lit("t"), "dimension": F.lit("d")})
    row = stats.detect_regressions(df, "g", "empty", ["task", "dimension"], test="welch").first()
    assert (row.test_used, row.is_regression) == ("welch-t-test", True)


def test_t_critical_is_one_curve(spark):
    known = {1: 12.7062047362, 2: 4.3026527297, 5: 2.5705818356, 30: 2.0422724563, 31: 2.0395134464, 1000: 1.9623390808}
    df = spark.createDataFrame([(k,) for k in known] + [(0,), (None,)], "df bigint")
    got = {r[0]: r[1] for r in df.select("df", tails.t_critical("df")).collect()}
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in known.items()) and got[0] is None is got[None]


def test_chosen_run_sets_and_pairs(spark):
    rows = [(f"r{i}", "m", "p", "t", "composite", 50.0 + i + k) for i in range(5) for k in range(3)]
    df = spark.createDataFrame(rows, "run_set string, model string, profile string, task string, dimension string, score double")
    keys = ["model", "profile", "task"]

    def compared_pairs(chosen):
        return sorted((r.run_set_a, r.run_set_b, r.n_comparisons) for r in stats.compare_run_sets(df, "run_set", keys, chosen=chosen).collect())

    assert len(compared_pairs(None)) == 10
    assert compared_pairs(spark.createDataFrame([("r4",), ("r1",), ("r2",)], "run_set string")) == [("r1", "r2", 3.0), ("r1", "r4", 3.0), ("r2", "r4", 3.0)]
    wanted = spark.createDataFrame([("r4", "r0"), ("r1", "r2"), ("r2", "r1"), ("r3", "r3")], "run_set_a string, run_set_b string")
    assert [p[:2] for p in compared_pairs(wanted)] == [("r0", "r4"), ("r1", "r2")]


def test_underpowered_experiments_say_so(spark):
    from scorewright.operators import aggregates, findings

    rng = random.Random(12)
    rows = [("e", g, rng.gauss(50, 10), 100) for g in ("control", "x", "y") for _ in range(4)]
    df = spark.createDataFrame(rows, "exp string, g string, score double, token_count bigint")
    table = stats.variant_table(df, "g", "control", "score", ["exp"])
    quality = df.groupBy("exp", "g").agg(F.avg("score").alias("quality"), F.sum("token_count").alias("total_tokens"))
    kinds = {r.kind: r.text for r in findings.experiment_findings(table, quality, ["exp"], "g").collect()}
    assert "no_difference" in kinds and kinds["underpowered"] == "2 of 2 comparisons have power below 80%"


@pytest.mark.parametrize("block", [256, 2])
def test_one_sweep_gives_all_pairs(spark, monkeypatch, block):
    from scorewright.operators import sweep

    monkeypatch.setattr(sweep, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice(["k", "ü", None]), rng.choice([1, 2, None]), rng.choice(["r1", "r10", "r2", "R", "ä", None]), float(rng.randint(0, 6)))
            for _ in range(400)] + [("alone", 1, "r1", 2.0), ("k", 3, "r1", 1.0), ("k", 3, "r2", 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, e string, score double")
    keys = ["k", "i", "e_a", "e_b"]
    hist = stats.histogram(df, ["k", "i", "e"])
    got = {tuple(r[k] for k in keys): r for r in stats._summary(sweep.pair_sweep(hist, ["k", "i"], "e"), keys).collect()}
    sides = {}
    for k, i, e, v in rows:
        sides.setdefault((k, i), {}).setdefault(e, []).append(v)
    want = {(k, i, a, b): (x[a], x[b]) for (k, i), x in sides.items() for a in x for b in x if a and b and a < b}
    assert set(got) == set(want) and len(want) > 90
    for key, (a, b) in want.items():
        r = got[key]
        assert (r.n_a, r.n_b, r.u) == (len(a), len(b), sum((x > y) + (x == y) / 2 for x in a for y in b))
        assert r.mean_a == pytest.approx(sum(a) / len(a)) and r.mean_b == pytest.approx(sum(b) / len(b))
        n, ties = len(a) + len(b), sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
        assert r.u_var == pytest.approx(max(0, len(a) * len(b) / 12 * ((n + 1) - ties / (n * (n - 1))))) and r.has_ties == (ties > 0)
    assert sweep.pair_sweep(hist.limit(0), ["k", "i"], "e").count() == 0
    plan = sweep.pair_sweep(hist, ["k", "i"], "e")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
