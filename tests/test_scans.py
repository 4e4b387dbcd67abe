"""Each of these queries reads the runs once, counted over all plans that it runs."""

import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,column", [(n, "l_orderkey") for n in (
    "cumulative_cost_cap", "run_health", "rescore_candidates", "best_profile", "efficient_frontier", "profile_macro_mean",
    "report_metadata", "reference_integrity", "manifest_merge", "score_detail", "compare_run_sets", "mean_ci", "metric_panel")]
    + [("systematic_sample", "event_id")])
def test_runs_are_read_once(spark, monkeypatch, name, column):
    from scorewright import session

    plans, real = [], session.pin
    query = entry.queries()[name]

    def plan(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    def pin(df, label="pin"):
        plan(df)
        return real(df, label)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("scorewright.") and getattr(module, "pin", None) is real:
            monkeypatch.setattr(module, "pin", pin)
    plan(query(spark, SF))
    # Tables that the query wrote itself hold running sums beside the rows.
    reads = [line for p in plans for line in p.splitlines() if "Relation [" in line and column in line and "_t_" not in line]
    assert len(reads) == 1, "\n".join(reads)


def test_charts_are_drawn_from_one_reading(spark, monkeypatch):
    test_runs_are_read_once(spark, monkeypatch, "chart_series", "l_orderkey")


def test_scores_are_not_dealt_out_by_run_set(spark, monkeypatch):
    from scorewright.operators import stats

    plans, real = {}, stats.pin
    monkeypatch.setattr(stats, "pin", lambda df, name="pin": plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    entry.queries()["compare_chosen_run_sets"](spark, SF)
    assert "SortMergeJoin" not in "".join(line for line in plans["histogram"].splitlines() if "LeftSemi" in line)
    assert "LeftSemi" in plans["histogram"]
