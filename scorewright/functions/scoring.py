"""Scoring expressions: pure columns from raw measurements to 0-100 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col, finite, finite_map, last_entries, let, round_to

# The score dimensions a nested score record is flattened to.
STATIC_DIMENSIONS = ["test_pass_rate", "lint_score", "complexity_score"]
DIMENSIONS = ["composite", "test_pass_rate", "lint_score", "complexity_score", "llm_quality"]

# Default weights.
STATIC_WEIGHTS = {"test_pass_rate": 0.5, "lint_score": 0.3, "complexity_score": 0.2}
COMPOSITE_WEIGHTS = {"static": 0.5, "judge": 0.5}
WEIGHT_TOLERANCE = 0.001

# Complexity grades, as (upper bound of the average, grade, label, score range).
COMPLEXITY_GRADES = [
    (5.0, "A", "Simple", "80–100"),
    (10.0, "B", "Moderate", "60–80"),
    (20.0, "C", "Complex", "40–60"),
    (30.0, "D", "High", "20–40"),
    (40.0, "E", "Very High", "5–20"),
    (float("inf"), "F", "Untestable", "0–5"),
]


def test_pass_rate(passed: Column | str, total: Column | str) -> Column:
    p, t = col(passed).cast("double"), col(total).cast("double")
    return F.when(t > 0, p / t * 100.0).otherwise(F.lit(0.0))


def lint_score(errors: Column | str, loc: Column | str) -> Column:
    e, n = col(errors).cast("double"), col(loc).cast("double")
    raw = F.lit(100.0) - F.try_divide(e, n) * 1000.0
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(F.lit(100.0))


def complexity_score(average: Column | str) -> Column:
    """Falls linearly within each grade; between 0 and 1 the line would leave 100, so it is clamped."""
    x = col(average).cast("double")
    return (
        F.when(x <= 1, 100.0)
        .when(x <= 5, 100.0 - (x - 1.0) * 5.0)
        .when(x <= 10, 80.0 - (x - 5.0) * 4.0)
        .when(x <= 20, 60.0 - (x - 10.0) * 2.0)
        .when(x <= 30, 40.0 - (x - 20.0) * 2.0)
        .when(x <= 40, 20.0 - (x - 30.0) * 1.5)
        .otherwise(F.greatest(F.lit(0.0), 5.0 - (x - 40.0) * 0.5))
    )


def _grade(average: Column | str, pick: int) -> Column:
    x = col(average).cast("double")
    out = F
    for row in COMPLEXITY_GRADES[:-1]:
        out = out.when(x <= row[0], row[pick])
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(COMPLEXITY_GRADES[-1][pick]))


def complexity_grade(average: Column | str) -> Column:
    return _grade(average, 1)


def complexity_label(average: Column | str) -> Column:
    return _grade(average, 2)


def complexity_range(average: Column | str) -> Column:
    return _grade(average, 3)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1.0) > WEIGHT_TOLERANCE:
        raise ValueError(f"weights must sum to 1, got {sum(weights.values())}")
    return weights


def static_total(df: DataFrame, weights: DataFrame | None = None, on: str = "task",
                 has_output: Column | None = None) -> DataFrame:
    """Add `static_total` from the three sub-scores of each row.

    `weights` overrides the defaults per `on` value: columns `on`, `w_test_pass_rate`,
    `w_lint_score`, `w_complexity_score`. Rows whose weights do not sum to 1 are ignored in favour
    of the defaults. Rows without output score 0 on every sub-score.
    """
    parts = list(STATIC_WEIGHTS)
    if weights is not None:
        total = sum((F.col(f"w_{p}") for p in parts), F.lit(0.0))
        df = df.join(weights.where(F.abs(total - 1.0) <= WEIGHT_TOLERANCE), on, "left")
        w = {p: F.coalesce(F.col(f"w_{p}"), F.lit(STATIC_WEIGHTS[p])) for p in parts}
    else:
        w = {p: F.lit(STATIC_WEIGHTS[p]) for p in parts}
    if has_output is not None:
        df = df.withColumns({p: F.when(has_output, F.col(p)).otherwise(F.lit(0.0)) for p in parts})
    # Weigh the unrounded sub-scores, then round each of them for display.
    total = sum((F.col(p) * w[p] for p in parts), F.lit(0.0))
    df = df.withColumn("static_total", round_to(total, 2))
    df = df.withColumns({p: round_to(p, 2) for p in parts})
    return df.drop(*[f"w_{p}" for p in parts])


def judge_average(criteria: list[Column | str]) -> Column:
    """Mean of the criteria that are present, as plain arithmetic: no arrays, no lambdas."""
    values = [col(c).cast("double") for c in criteria]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return F.when(n > 0, total / n)


def judge_average_array(scores: Column | str) -> Column:
    arr = col(scores)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(arr) > 0, total / F.size(arr))


def judge_normalized(average: Column | str) -> Column:
    return round_to((col(average) - 1.0) * 25.0, 2)


def composite(static: Column | str, judge: Column | str, static_weight: float = 0.5,
              judge_weight: float = 0.5) -> Column:
    check_weights({"static": static_weight, "judge": judge_weight})
    s, j = col(static), col(judge)
    both = round_to(s * F.lit(static_weight) + j * F.lit(judge_weight), 2)
    return F.when(j.isNull(), round_to(s, 2)).otherwise(both)


def static_only(judge: Column | str) -> Column:
    return col(judge).isNull()


def failed_scorers(static: Column | str, judge: Column | str, skip_judge: Column | bool = False) -> Column:
    """Names of the scorers that should have produced a score and did not."""
    skip = F.lit(skip_judge) if isinstance(skip_judge, bool) else skip_judge
    return F.array_compact(F.array(
        F.when(col(static).isNull(), F.lit("static")),
        F.when(~skip & col(judge).isNull(), F.lit("llm_judge")),
    ))


def points_per_1k(score: Column | str, context_tokens: Column | str, io_tokens: Column | str) -> Column:
    total = col(context_tokens) + col(io_tokens)
    return F.when(total > 0, round_to(col(score) / total * 1000.0, 2)).otherwise(F.lit(0.0))


def run_cost(input_tokens: Column | str, output_tokens: Column | str, price_in: Column | str,
             price_out: Column | str) -> Column:
    return (col(input_tokens) / F.lit(1e6) * col(price_in)
            + col(output_tokens) / F.lit(1e6) * col(price_out))


NESTED_RECORD = ("composite STRUCT<composite: DOUBLE>, "
                 "static STRUCT<test_pass_rate: DOUBLE, lint_score: DOUBLE, complexity_score: DOUBLE>, "
                 "llm STRUCT<normalized: DOUBLE>")


def flatten_scores(raw: Column | str) -> Column:
    """Score JSON, nested or flat, to one map of dimension to value.

    A record whose `composite` is an object is nested; of any other object the members that read as
    numbers are taken as they are. Flags, texts and objects are no dimensions, and neither are
    values that are not finite. Of a key that is there twice the last value counts.
    """
    def entries(*pairs) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("key"), finite(v).alias("value")) for k, v in pairs])

    def nested(doc: Column) -> Column:
        pairs = [("composite", doc["composite"]["composite"])]
        pairs += [(d, doc["static"][d]) for d in STATIC_DIMENSIONS]
        return entries(*pairs, ("llm_quality", doc["llm"]["normalized"]))

    def flat(members: Column) -> Column:
        return F.transform(F.map_entries(members), lambda e: F.struct(
            e["key"].alias("key"), finite(number(e["value"])).alias("value")))

    members = last_entries(F.map_entries(F.from_json(col(raw), "map<string,string>")))
    found = let(members, lambda m: F.when(
        m["composite"].startswith("{"), let(F.from_json(col(raw), NESTED_RECORD), nested)).otherwise(flat(m)))
    none = F.array().cast("array<struct<key:string,value:double>>")
    return F.map_from_entries(F.filter(F.coalesce(found, none), lambda e: e["value"].isNotNull()))


def number(text: Column) -> Column:
    """A text as a double, null where it is none. What doesn't start like a number is not tried: a failed cast costs an exception."""
    return F.when(text.rlike(r"^\s*[-+]?\.?[0-9]"), text.try_cast("double"))


def run_quality(scores: Column | str, policy: str = "mean_all") -> Column:
    """One number per run from its score map; null where there is none."""
    m = col(scores)
    values = F.filter(F.map_values(m), lambda v: v.isNotNull())
    mean = F.when(F.size(values) > 0,
                  F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
    if policy == "mean_all":
        return finite(mean)
    if policy == "prefer_composite":
        return finite(F.when(F.map_contains_key(m, F.lit("composite")), m["composite"]).otherwise(mean))
    raise ValueError(f"unknown policy {policy!r}")


def run_quality_wide(dims: list[str], policy: str = "mean_all") -> Column:
    """`run_quality` over score columns instead of a map; stays inside generated code."""
    total = sum((F.coalesce(F.col(d), F.lit(0.0)) for d in dims), F.lit(0.0))
    n = sum((F.when(F.col(d).isNotNull(), 1).otherwise(0) for d in dims), F.lit(0))
    mean = F.when(n > 0, total / n)
    if policy == "mean_all":
        return mean
    if policy == "prefer_composite":
        return F.coalesce(F.col("composite"), mean)
    raise ValueError(f"unknown policy {policy!r}")
