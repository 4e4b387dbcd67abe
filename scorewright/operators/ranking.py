"""Best of a group, leaderboards, frontiers and corrections over many tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import pin
from . import prefix


def leaderboard(cells: DataFrame, part: list[str], entity: str, dim: str = "dimension",
                value: str = "value", tolerance: float = 0.005) -> DataFrame:
    """Distance of each cell to the best of its dimension, and the rank of each entity by its average.

    Equal averages are ranked by name. `cells` is a table of group means, so its windows are small.
    """
    best = Window.partitionBy(*part, dim)
    avg = Window.partitionBy(*part, entity)
    ranked = (cells
              .withColumn("best", F.max(value).over(best))
              .withColumn("delta", F.col(value) - F.col("best"))
              .withColumn("is_best", F.abs(F.col("delta")) < tolerance)
              .withColumn("avg", F.avg(value).over(avg)))
    # A quarter of a millionth is far below display precision and above the noise of summation, so
    # averages that are equal in exact arithmetic also rank as equal.
    order = Window.partitionBy(*part).orderBy(F.round("avg", 9).desc(), F.col(entity))
    return ranked.withColumn("rank", F.dense_rank().over(order)).drop("best")


def best_row(df: DataFrame, by: list[str], score: Column | str, ties: list[str], keep: list[str]) -> DataFrame:
    """The row with the highest score per group; a null score counts as 0, ties go to the smallest key.

    An aggregate, not a window: each task keeps one candidate per group before anything is shuffled.
    """
    s = F.coalesce(col(score), F.lit(0.0))
    rows = df.select(*by, s.alias("_s"), *[c for c in keep if c not in by],
                     *[c for c in ties if c not in keep and c not in by])
    order = F.struct((-F.col("_s")).alias("_neg"), *[F.col(c) for c in ties])
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in keep], F.col("_s")), order).alias("_r"))
    return picked.select(*by, *[f"_r.{c}" for c in keep if c not in by], F.col("_r._s").alias("best_score"))


def top_one(df: DataFrame, score: Column | str, name: str, keep: list[str],
            by: list[str] | None = None, lowest: bool = False) -> DataFrame:
    """Highest (or lowest) scoring row per group of a table of group results, ties by name."""
    s = F.round(col(score), 9)
    order = F.struct((s if lowest else -s).alias("_k"), F.col(name).alias("_n"))
    grouped = df.where(col(score).isNotNull()).groupBy(*(by or []))
    out = grouped.agg(F.min_by(F.struct(*keep), order).alias("_r"))
    return out.select(*(by or []), *[F.col(f"_r.{c}").alias(c) for c in keep])


def winners(quality: DataFrame, entity: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Best entity per group, "N/A" where the best score is not above 0."""
    best = top_one(quality, score, entity, [entity, score], by)
    return best.withColumn(entity, F.when(F.col(score) > 0, F.col(entity)).otherwise("N/A"))


def efficiency_winner(quality: DataFrame, name: str, score: str, tokens: str, keep: list[str],
                      by: list[str] | None = None) -> DataFrame:
    """Best score per token among groups that have both."""
    rated = quality.where((F.col(tokens) > 0) & (F.col(score) > 0)).withColumn(
        "score_per_token", F.col(score) / F.col(tokens))
    # Ratios are tiny: scale before the comparison is rounded.
    return top_one(rated, F.col("score_per_token") * 1e9, name, [*keep, "score_per_token"], by)


def winner_margin(df: DataFrame, part: list[str], entity: str, score: str) -> DataFrame:
    """Winner, runner-up, margin and spread per group of a table of group results."""
    order = Window.partitionBy(*part).orderBy(F.round(score, 9).desc(), F.col(entity))
    whole = Window.partitionBy(*part)
    ranked = df.select(
        *part, F.col(entity).alias("winner"), F.col(score).alias("winner_score"),
        F.row_number().over(order).alias("_rn"),
        F.lead(entity).over(order).alias("runner_up"),
        F.lead(score).over(order).alias("runner_up_score"),
        (F.max(score).over(whole) - F.min(score).over(whole)).alias("spread"),
        F.count("*").over(whole).alias("candidates"),
    )
    return ranked.where("_rn = 1").select(
        *part, "winner", "winner_score",
        F.coalesce("runner_up", "winner").alias("runner_up"),
        F.coalesce("runner_up_score", "winner_score").alias("runner_up_score"),
        F.coalesce(F.col("winner_score") - F.col("runner_up_score"), F.lit(0.0)).alias("margin"),
        "spread", "candidates",
    )


def frontier(df: DataFrame, cost: str, quality: str, part: list[str] | None = None,
             keep_all: bool = False, splits: list[float] | None = None) -> DataFrame:
    """Rows that beat every cheaper row.

    Only the best row of each cost can be on the frontier, so costs are reduced to their best
    quality first; of rows with equal cost and equal quality all are kept as equals.
    """
    part = part or []
    if splits is None:
        df = pin(df, "frontier")  # small, and read twice
    best = df.groupBy(*part, cost).agg(F.max(quality).alias("_best"))
    front = prefix.running_max(best, part, cost, "_best", "_before", splits)
    front = front.where(F.col("_best") > F.coalesce("_before", F.lit(-1.0))).select(
        *part, cost, F.col("_best").alias(quality), F.lit(True).alias("on_frontier"))
    if not keep_all:
        return df.join(front.drop("on_frontier"), [*part, cost, quality], "left_semi")
    return df.join(front, [*part, cost, quality], "left").withColumn(
        "on_frontier", F.coalesce("on_frontier", F.lit(False)))


def bonferroni(df: DataFrame, p: str, part: list[str], out: str = "p_bonferroni",
               nominal: Column | None = None) -> DataFrame:
    """p times the number of tests in its family; `nominal` replaces the counted number."""
    if nominal is None:
        # Families of part are group results and lie beside each other anyway; the whole table is counted, not gathered.
        nominal = F.count("*").over(Window.partitionBy(*part)) if part else df.agg(F.count("*")).scalar()
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * nominal))


def benjamini_hochberg(df: DataFrame, p: str, part: list[str], out: str = "p_bh",
                       splits: list[float] | None = None) -> DataFrame:
    """Step-up false discovery rate.

    Tests with equal p share their largest rank, which is what the step-up minimum gives them. Windows
    serve families of any usual size; with split points of -p a family may exceed one task.
    """
    family = part or ["_all"]
    df = df if part else df.withColumn("_all", F.lit(0))
    if splits is None:
        up = Window.partitionBy(*family).orderBy(p).rangeBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*family).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*family)
        adj = F.col(p) * F.count("*").over(whole) / F.count("*").over(up)
        return df.withColumn("_adj", adj).withColumn(
            out, F.least(F.lit(1.0), F.min("_adj").over(down))).drop("_adj", "_all")
    df = pin(df, "tests")
    counts = df.groupBy(*family, p).agg(F.count("*").alias("_n")).withColumn("_neg_p", -F.col(p))
    ranked = prefix.running(counts, family, ["_neg_p"], {"_from_top": F.col("_n")}, splits)
    ranked = ranked.join(df.groupBy(*family).agg(F.count("*").alias("_m")), family)
    # Rank from the smallest p: all tests but those with a larger p.
    ranked = ranked.withColumn("_adj", -(F.col(p) * F.col("_m") / (F.col("_m") - F.col("_from_top") + F.col("_n"))))
    stepped = prefix.running_max(ranked, family, "_neg_p", "_adj", "_larger", splits)
    adjusted = stepped.select(*family, p, F.least(F.lit(1.0), -F.greatest("_adj", "_larger")).alias(out))
    return df.join(adjusted, [*family, p]).drop("_all")


def cost_cap(df: DataFrame, part: list[str], order: list[str], cost: str, cap: float,
             splits: list[float] | None = None) -> DataFrame:
    """Running cost in completion order; a run starts only while the cost before it is below the cap."""
    out = prefix.running(df, part, order, {"running_cost": F.col(cost)}, splits)
    return (out.withColumn("cap_reached", F.col("running_cost") >= cap)
            .withColumn("started", F.col("running_cost") - F.col(cost) < cap))


def assign_ids(new: DataFrame, existing: DataFrame, id_col: str, order: list[str], label: str = "run-",
               splits: list[float] | None = None) -> DataFrame:
    """Number new rows on from the largest numeric suffix of the existing ids."""
    number = F.regexp_extract(F.col(id_col), f"^{label}([0-9]+)$", 1).try_cast("bigint")
    last = existing.agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    numbered = prefix.row_numbers(new.withColumn("_all", F.lit(0)), ["_all"], order, "_rn", splits)
    seq = F.col("_rn") + last.scalar()
    digits = F.col("_seq").cast("string")
    text = F.when(F.col("_seq") < 1000, F.lpad(digits, 3, "0")).otherwise(digits)
    return (numbered.withColumn("_seq", seq).withColumn(id_col, F.concat(F.lit(label), text))
            .drop("_all", "_rn", "_seq"))


def weakest(parts: list[tuple[str, Column | str]]) -> Column:
    """Name of the lowest sub-score; the first in the given order wins ties."""
    entries = F.array(*[
        F.when(col(c).isNotNull(), F.struct(col(c).cast("double").alias("s"), F.lit(i).alias("o"), F.lit(n).alias("n")))
        for i, (n, c) in enumerate(parts)])
    return F.array_min(F.array_compact(entries))["n"]


def top_k(df: DataFrame, part: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First k rows per group and how many more there are.

    Spark cuts each task's input to k rows per group before the shuffle, so a hot group costs no
    more than k rows per task; the count is its own aggregate for the same reason.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    top = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
    sizes = df.groupBy(*part).agg(F.count("*").alias("_n"))
    return top.join(sizes, part).withColumn(
        "n_more", F.greatest(F.lit(0).cast("bigint"), F.col("_n") - k)).drop("_n")


def systematic_sample(df: DataFrame, part: list[str], order: list[str], lines: int = 10,
                      splits: list[float] | None = None) -> DataFrame:
    """Every N-th row of a group and its last one, N = max(1, rows // lines)."""
    numbered = prefix.row_numbers(df, part, order, "position", splits, "total")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total") / lines))
    return numbered.where(
        (F.col("position") % step == 0) | (F.col("position") == F.col("total")))
