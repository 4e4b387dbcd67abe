"""Tests, effect sizes and correlations over groups of scores.

Everything here starts from a table of value counts (`histogram`): one aggregation with map-side
combine reads the runs, and whatever follows has one row per distinct value. Scores are rounded to
two decimals on 0-100, so a group has at most 10,001 of them however many runs it holds. For values
without such a bound pass `splits` and the running sums are spread over ranges of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, tails
from ..functions.numeric import ratio
from ..session import pin
from . import joins, prefix, sweep

TINY = 1e-10


def histogram(df: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Distinct values of each group with their counts.

    Nulls are dropped by their count after the aggregation: a filter on a computed score would be
    pushed down to the scan and compute the score a second time.
    """
    return (df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(value).alias("n"))
            .where(F.col("n") > 0))


def moments(hist: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample variance, min and max of each group of a histogram."""
    n, v = F.col("n"), F.col("value")
    g = hist.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(n * v).alias("_s1"), F.sum(n * v * v).alias("_s2"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    return g.select(*keys, "n", (F.col("_s1") / F.col("n")).alias("mean"),
                    _variance("n", "_s1", "_s2", "min", "max").alias("var"), "min", "max")


def _variance(n: str, s1: str, s2: str, low: str, high: str) -> Column:
    """Sample variance from sums; exactly 0 for equal values, 0 for a single one."""
    raw = F.try_divide(F.col(s2) - F.col(s1) * F.col(s1) / F.col(n), F.col(n) - 1)
    return F.when((F.col(low) == F.col(high)) | (F.col(n) < 2), F.lit(0.0)).otherwise(
        F.greatest(raw, F.lit(0.0)))


def against(hist: DataFrame, part: list[str], entity: str, baseline: str) -> DataFrame:
    """Pair the baseline (side a) with every other entity (side b) of the same part."""
    base = hist.where(F.col(entity) == baseline).select(*part, "value", F.col("n").alias("n_a"))
    others = hist.where(F.col(entity) != baseline)
    if part:
        side_a = base.join(others.select(*part, entity).distinct(), part)
    else:
        side_a = base.withColumn(entity, F.explode(others.agg(F.collect_set(entity)).scalar()))
    zero = F.lit(0).cast("bigint")
    return side_a.select(*part, entity, "value", "n_a", zero.alias("n_b")).unionByName(
        others.select(*part, entity, "value", zero.alias("n_a"), F.col("n").alias("n_b")))


def versus(hist: DataFrame, part: list[str], entity: str, baseline: str,
           splits: list[float] | None = None) -> DataFrame:
    """`two_sample` of the baseline (side a) and every other entity (side b) of the same part.

    U counts, for each score of side b, the baseline scores above it and half of those equal to it, so
    it needs only the running count of the baseline beside each row of the histogram. All windows
    share one sort of the part, nothing is joined and the runs are read once.
    """
    keys = [*part, entity]
    if splits is not None:
        return two_sample(against(hist, part, entity, baseline), keys, splits)
    is_base = F.col(entity) == baseline
    n, v = F.col("n").cast("double"), F.col("value")
    whole = Window.partitionBy(*part)
    up_to = Window.partitionBy(*part).orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    equal = Window.partitionBy(*part, "value")
    base = lambda c: F.when(is_base, c)
    cubes = lambda c: c * c * c - c
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = hist.withColumns({
        "_le": zero(F.sum(base(n)).over(up_to)), "_eq": zero(F.sum(base(n)).over(equal)),
        "_na": F.sum(base(F.col("n"))).over(whole), "_sa": F.sum(base(n * v)).over(whole),
        "_qa": F.sum(base(n * v * v)).over(whole), "min_a": F.min(base(v)).over(whole),
        "max_a": F.max(base(v)).over(whole), "_ta": F.sum(base(cubes(n))).over(whole)})
    rows = rows.where(~is_base & F.col("_na").isNotNull())
    same = lambda c: F.first(c).alias(c)
    g = rows.groupBy(*keys).agg(
        F.first("_na").alias("n_a"), F.sum("n").alias("n_b"),
        F.sum(n * (F.col("_na") - F.col("_le") + F.col("_eq") / 2.0)).alias("u"),
        (F.first("_ta") + F.sum(cubes(n + F.col("_eq")) - cubes(F.col("_eq")))).alias("_ties"),
        same("_sa"), same("_qa"), same("min_a"), same("max_a"),
        F.sum(n * v).alias("_sb"), F.sum(n * v * v).alias("_qb"), F.min(v).alias("min_b"), F.max(v).alias("max_b"))
    return _summary(g, keys)


def all_pairs(hist: DataFrame, on: list[str], entity: str, chosen: DataFrame | None = None) -> DataFrame:
    """Pair every two entities of the same keys (side a is the smaller name), or the chosen ones as in `joins.pairwise`."""
    names = hist.select(*on, entity).distinct()
    pairs = joins.pairwise(names, entity, on, [], chosen)
    a, b = f"{entity}_a", f"{entity}_b"
    zero = F.lit(0).cast("bigint")
    side_a = hist.withColumnRenamed(entity, a).join(pairs, [*on, a])
    side_b = hist.withColumnRenamed(entity, b).join(pairs, [*on, b])
    cols = [*on, a, b, "value"]
    return side_a.select(*cols, F.col("n").alias("n_a"), zero.alias("n_b")).unionByName(
        side_b.select(*cols, zero.alias("n_a"), F.col("n").alias("n_b")))


def two_sample(paired: DataFrame, keys: list[str], splits: list[float] | None = None) -> DataFrame:
    """Sizes, means, variances, the U of side a and its variance for each pair."""
    merged = paired.groupBy(*keys, "value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    cum = prefix.running(merged, keys, ["value"], {"_below_b": F.col("n_b")}, splits)
    a, b, v = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("value")
    t = a + b
    on_a, on_b = F.when(a > 0, v), F.when(b > 0, v)
    g = cum.groupBy(*keys).agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"),
        F.sum(a * (F.col("_below_b") - b / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("_ties"),
        F.sum(a * v).alias("_sa"), F.sum(a * v * v).alias("_qa"), F.min(on_a).alias("min_a"), F.max(on_a).alias("max_a"),
        F.sum(b * v).alias("_sb"), F.sum(b * v * v).alias("_qb"), F.min(on_b).alias("min_b"), F.max(on_b).alias("max_b"))
    return _summary(g, keys)


def _summary(g: DataFrame, keys: list[str]) -> DataFrame:
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = na + nb
    u_var = na * nb / 12.0 * ((total + 1.0) - F.coalesce(
        F.try_divide(F.col("_ties"), total * (total - 1.0)), F.lit(0.0)))
    return g.select(
        *keys, "n_a", "n_b", "u", (F.col("_ties") > 0).alias("has_ties"),
        F.greatest(u_var, F.lit(0.0)).alias("u_var"),
        ratio("_sa", "n_a").alias("mean_a"), ratio("_sb", "n_b").alias("mean_b"),
        _variance("n_a", "_sa", "_qa", "min_a", "max_a").alias("var_a"),
        _variance("n_b", "_sb", "_qb", "min_b", "max_b").alias("var_b"))


def mann_whitney(stats: DataFrame, alternative: str = "two-sided", method: str = "asymptotic") -> DataFrame:
    """Add U, z and p to the output of `two_sample`, by one method for groups of every size.

    `greater` asks whether side a is larger. `asymptotic` is the normal approximation, corrected for ties and
    continuity; equal values throughout give p = 1. `exact` enumerates the distribution of U, ignoring ties, for every
    row; its cost grows with the product of the group sizes.
    """
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    big = F.greatest(F.col("u"), na * nb - F.col("u")) if alternative == "two-sided" else F.col("u")
    tails_n = 2.0 if alternative == "two-sided" else 1.0
    z = F.try_divide(big - na * nb / 2.0 - 0.5, F.sqrt("u_var"))
    df = stats.withColumn("z", F.when(F.col("u_var") > TINY, z))
    if method == "asymptotic":
        p = F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), tails.normal_sf("z") * tails_n))
    elif method == "exact":
        p = F.least(F.lit(1.0), tails.exact_u_sf(big, F.col("n_a"), F.col("n_b")) * tails_n)
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumns({"p_method": F.lit(method), "p_value": p, "test_used": F.lit("mann-whitney-u")})


def welch(stats: DataFrame) -> DataFrame:
    """Add the unequal-variance t of side a against side b and its degrees of freedom."""
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb))
    df = F.try_divide((ea + eb) * (ea + eb),
                      F.coalesce(F.try_divide(ea * ea, F.col("n_a") - 1), F.lit(0.0))
                      + F.coalesce(F.try_divide(eb * eb, F.col("n_b") - 1), F.lit(0.0)))
    return stats.withColumn("t", t).withColumn("df", df)


def welch_p(stats: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Add p to the output of `welch`."""
    if alternative == "greater":
        p = tails.t_sf(F.col("t"), F.col("df"))
    else:
        p = F.least(F.lit(1.0), tails.t_sf(F.abs("t"), F.col("df")) * 2.0)
    return stats.withColumn("p_value", p).withColumn("test_used", F.lit("welch-t-test"))


def cohens_d(kind: str = "pooled") -> Column:
    """Effect size over the columns of `two_sample`.

    `pooled` is b minus a over the pooled deviation, 0 without spread. `average` is a minus b over the
    root of the mean variance; without any spread, different means count as 10.
    """
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    if kind == "pooled":
        sd = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"),
                                 F.col("n_a") + F.col("n_b") - 2))
        return F.when(enough & (sd >= TINY), (F.col("mean_b") - F.col("mean_a")) / sd).otherwise(F.lit(0.0))
    if kind == "average":
        sd = F.sqrt((F.col("var_a") + F.col("var_b")) / 2.0)
        flat = F.when(F.abs(F.col("mean_a") - F.col("mean_b")) > TINY, F.lit(10.0)).otherwise(F.lit(0.0))
        return F.when(~enough, F.lit(0.0)).when(sd == 0, flat).otherwise(
            (F.col("mean_a") - F.col("mean_b")) / sd)
    raise ValueError(f"unknown kind {kind!r}")


def spearman(counts: DataFrame, part: list[str], x: str, y: str, n: str = "n",
             splits_x: list[float] | None = None, splits_y: list[float] | None = None) -> DataFrame:
    """Rank correlation from counts of (x, y) pairs; fewer than 3 points or no spread give 0."""
    joint = counts.groupBy(*part, x, y).agg(F.sum(n).alias("_n"))
    joint = pin(joint, "pairs").where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str, splits) -> DataFrame:
        single = joint.groupBy(*part, c).agg(F.sum("_n").alias("_m"))
        return prefix.mid_ranks(single, part, c, "_m", f"_r_{c}", splits).drop("_m")

    ranked = joint.join(ranks(x, splits_x), [*part, x]).join(ranks(y, splits_y), [*part, y])
    if part:
        ranked = ranked.join(joint.groupBy(*part).agg(F.sum("_n").alias("n")), part)
    else:
        ranked = ranked.withColumn("n", joint.agg(F.sum("_n")).scalar())
    mid = (F.col("n") + 1) / 2.0
    dx, dy = F.col(f"_r_{x}") - mid, F.col(f"_r_{y}") - mid
    w = F.col("_n").cast("double")
    g = ranked.groupBy(*part).agg(
        F.max("n").alias("n"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"))
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return g.select(*part, "n", F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("rho"))


def detect_regressions(run_scores: DataFrame, entity: str, baseline: str, on: list[str], value: str = "score",
                       p_threshold: float = 0.05, delta_threshold: float = 0.05, minimum: int = 2,
                       method: str = "asymptotic", splits: list[float] | None = None, test: str = "mann-whitney") -> DataFrame:
    """Every entity against the baseline: flagged when significantly and clearly worse; others are kept.

    `test` is the caller's choice, `mann-whitney` or `welch`, and `test_used` records it.
    """
    return regressions_in(histogram(run_scores, [*on, entity], value), entity, baseline, on, p_threshold, delta_threshold, minimum, method,
                          splits, test)


def regressions_in(hist: DataFrame, entity: str, baseline: str, on: list[str], p_threshold: float = 0.05, delta_threshold: float = 0.05,
                   minimum: int = 2, method: str = "asymptotic", splits: list[float] | None = None, test: str = "mann-whitney") -> DataFrame:
    """`detect_regressions` from a histogram by `on` and entity."""
    stats = versus(hist, on, entity, baseline, splits)
    stats = stats.where((F.col("n_a") >= minimum) & (F.col("n_b") >= minimum))
    if test == "welch":
        tested = welch_p(welch(stats), "greater")
    elif test == "mann-whitney":
        tested = mann_whitney(stats, "greater", method)
    else:
        raise ValueError(f"unknown test {test!r}")
    delta = joins.delta_pct("mean_b", "mean_a")
    return tested.withColumn("delta_pct", delta).withColumn(
        "is_regression", (F.col("p_value") < p_threshold) & (F.col("delta_pct") < -delta_threshold))


def variant_table(runs: DataFrame, entity: str, control: str, value: str, part: list[str],
                  method: str = "asymptotic", alpha: float = 0.05, with_power: bool = True,
                  splits: list[float] | None = None) -> DataFrame:
    """Each variant against the control over all tasks, corrected over the variants of its part.

    A variant with fewer than two scores on either side gets a neutral row. Without the control there
    are no rows.
    """
    hist = histogram(runs, [*part, entity], value)
    keys = [*part, entity]
    stats = versus(hist, part, entity, control, splits)
    rows = mann_whitney(stats, "two-sided", method)
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    neutral = lambda c, other: F.when(enough, c).otherwise(F.lit(other))
    rows = rows.select(
        *keys, F.col("n_a").alias("n_control"), F.col("n_b").alias("n_variant"),
        F.col("mean_a").alias("control_mean"), F.col("mean_b").alias("mean"),
        neutral(F.col("mean_b") - F.col("mean_a"), 0.0).alias("delta"),
        neutral(joins.delta_pct("mean_b", "mean_a"), 0.0).alias("delta_pct"),
        neutral(F.col("p_value"), 1.0).alias("p_value"),
        neutral(cohens_d(), 0.0).alias("effect_size"),
        neutral(ratio(F.sqrt("var_b"), "mean_b", 0.0) * 100.0, 0.0).alias("cv_pct"), enough.alias("_enough"))
    if with_power:
        power = tails.post_hoc_power("effect_size", "n_control", "n_variant", alpha)
        rows = rows.withColumn("power", F.when(F.col("_enough"), power).otherwise(F.lit(0.0)))
    from .ranking import bonferroni
    family = F.count("*").over(Window.partitionBy(*part)) if part else None
    rows = bonferroni(rows, "p_value", part, "adjusted_p_value", family)
    return rows.drop("_enough").withColumns({
        "effect_label": labels.effect_label("effect_size"),
        "is_significant": F.col("p_value") < alpha,
        "is_significant_adjusted": F.col("adjusted_p_value") < alpha})


def compare_run_sets(run_scores: DataFrame, entity: str, keys: list[str], dim: str = "dimension",
                     value: str = "score", p_threshold: float = 0.05, delta_threshold: float = 0.05,
                     minimum: int = 2, method: str = "asymptotic", splits: list[float] | None = None,
                     chosen: DataFrame | None = None) -> DataFrame:
    """Pairs of run sets on every shared key and dimension, corrected for the nominal number of tests.

    `chosen` names the wanted run sets, or pairs of them, as in `joins.pairwise`; without it all are compared.

    The nominal number is pairs of run sets times keys found in at least two of them times dimensions,
    whether or not each of those tests could be made. All pairs of a key and dimension come from one pass over its value counts;
    values without a bound on their number need `splits`, which pairs the counts instead.
    """
    if chosen is not None:
        # Histograms of other run sets are of no use to any pair. The names are written, so that Spark knows how few they are: it
        # would else deal out the scores by run set, one task a set.
        sides_of = [c for c in chosen.columns if c in (entity, f"{entity}_a", f"{entity}_b")]
        wanted = pin(chosen.select(F.explode(F.array(*sides_of)).alias(entity)).distinct(), "chosen")
        run_scores = run_scores.join(wanted, entity, "left_semi")
    hist = pin(histogram(run_scores, [*keys, dim, entity], value), "histogram")
    sides = [*keys, dim, f"{entity}_a", f"{entity}_b"]
    if splits is not None:
        stats = two_sample(all_pairs(hist, [*keys, dim], entity, chosen), sides, splits)
    else:
        found = sweep.pair_sweep(hist, [*keys, dim], entity)
        if chosen is not None and entity not in chosen.columns:
            found = found.join(joins.ordered_pairs(chosen, entity), sides[-2:], "left_semi")
        stats = _summary(found, sides)
    stats = stats.where((F.col("n_a") >= minimum) & (F.col("n_b") >= minimum))
    tested = mann_whitney(stats, "two-sided", method)

    sets = hist.select(*keys, entity).distinct()
    shared = sets.groupBy(*keys).agg(F.count("*").alias("_c")).agg(F.count_if(F.col("_c") >= 2).alias("_keys"))
    e, d = hist.agg(F.countDistinct(entity)).scalar(), hist.agg(F.countDistinct(dim)).scalar()
    rows = tested.withColumn("n_comparisons", e * (e - 1) / 2 * shared.scalar() * d)
    rows = rows.withColumn("delta_pct", joins.delta_pct("mean_b", "mean_a")).withColumn("effect_size", cohens_d())
    rows = rows.withColumn("raw_p_value", F.col("p_value")).withColumn(
        "p_value", F.least(F.lit(1.0), F.col("p_value") * F.col("n_comparisons")))
    return rows.withColumns({
        "effect_label": labels.effect_label("effect_size"),
        "is_significant": (F.col("p_value") < p_threshold) & (F.abs("delta_pct") > delta_threshold)})
