"""How far judges agree with themselves, with the quality tiers and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import joins, reshape, stats

# Order of the quality tiers.
TIER_ORDINAL = {"severe": 1, "mild": 2, "gold": 3}
# Weights of the recommendation.
RECOMMENDATION_WEIGHTS = {"discrimination": 0.40, "determinism": 0.30, "consistency": 0.30}


def known_tiers(judgements: DataFrame) -> DataFrame:
    """Only the tiers with an order; others take no part in the metrics."""
    return judgements.where(F.col("tier").isin(list(TIER_ORDINAL)))


def determinism(judgements: DataFrame, criteria: list[str], judge: str = "model") -> DataFrame:
    """Variance of repeated scores of the same sample and criterion: its mean, and the share of zeros."""
    groups = reshape.agg_dims(known_tiers(judgements), [judge, "task", "tier"], criteria, {"v": F.var_samp}, "criterion")
    return groups.where("n >= 2").groupBy(judge).agg(
        F.avg("v").alias("mean_variance"), F.count("*").alias("groups"),
        (F.count_if(F.col("v") == 0) / F.count("*") * 100.0).alias("pct_deterministic"))


def discrimination(judgements: DataFrame, measures: list[str], judge: str = "model") -> DataFrame:
    """Tier means and the distance of gold from severe, per judge and measure."""
    aggs = {}
    for tier, side in [("gold", "a"), ("severe", "b"), ("mild", "m")]:
        pick = lambda c, tier=tier: F.when(F.col("tier") == tier, c)
        aggs[f"mean_{side}"] = lambda c, pick=pick: F.avg(pick(c))
        aggs[f"n_{side}"] = lambda c, pick=pick: F.count(pick(c))
        aggs[f"var_{side}"] = lambda c, pick=pick: F.coalesce(F.var_samp(pick(c)), F.lit(0.0))
    g = reshape.agg_dims(known_tiers(judgements), [judge], measures, aggs, "measure")
    return g.withColumn("d", stats.cohens_d("average")).select(
        judge, "measure", F.coalesce("mean_a", F.lit(0.0)).alias("gold_mean"),
        F.coalesce("mean_m", F.lit(0.0)).alias("mild_mean"),
        F.coalesce("mean_b", F.lit(0.0)).alias("severe_mean"), "d")


def tier_correlation(judgements: DataFrame, score: str = "normalized", judge: str = "model") -> DataFrame:
    """Rank correlation of tier and score per judge."""
    ordinal = F
    for tier, o in TIER_ORDINAL.items():
        ordinal = ordinal.when(F.col("tier") == tier, o)
    counts = known_tiers(judgements).groupBy(judge, ordinal.alias("ordinal"), F.col(score).alias("score")).agg(
        F.count("*").alias("n"))
    return stats.spearman(counts, [judge], "ordinal", "score")


def inter_rater(judgements: DataFrame, score: str = "normalized", judge: str = "model",
                sample: tuple[str, ...] = ("task", "tier")) -> DataFrame:
    """Mean over judge pairs of the rank correlation of their mean scores on shared samples.

    One row: fewer than two judges agree fully, no usable pair is 0.
    """
    keys = list(sample)
    # Means that are equal in exact arithmetic must tie, whatever order they were summed in.
    means = judgements.where(F.col(score).isNotNull()).groupBy(judge, *keys).agg(F.round(F.avg(score), 9).alias("m"))
    pairs = joins.pairwise(means, judge, keys, ["m"])
    a, b = f"{judge}_a", f"{judge}_b"
    counts = pairs.groupBy(a, b, "m_a", "m_b").agg(F.count("*").alias("n"))
    rho = stats.spearman(counts, [a, b], "m_a", "m_b").where("n >= 3")
    summary = rho.agg(F.avg("rho").alias("_r"), F.count("*").alias("pairs"))
    judges = means.agg(F.countDistinct(judge).alias("judges"))
    return summary.withColumn("judges", judges.scalar()).select("judges", "pairs", F.when(F.col("judges") < 2, 1.0).otherwise(
        F.coalesce("_r", F.lit(0.0))).alias("agreement"))


def recommend(judgements: DataFrame, criteria: list[str], score: str = "normalized", judge: str = "model") -> DataFrame:
    """Score each judge relative to the best one on discrimination, determinism and variance, and rank.

    Rows without a score are failures: counted, and otherwise left out.
    """
    valid = judgements.where(F.col(score).isNotNull())
    det = determinism(valid, criteria, judge)
    dis = discrimination(valid, [score], judge).drop("measure")
    corr = tier_correlation(valid, score, judge).select(judge, F.col("rho").alias("tier_correlation"))
    failures = judgements.groupBy(judge).agg(
        F.count(score).alias("successful"), F.count_if(F.col(score).isNull()).alias("failed"))
    m = dis.join(det, judge, "left").join(corr, judge).join(failures, judge).fillna(
        0.0, ["mean_variance", "pct_deterministic"])
    m = pin(m, "judges")
    m = m.withColumns({"_d": m.agg(F.max("d")).scalar(), "_p": m.agg(F.max("pct_deterministic")).scalar(),
                       "_v": m.agg(F.max("mean_variance")).scalar()})
    top = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(1.0))
    w = RECOMMENDATION_WEIGHTS
    total = (w["discrimination"] * F.col("d") / top("_d") + w["determinism"] * F.col("pct_deterministic") / top("_p")
             + w["consistency"] * (1.0 - F.col("mean_variance") / top("_v")))
    m = m.withColumn("recommendation_score", total)
    winner = m.agg(F.min_by(judge, F.struct(-F.round("recommendation_score", 9), F.col(judge))))
    m = m.withColumn("recommended", F.col(judge) == winner.scalar())
    reasoning = F.format_string(
        "%s scored highest overall (score=%.2f): discrimination=%.2f, determinism=%.0f%%, variance=%.3f",
        F.col(judge), F.col("recommendation_score"), F.col("d"), F.col("pct_deterministic"), F.col("mean_variance"))
    return m.withColumn("reasoning", F.when(F.col("recommended"), reasoning)).drop("_d", "_p", "_v", "groups")
