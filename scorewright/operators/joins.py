"""Baselines, pairs of run sets, overlaps, run matrices and reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def vs_baseline(groups: DataFrame, entity: str, baseline: str, on: list[str], values: list[str]) -> DataFrame:
    """Every entity beside the baseline entity of the same keys; no baseline, no row.

    `groups` are group results, one row per key and entity.
    """
    same_keys = Window.partitionBy(*on)
    is_base = F.col(entity) == baseline
    # A window rather than a join: the filters of a join's two sides would each run their own scan.
    return groups.withColumns({
        "_has": F.max(is_base).over(same_keys),
        **{f"baseline_{v}": F.max(F.when(is_base, F.col(v))).over(same_keys) for v in values},
    }).where(~is_base & F.col("_has")).drop("_has")


def pairwise(groups: DataFrame, entity: str, on: list[str], values: list[str], chosen: DataFrame | None = None) -> DataFrame:
    """Each unordered pair of entities that share a key, over group results.

    `chosen` is a table of the wanted entities (a column named as `entity`, such as catalog_find returns) or of the
    wanted pairs (columns with _a and _b); without it every pair is an answer. What is paired are group results, never runs.
    """
    if chosen is not None and entity in chosen.columns:
        groups, chosen = groups.join(chosen.select(entity).distinct(), entity, "left_semi"), None
    a = groups.select(*on, F.col(entity).alias(f"{entity}_a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = groups.select(*on, F.col(entity).alias(f"{entity}_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    pairs = [f"{entity}_a", f"{entity}_b"]
    if chosen is None:
        return a.join(b, on).where(F.col(pairs[0]) < F.col(pairs[1]))
    wanted = ordered_pairs(chosen, entity)
    return a.join(wanted, pairs[0]).join(b, [*on, pairs[1]]).select(*on, *pairs, *[f"{v}_{s}" for s in "ab" for v in values])


def ordered_pairs(chosen: DataFrame, entity: str) -> DataFrame:
    """Distinct pairs of different entities, the smaller name on side a."""
    a, b = f"{entity}_a", f"{entity}_b"
    return chosen.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) < F.col(b)).distinct()


def overlap(runs: DataFrame, entity: str, keys: list[str], minimum: int = 2) -> DataFrame:
    """Keys found in at least `minimum` run sets, with their number."""
    pairs = runs.select(*keys, entity).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias("run_sets")).where(F.col("run_sets") >= minimum)


def unique_keys(runs: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Keys found in exactly one run set, with that run set."""
    pairs = runs.select(*keys, entity).distinct()
    return (pairs.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(entity).alias(entity))
            .where("_n = 1").drop("_n"))


def intersect_all(runs: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Per run set: combinations of its own, unique ones, and those that every run set has."""
    pairs = runs.select(*keys, entity).distinct()
    counted = pairs.join(pairs.groupBy(*keys).agg(F.count("*").alias("_sets")), keys)
    total = pairs.select(entity).distinct().agg(F.count("*").alias("_all"))
    per_set = counted.groupBy(entity, "_sets").agg(F.count("*").alias("_n"))
    return per_set.withColumn("_all", total.scalar()).groupBy(entity).agg(
        F.sum("_n").alias("combinations"),
        F.coalesce(F.sum(F.when(F.col("_sets") == 1, F.col("_n"))), F.lit(0)).alias("unique_combinations"),
        F.coalesce(F.sum(F.when(F.col("_sets") == F.col("_all"), F.col("_n"))), F.lit(0)).alias("in_all_sets"))


def expand_variants(runs: DataFrame, run_set: str = "run_set", profile: str = "profile",
                    variant: str = "variant") -> DataFrame:
    """Each run set and variant becomes a run set of its own; profiles fall together as `_all`."""
    return runs.withColumn(run_set, F.concat_ws(":", F.col(run_set).cast("string"), profile, variant)).withColumn(
        profile, F.lit("_all"))


def run_matrix(plans: DataFrame, axes: list[str], reps: str = "reps") -> DataFrame:
    """All planned runs of plan rows that name their axes as arrays: one row per combination and repetition.

    A plan is one row and a matrix is many: the rows are dealt out after the first axis.
    """
    out = plans
    for i, axis in enumerate(axes):
        out = out.withColumn(axis, F.explode(axis))
        out = out.repartition(axis) if i == 0 else out
    return out.withColumn("run_number", F.explode(F.sequence(F.lit(1), F.col(reps).cast("int")))).drop(reps)


def remaining(plan: DataFrame, done: DataFrame, on: list[str], retry_failures: bool = False) -> DataFrame:
    """Planned runs that are not completed; failures count as completed unless they are to be retried."""
    completed = done.where(F.col("success")) if retry_failures else done
    return plan.join(completed.select(*on), on, "left_anti")


def expand_experiment(variants: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Variants to planned runs: own models or the default ones, own temperature or the default one.

    `defaults` gives `models`, `tasks` and `profiles` as arrays, `reps` and `temperature`.
    """
    prefix = F.nullif(F.concat(F.coalesce("padding", F.lit("")), F.coalesce("prompt_prefix", F.lit(""))), F.lit(""))
    own = F.size(F.coalesce("models", F.array().cast("array<string>"))) > 0
    plan = variants.select(
        F.col("label").alias("variant_label"), prefix.alias("prompt_prefix"),
        F.coalesce("temperature", defaults["temperature"]).alias("temperature"),
        F.when(own, F.col("models")).otherwise(defaults["models"]).alias("model"),
        defaults["tasks"].alias("task"), defaults["profiles"].alias("profile"), defaults["reps"].alias("reps"))
    return run_matrix(plan, ["model", "task", "profile"])


def missing_refs(df: DataFrame, dim: DataFrame, on: str, n: str | None = None) -> DataFrame:
    """Names used in `df` that the dimension does not have, with the number of uses; `n` is the column of counts if rows are counted already."""
    used = df.groupBy(on).agg((F.sum(n) if n else F.count("*")).alias("uses"))
    return used.join(dim.select(on), on, "left_anti")


def output_pairs(best: DataFrame, on: list[str], entity: str = "profile", output: str = "code_output") -> DataFrame:
    """Pairs of entities with a non-empty output for the same keys, from one best run per key and entity."""
    some = best.where(F.coalesce(F.col(output), F.lit("")) != "")
    return pairwise(some, entity, on, [output])


def with_variant_config(runs: DataFrame, variants: DataFrame, label: str = "variant_label") -> DataFrame:
    """Settings of its variant on each run; the run's own temperature wins over the variant's."""
    settings = variants.withColumnRenamed("temperature", "_t")
    return runs.join(settings, label, "left").withColumn("temperature", F.coalesce("temperature", "_t")).drop("_t")


def delta_pct(value: str, base: str) -> Column:
    """Relative change; 0 where the base is 0."""
    return ratio(F.col(value) - F.col(base), base, 0.0)
