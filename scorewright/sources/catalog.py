"""The catalog of run sets: taking in, removing, tagging. Every change gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import assign_ids


def intake(cat: DataFrame, new: DataFrame, force: bool = False, order: str = "results_path") -> tuple[DataFrame, DataFrame]:
    """Add run sets that have no id yet; returns the catalog and the rejected duplicates.

    A run set whose path is known is rejected, or with `force` replaces the known entry. The name
    defaults to the last part of the path.
    """
    known = cat.select("results_path").distinct()
    rejected = new.limit(0) if force else new.join(known, "results_path", "left_semi")
    fresh = new if force else new.join(known, "results_path", "left_anti")
    kept = cat.join(fresh.select("results_path").distinct(), "results_path", "left_anti") if force else cat
    named = fresh.withColumn("name", F.coalesce("name", F.substring_index("results_path", "/", -1)))
    numbered = assign_ids(named, cat, "run_id", [order])
    return kept.unionByName(numbered.select(*cat.columns)), rejected


def remove(cat: DataFrame, ids: DataFrame) -> DataFrame:
    return cat.join(ids.select("run_id"), "run_id", "left_anti").select(*cat.columns)


def tag(cat: DataFrame, tags: DataFrame) -> DataFrame:
    """Add tags (columns run_id, tags) to entries; tags are sorted and unique."""
    extra = tags.select("run_id", F.explode("tags").alias("_t")).groupBy("run_id").agg(F.collect_set("_t").alias("_t"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_t", none)))
    return cat.join(extra, "run_id", "left").withColumn("tags", both).select(*cat.columns)
