"""Between score maps, score columns and one row per run and dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_dimensions(df: DataFrame, scores: str = "scores") -> list[str]:
    """Sorted names of the dimensions present; the one list a wide layout needs up front."""
    row = df.select(F.explode(F.map_keys(scores)).alias("d")).agg(
        F.array_sort(F.collect_set("d")).alias("dims")).first()
    return list(row["dims"])


def widen(df: DataFrame, dims: list[str], scores: str = "scores", prefix: str = "") -> DataFrame:
    """Score map to one column per dimension."""
    return df.select("*", *[F.col(scores)[d].alias(prefix + d) for d in dims]).drop(scores)


def to_long(df: DataFrame, dims: list[str], name: str = "dimension", value: str = "score") -> DataFrame:
    """One row per run and dimension that has a value."""
    rest = [c for c in df.columns if c not in dims]
    entries = F.array(*[F.struct(F.lit(d).alias(name), F.col(d).alias(value)) for d in dims])
    return (df.select(*rest, F.explode(entries).alias("_e"))
            .select(*rest, f"_e.{name}", f"_e.{value}").where(F.col(value).isNotNull()))


def map_to_long(df: DataFrame, scores: str = "scores", name: str = "dimension",
                value: str = "score") -> DataFrame:
    rest = [c for c in df.columns if c != scores]
    return df.select(*rest, F.explode(scores).alias(name, value)).where(F.col(value).isNotNull())


def agg_dims(df: DataFrame, by: list[str], dims: list[str], aggs: dict, name: str = "dimension",
             sums: dict[str, str] | None = None, sums_by: list[str] | None = None, summed: bool = False) -> DataFrame:
    """Aggregate score columns, then turn the few result rows into one row per dimension.

    Exploding first would send every run through the aggregation once per dimension; this way a run
    is read once and only results are exploded. `aggs` maps an output name to a function of a
    column. Dimensions without any value in a group give no row. `sums` maps names to columns that are summed over all rows
    of a group of `sums_by`, a part of `by`. `summed` tells that the rows are cells of `cell_sums`; `aggs` are then functions of a
    sum and a count.
    """
    sums = sums or {}
    count = (lambda d: F.sum(f"`{d}.n`")) if summed else F.count
    of = (lambda fn, d: fn(F.sum(d), count(d))) if summed else (lambda fn, d: fn(F.col(d)))
    cols = [count(d).alias(f"{d}.n") for d in dims]
    cols += [of(fn, d).alias(f"{d}.{out}") for d in dims for out, fn in aggs.items()]
    wide = df.groupBy(*by).agg(*cols, *[F.sum(c).alias(out) for out, c in sums.items()])
    wide = wide.withColumns({out: F.sum(out).over(Window.partitionBy(*(sums_by or by))) for out in sums})
    entries = F.array(*[
        F.struct(F.lit(d).alias(name), F.col(f"`{d}.n`").alias("n"),
                 *[F.col(f"`{d}.{out}`").alias(out) for out in aggs])
        for d in dims])
    return (wide.select(*by, *sums, F.explode(entries).alias("_e"))
            .select(*by, *sums, f"_e.{name}", "_e.n", *[f"_e.{out}" for out in aggs])
            .where(F.col("n") > 0))


def cell_sums(df: DataFrame, by: list[str], means: list[str], sums: list[str]) -> DataFrame:
    """Sums of columns per cell, and counts (`.n`) of those whose means are wanted: means over any part of `by` follow from them."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in [*means, *sums]], *[F.count(c).alias(f"{c}.n") for c in means])
