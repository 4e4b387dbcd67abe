"""Exports: nested JSON, flat CSV and the partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite, finite_map
from ..session import pin


def nested(runs: DataFrame, fields: list[str], scores: str = "scores", size: int = 10_000) -> DataFrame:
    """Documents of profile, task and runs, with non-finite scores as null.

    A document is one page of about `size` runs of a profile and task; a large task has many pages,
    and every run is on exactly one. Pages are dealt by hash before the runs are gathered, so the
    number of runs of a task bounds neither the memory of a task nor the length of a line. The number of pages
    per profile and task is a small table of a known size, so Spark sends it to the runs and not the runs to it.
    """
    clean = runs.withColumn(scores, finite_map(scores))
    sizes = pin(runs.groupBy("profile", "task").agg(F.ceil(F.count("*") / size).alias("pages")), "pages")
    dealt = clean.join(sizes, ["profile", "task"]).withColumn(
        "page", F.pmod(F.xxhash64(*fields), F.col("pages")))
    return dealt.groupBy("profile", "task", "page", "pages").agg(
        F.collect_list(F.struct(*fields, scores)).alias("runs"))


def write_json(runs: DataFrame, path: str, fields: list[str], scores: str = "scores") -> None:
    nested(runs, fields, scores).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_wide(runs: DataFrame, dims: list[str], scores: str = "scores", variants: bool = True) -> DataFrame:
    """One flat row per run; each dimension is a column `score_<dimension>`, a missing error is empty."""
    cols = ["profile", "task", "model", "success", F.coalesce("error", F.lit("")).alias("error"), "token_count",
            "code_output"]
    if variants:
        cols.append("variant_label")
    return runs.select(*cols, *[finite(F.col(scores)[d]).alias(f"score_{d}") for d in dims])


def write_csv(wide: DataFrame, path: str) -> None:
    """Texts may hold line breaks and quotes; both are kept."""
    wide.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


PARTITIONS = ["model", "profile", "task"]


def write_runs(runs: DataFrame, path: str) -> None:
    """Store runs under model/profile/task; a rewrite replaces only the partitions it holds.

    The rows of a partition are brought together for few files; the rebalance splits a hot partition over
    several tasks and joins small ones.
    """
    (runs.hint("rebalance", *PARTITIONS).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))


def store_runs(runs: DataFrame, path: str, values: list[str]) -> None:
    """`write_runs` with mergeable sums of `values` beside the runs, one row per partition.

    Both are written from one staged copy of the new runs, so the runs of a rewritten partition and its sums agree; no other
    partition is read or written.
    """
    staged = pin(runs, "staged")
    write_runs(staged, path)
    v = lambda name, fn: fn(F.col(name).cast("double"))
    sums = staged.groupBy(*PARTITIONS).agg(F.count("*").alias("runs"), *[
        v(name, fn).alias(f"{name}_{kind}") for name in values
        for kind, fn in (("n", F.count), ("sum", F.sum), ("squares", lambda c: F.sum(c * c)), ("min", F.min), ("max", F.max))])
    (sums.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(sums_path(path)))


def sums_path(path: str) -> str:
    """Beside the runs; readers of the runs pass over names that start with an underscore."""
    return f"{path.rstrip('/')}/_sums"


def read_sums(spark: SparkSession, path: str, by: list[str], values: list[str]) -> DataFrame:
    """runs, and n, mean, stdev, min and max of each value per group of `by` (partition columns), merged from the stored sums alone.

    A group without a value has n 0 and nulls; one value, or equal ones, have deviation 0.
    """
    g = spark.read.parquet(sums_path(path)).groupBy(*by).agg(F.sum("runs").alias("runs"), *[
        fn(f"{name}_{kind}").alias(f"{name}_{kind}") for name in values
        for kind, fn in (("n", F.sum), ("sum", F.sum), ("squares", F.sum), ("min", F.min), ("max", F.max))])
    for name in values:
        n, total, squares = (F.col(f"{name}_{kind}") for kind in ("n", "sum", "squares"))
        var = F.try_divide(squares - F.try_divide(total * total, n), n - 1)
        flat = (F.col(f"{name}_min") == F.col(f"{name}_max"))
        g = g.withColumns({f"{name}_mean": F.try_divide(total, n), f"{name}_stdev": F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))})
    return g.drop(*[f"{name}_{kind}" for name in values for kind in ("sum", "squares")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: sorted names of models, profiles and tasks that the store holds, and its runs, from the sums alone."""
    sums = spark.read.parquet(sums_path(path))
    return sums.agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in PARTITIONS], F.sum("runs").alias("total_runs"))
