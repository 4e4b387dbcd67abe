"""Row selection and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_runs(df: DataFrame, **names: list | None) -> DataFrame:
    """Keep the rows whose columns are in the given lists; a column without a list is not filtered."""
    for column, values in names.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def having_n(df: DataFrame, minimum: int = 2, *counts: str) -> DataFrame:
    """Keep comparisons with at least `minimum` on every count."""
    for c in counts or ("n_a", "n_b"):
        df = df.where(F.col(c) >= minimum)
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it, all rules in one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_bad")) for name in rules])
    return counts.select("n", F.explode(entries).alias("e")).select("e.rule", "e.n_bad", "n")


def statistic_rules(stdev: Column, n: Column, weights: list[Column]) -> dict[str, Column]:
    """Rules on aggregated scores: no negative spread, at least one score, weights that add up to 1."""
    total = sum(weights[1:], weights[0])
    return {"spread_not_negative": stdev >= 0, "count_positive": n >= 1, "weights_add_up": F.abs(total - 1.0) < 1e-9}


def task_rules() -> dict[str, Column]:
    """Rules on task definitions: what each type of task has to bring, and the known sizes."""
    some = lambda *names: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]).isNotNull()
    kind = F.coalesce("task_type", F.lit(""))
    return {"starter_present": ~kind.isin("bug-fix", "refactor") | some("starter_code", "starter_files"),
            "rules_present": (kind != "instruction") | some("task_rules", "prompt_rules"),
            "size_known": F.coalesce(F.col("size").isin("function", "module"), F.lit(False))}


def rescore_reasons(runs: DataFrame, tasks: DataFrame, profiles: DataFrame, force: bool = False,
                    rerun_empty: bool = False) -> DataFrame:
    """Successful runs that are candidates to be scored again, with the reason against it or null.

    A candidate has no scores, or is forced, or is degraded and `rerun_empty`. `tasks` and `profiles`
    are the known names; they are marked on in one left join each, so no run is read twice.
    """
    wanted = F.col("scores").isNull()
    if force:
        wanted = F.lit(True)
    elif rerun_empty:
        wanted = wanted | F.coalesce(F.col("degraded"), F.lit(False))
    cand = runs.where((F.col("status") == "success") & wanted)
    cand = (cand.join(tasks.select("task").distinct().withColumn("_t", F.lit(True)), "task", "left")
            .join(profiles.select("profile").distinct().withColumn("_p", F.lit(True)), "profile", "left"))
    missing = (F.col("task").isNull() | F.col("profile").isNull() | F.col("model").isNull()
               | F.col("run_number").isNull())
    reason = (F.when(missing, "missing required fields").when(F.col("_t").isNull(), "unknown task")
              .when(F.col("_p").isNull(), "unknown profile"))
    return cand.withColumn("reason", reason).drop("_t", "_p")


def select_rescore(runs: DataFrame, tasks: DataFrame, profiles: DataFrame, force: bool = False,
                   rerun_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs to score again, and the candidates rejected with a reason: the two halves of `rescore_reasons`."""
    marked = rescore_reasons(runs, tasks, profiles, force, rerun_empty)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def source_files(df: DataFrame, path: str, suffix: str = "py") -> DataFrame:
    """Code files without tests and caches."""
    p = F.col(path)
    name = F.substring_index(p, "/", -1)
    return df.where(p.endswith(f".{suffix}") & ~p.contains("__pycache__")
                    & ~name.startswith("test_") & ~name.endswith(f"_test.{suffix}"))


def catalog_find(cat: DataFrame, ids: list[str] = (), tags: list[str] = (), names: list[str] = ()) -> DataFrame:
    """Entries matched by id, by any tag or by a part of the name; `match_rank` is the first way that matched."""
    by_id = F.col("run_id").isin(list(ids)) if ids else F.lit(False)
    by_tag = F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])) if tags else F.lit(False)
    by_name = F.lit(False)
    for part in names:
        by_name = by_name | F.lower("name").contains(part.lower())
    rank = F.when(by_id, 1).when(by_tag, 2).when(by_name, 3)
    return cat.withColumn("match_rank", rank).where(F.col("match_rank").isNotNull())


def catalog_list(cat: DataFrame, tags: list[str] = (), model: str | None = None, task: str | None = None) -> DataFrame:
    if tags:
        cat = cat.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    if model:
        cat = cat.where(F.array_contains("models", model))
    if task:
        cat = cat.where(F.array_contains("tasks", task))
    return cat.withColumn("date", F.left("timestamp", F.lit(10))).withColumn("task_count", F.size("tasks"))
