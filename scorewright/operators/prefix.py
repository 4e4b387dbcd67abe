"""Running totals that hold when one group has a third of all rows.

A window over a group sorts that whole group in one task. Where the group is a table of groups or
of distinct rounded scores this is fine: its size does not grow with the runs. Over runs it is not.
`running` therefore works in two levels once it is given split points: rows are divided by range
into buckets, each (group, bucket) is summed in its own task, and the totals of the buckets before
it, at most one row per bucket, are added on top. The sums within buckets are written once; totals and rows are both read
from there, so the input is read and dealt out once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import pin

BUCKET = "_bucket"


def range_splits(df: DataFrame, order: Column | str, buckets: int | None = None) -> list[float]:
    """Split points that divide the rows about evenly by `order` (a number).

    One pass that returns at most `buckets` numbers, the same work Spark does to sort by range. The
    points are literals afterwards, so a retried task sees the same buckets. Without `buckets` there are four for every
    shuffle partition, so they grow with what the session is sized for.
    """
    if buckets is None:
        buckets = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    points = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(col(order).cast("double"), points, 10 * buckets).alias("p")).first()
    return sorted(set(row["p"] or []))


def bucket_of(order: Column | str, splits: list[float]) -> Column:
    """Number of split points below the value: a coarse step, then a fine one within it."""
    v = col(order).cast("double")
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    coarse = splits[step - 1::step]
    fine = [splits[i:i + step] for i in range(0, len(splits), step)]
    if len(fine) <= len(coarse):
        fine.append([])
    c = F.size(F.filter(F.array(*[F.lit(float(x)) for x in coarse]), lambda s: s < v))
    groups = F.array(*[
        F.array(*[F.lit(float(x)) for x in g]).cast("array<double>") for g in fine
    ])
    return c * step + F.size(F.filter(F.element_at(groups, c + 1), lambda s: s < v))


def running(df: DataFrame, part: list[str], order: list[str], sums: dict[str, Column | str],
            splits: list[float] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums along `order` within `part`.

    `order` must be a total order of the rows of a group; `splits` are split points of its first
    column. Without splits the groups must be known to be small. `totals` names columns for the whole sums of some of them.
    """
    values = {name: col(c) for name, c in sums.items()}
    totals = totals or {}
    if splits is None:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({**{name: F.sum(c).over(w) for name, c in values.items()},
                               **{out: F.sum(values[name]).over(Window.partitionBy(*part)) for name, out in totals.items()}})

    bucketed = df.withColumn(BUCKET, bucket_of(order[0], splits))
    inside = (Window.partitionBy(*part, BUCKET).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    bucket, before = _around(part)
    local = pin(bucketed.withColumns({**{name: F.sum(c).over(inside) for name, c in values.items()},
                                      **{f"_t_{name}": F.sum(c).over(bucket) for name, c in values.items()}}), "running")
    offsets = (local.groupBy(*part, BUCKET).agg(*[F.first(f"_t_{name}").alias(f"_t_{name}") for name in values])
               .select(*part, BUCKET, *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in values],
                       *[F.sum(f"_t_{name}").over(Window.partitionBy(*part)).alias(out) for name, out in totals.items()]))
    joined = local.join(offsets, [*part, BUCKET])
    out = joined.withColumns({name: F.col(name) + F.col(f"_o_{name}") for name in values})
    return out.drop(BUCKET, *[f"_{kind}_{name}" for kind in "ot" for name in values])


def _around(part: list[str]):
    """Windows over a bucket, and over the table of buckets before one."""
    return (Window.partitionBy(*part, BUCKET),
            Window.partitionBy(*part).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1))


def running_max(df: DataFrame, part: list[str], order: str, value: str, out: str,
                splits: list[float] | None = None) -> DataFrame:
    """Add the maximum of `value` over all rows strictly before, null for the first row of a group."""
    if splits is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.max(value).over(w))
    bucketed = df.withColumn(BUCKET, bucket_of(order, splits))
    inside = (Window.partitionBy(*part, BUCKET).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    bucket, before = _around(part)
    local = pin(bucketed.withColumns({out: F.max(value).over(inside), "_t": F.max(value).over(bucket)}), "running")
    offsets = (local.groupBy(*part, BUCKET).agg(F.first("_t").alias("_t"))
               .select(*part, BUCKET, F.max("_t").over(before).alias("_o")))
    return (local.drop("_t").join(offsets, [*part, BUCKET])
            .withColumn(out, F.greatest(out, "_o")).drop(BUCKET, "_o"))


def row_numbers(df: DataFrame, part: list[str], order: list[str], out: str = "row_number",
                splits: list[float] | None = None, total: str | None = None) -> DataFrame:
    """Number the rows of each group; `total` names a column for their number."""
    return running(df, part, order, {out: F.lit(1).cast("bigint")}, splits, {out: total} if total else None)


def mid_ranks(counts: DataFrame, part: list[str], value: str, n: str = "n", out: str = "mid_rank",
              splits: list[float] | None = None) -> DataFrame:
    """Average rank of each distinct value, from a table of value counts."""
    summed = running(counts, part, [value], {"_cum": F.col(n)}, splits)
    return summed.withColumn(out, F.col("_cum") - (F.col(n) - 1) / 2.0).drop("_cum")
