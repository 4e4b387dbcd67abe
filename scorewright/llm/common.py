"""Helpers that several of the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte per character take the quick path, which does the same there."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def range_bucket(key: Column, splits: list) -> Column:
    """How many of the sorted split points are at most `key`: first among every k-th, then between two of them."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    coarse = splits[step - 1::step]
    fine = [splits[i:i + step - 1] for i in range(0, len(splits) + 1, step)][:len(coarse) + 1]
    fine += [[]] * (len(coarse) + 1 - len(fine))
    literal = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    count = lambda xs: F.size(F.filter(xs, lambda s: s <= key))
    c = count(literal(coarse))
    return c * step + count(F.element_at(F.array(*[literal(f) for f in fine]), c + 1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs as (node, root), root being the smallest node; nodes without a pair are absent.

    Large-star and small-star steps: every node hands its neighbours the smallest one it knows. Both are a
    minimum per node, which combines before the shuffle, and a join, so that no list of neighbours is ever
    gathered. Each round is written to the shared folder, which cuts the lineage.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return (df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = pin(oriented(edges), "edges")
    before = None
    for _ in range(rounds):
        mark = signature(now)
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pin(oriented(large), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
        now = pin(oriented(small), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct `_row`, so that no name of theirs meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def row_columns(docs: DataFrame, replaced: dict[str, Column] | None = None) -> list[Column]:
    """The columns out of `_row` as `docs` has them, some replaced; those that `docs` doesn't have come last."""
    replaced = replaced or {}
    own = [replaced.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]
    return own + [value.alias(c) for c, value in replaced.items() if c not in docs.columns]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of `docs` whose (id, mark) is in `kept` (`_k_id` a struct of the id, `_k_mark`), one row of each; columns of any name.

    Rows are matched by what they hold, not by their place in a scan, so a lost task can be run again anywhere.
    The join and the numbering share one shuffle.
    """
    first = Window.partitionBy("_k_id", "_k_mark").orderBy(F.lit(1))
    return (docs.select(F.struct(F.col(id_col).alias("id")).alias("_k_id"), mark.alias("_k_mark"), whole_row(docs))
            .join(kept, ["_k_id", "_k_mark"], "left_semi").withColumn("_k_n", F.row_number().over(first))
            .where("_k_n = 1").select(*row_columns(docs)))
