"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation many times, each time a few turns longer. A rolling hash over the turns gives
every prefix of every conversation a fingerprint of 128 bits; a conversation whose whole fingerprint is
also that of a proper prefix of another is a snapshot of it. Identical conversations are reduced to one
first, so that both sides of the anti-join have each fingerprint once. What is left is maximal and is
rendered.

The rolling hash is the running exclusive-or of hashes that include a turn's position. It splits: turns
are numbered and hashed per block of a conversation and the totals of the blocks before are added, so a very long
conversation is never sorted in one task, and it is rendered in parts. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that make a block, and turns that make a rendered part.
BLOCK, PART = 1024, 1024
TEMPLATE = "<|{role}|>\n{text}\n"


def numbered_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position, role, text and the rolling hashes a, b of the turns up to this one.

    Turns are ordered by turn (null first), role and text and numbered from 1, whatever their turn numbers are. A
    null role or text counts as empty. Rows without conv_id are one conversation.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                         F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("block"))
    part = F.struct("conv_id")  # a struct, so that null is a key like any other
    clean = clean.withColumn("conv", part)
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (clean.groupBy("conv", "block").agg(F.count("*").alias("n"))
              .select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    placed = (clean.withColumn("local", F.row_number().over(inside)).join(counts, ["conv", "block"])
              .withColumn("position", F.col("offset") + F.col("local"))
              .withColumns({"_a": F.xxhash64("position", "role", "text"), "_b": F.xxhash64("text", "role", "position", F.lit(7))}))
    upto = Window.partitionBy("conv", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    carried = (placed.groupBy("conv", "block").agg(F.bit_xor("_a").alias("_ta"), F.bit_xor("_b").alias("_tb"))
               .select("conv", "block", F.coalesce(F.bit_xor("_ta").over(before), F.lit(0)).alias("_ca"),
                       F.coalesce(F.bit_xor("_tb").over(before), F.lit(0)).alias("_cb")))
    return (placed.withColumns({"_a": F.bit_xor("_a").over(upto), "_b": F.bit_xor("_b").over(upto)})
            .join(carried, ["conv", "block"])
            .select("conv", "position", "role", "text", F.col("_a").bitwiseXOR(F.col("_ca")).alias("a"),
                    F.col("_b").bitwiseXOR(F.col("_cb")).alias("b")))


def maximal_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, n_turns and n_copies of the conversations that are no snapshot of a longer one; of identical ones the
    smallest conv_id stays (null before all)."""
    rows = numbered_turns(turns, block).select("conv", "position", "a", "b")
    whole = rows.groupBy("conv").agg(F.max(F.struct("position", "a", "b")).alias("w")).select("conv", "w.*")
    distinct = whole.groupBy("position", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    longest = rows.groupBy("conv").agg(F.max("position").alias("n"))
    # A prefix is proper where its conversation goes on: the prefix of every turn but the last.
    proper = (rows.join(longest, "conv").where("position < n").select("position", "a", "b").distinct())
    return (distinct.join(proper, ["position", "a", "b"], "left_anti")
            .select("conv", F.col("position").alias("n_turns"), "n_copies"))


def render_chats(turns: DataFrame, template: str = TEMPLATE, block: int = BLOCK, part: int = PART) -> DataFrame:
    """conv_id, n_turns, n_copies, part, text: the maximal conversations as training texts.

    A conversation of more than `part` turns comes in parts numbered from 0, in order. Other columns of `turns` are not
    read. An empty table gives no rows.
    """
    keep = maximal_conversations(turns, block)
    rows = numbered_turns(turns, block).join(keep, "conv")
    pieces = template.replace("{role}", "\x00role\x00").replace("{text}", "\x00text\x00").split("\x00")
    line = F.concat(*[F.col(p) if p in ("role", "text") else F.lit(p) for p in pieces])
    return (rows.withColumn("part", F.floor((F.col("position") - 1) / part))
            .groupBy("conv", "part")
            .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                 F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
            .select("conv.conv_id", "n_turns", "n_copies", "part", F.array_join("lines.line", "").alias("text")))
