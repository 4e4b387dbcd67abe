"""Exact deduplication by recipes of content-defined chunks.

A text, lower-cased in A-Z, is cut where its own content says so, so equal passages give equal chunks.
A chunk's identifier is its 64-bit hash, and it is verified: one pass groups all chunks by hash and text
(copies combine before the shuffle) and finds the hashes that stand for more than one text. A text is
its ordered list of identifiers; texts are equal if and only if these lists are. A text with an
unverified hash also compares the SHA-256 of its chunks. Whole texts never move, and a chunk once.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import keep_rows, lower_ascii

#: Lazily at least 512 characters up to a place after vowel, consonant and white space; else 4096 or the rest.
CHUNK = r"(?s).{512,4096}?(?<=[aeiou][lnrst]\s)|.{1,4096}"


def normal(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(normal(text), F.lit(CHUNK), 0)


def recipes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: row_id, id, text_sha256 and the chunks' hashes and digests in order."""
    ids = F.transform(F.col("_chunks"), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("s")))
    return (docs.select(F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_text"))
            .withColumn("_chunks", F.regexp_extract_all("_text", F.lit(CHUNK), 0))
            .select(F.monotonically_increasing_id().alias("row_id"), "_id", F.sha2("_text", 256).alias("text_sha256"),
                    ids.alias("ids")))


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct chunks of all texts: h, chunk, n (how often it occurs)."""
    return (docs.select(F.explode(chunks(F.col(text_col))).alias("chunk"))
            .groupBy(F.xxhash64("chunk").alias("h"), "chunk").agg(F.count("*").alias("n")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 store: DataFrame | None = None) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. The largest id of equal texts stays; a null
    id stays only if the group has no other, and of rows that repeat an id just one is kept. Other columns
    of `docs` are not read. An empty table gives no rows. `store` is the table of `chunk_store`, if there is one.
    """
    rows = pin(recipes(docs, id_col, text_col), "recipes")
    store = chunk_store(docs, text_col) if store is None else store
    # Written out, this next to empty table has a size, by which Spark plans the join: small, it is sent to the rows.
    shared = pin(store.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "shared")
    unsure = (rows.select("row_id", F.explode(F.array_distinct("ids.h")).alias("h")).join(shared, "h")
              .select("row_id").distinct().withColumn("unsure", F.lit(True)))
    empty = F.array().cast("array<binary>")
    keyed = rows.join(unsure, "row_id", "left").select(
        "row_id", "_id", "text_sha256", F.col("ids.h").alias("recipe"),
        F.when(F.col("unsure"), F.col("ids.s")).otherwise(empty).alias("digests"))
    keyed = keyed.withColumn("mark", F.xxhash64("recipe", "digests"))
    key = ["mark", "recipe", "digests"]
    # Written out, so that both sides of the join are dealt by key and Spark can split a large group of copies.
    groups = pin(keyed.groupBy(*key).agg(F.max(F.struct("_id", "row_id")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return keyed.join(groups, key).select(
        F.col("_id").alias(id_col), F.col("keep._id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they are."""
    kept = (exact_groups(docs, id_col, text_col).where("kept")
            .select(F.struct(F.col(id_col).alias("id")).alias("_k_id"), F.col("text_sha256").alias("_k_mark")))
    return keep_rows(docs, kept, id_col, F.sha2(normal(F.col(text_col)), 256))
