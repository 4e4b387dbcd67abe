"""Which words set the sources of a language apart.

Terms are counted per (language, source) in one pass. The terms by which a source exceeds its language most are found by
a dominance skyband: a term with a higher count in the group, a lower one in the language and an earlier name always ranks
before another, whatever the totals are. So a part of the terms may drop those that k others of the part dominate,
parts may be merged and thinned again, and only what is left is ranked by its exact value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from . import bytewords

#: Terms that one task thins at a time, parts that are merged at a time.
PART_ROWS, FAN_IN = 20_000, 16
#: Cells of a block of terms by sources, sources that are compared with all others at a time.
CELLS, TILE = 1_000_000, 512

#: Letters: A-Z, a-z and all beyond ASCII.
LETTERS = bytewords.byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group and rows of the group that hold it."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bytewords.chunks(batch, 2):
                w = bytewords.words(chunk.column(2), LETTERS)
                if not len(w.codes):
                    continue
                lang, source = (chunk.column(i).dictionary_encode() for i in (0, 1))
                sources = len(source.dictionary)
                group = lang.indices.to_numpy().astype("i8") * sources + source.indices.to_numpy()
                size = len(w.names)
                pairs, times = np.unique(w.doc * size + w.codes, return_counts=True)
                keys, at = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
                owner, term = keys // size, keys % size
                yield pa.RecordBatch.from_arrays([
                    lang.dictionary.take(pa.array(owner // sources)).cast(pa.string()),
                    source.dictionary.take(pa.array(owner % sources)).cast(pa.string()),
                    w.names.take(pa.array(term)).cast(pa.string()),
                    pa.array(np.bincount(at, times).astype("i8")), pa.array(np.bincount(at).astype("i8"))], schema=schema)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return (rows.mapInArrow(count, "lang string, source string, term string, n bigint, d bigint")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))


def skyband(group_count: np.ndarray, lang_count: np.ndarray, name_rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate. No two terms share a name, so domination is strict.

    In order of falling group count, then rising language count and name, every term comes after all that dominate it. Only the
    retained ones need to be looked at: of a term's dominators the first k in that order are retained themselves.
    """
    order = np.lexsort((name_rank, lang_count, -group_count))
    kept = np.empty(len(order), "i8")
    counts, names, m = np.empty(len(order), lang_count.dtype), np.empty(len(order), "i8"), 0
    for i in order:
        if m < k or np.count_nonzero((counts[:m] <= lang_count[i]) & (names[:m] <= name_rank[i])) < k:
            kept[m], counts[m], names[m] = i, lang_count[i], name_rank[i]
            m += 1
    return kept[:m]


def thinned(terms: DataFrame, k: int) -> DataFrame:
    """Of (lang, source, term, n, n_lang) the rows of each group's skyband, and few others.

    A group's terms are dealt by hash into parts of about PART_ROWS; each is thinned in its own task, then FAN_IN parts
    together, until one is left. So no task sees a whole large group.
    """
    most = terms.groupBy("lang", "source").count().agg(F.max("count")).first()[0] or 0
    parts = 1 + most // PART_ROWS
    schema = "lang string, source string, term string, n bigint, n_lang bigint, part bigint"

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["term"].str.encode("utf-8").rank(method="dense").to_numpy("i8")
        return rows.iloc[skyband(rows["n"].to_numpy(), rows["n_lang"].to_numpy(), names, k)]

    now = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    while True:
        now = now.groupBy("lang", "source", "part").applyInPandas(thin, schema)
        if parts == 1:
            return now.drop("part")
        parts = -(-parts // FAN_IN)
        now = now.withColumn("part", F.pmod("part", F.lit(parts)))


def share(n: Column, total: Column, terms: Column, add: int, scale: int) -> Column:
    """1 + floor(scale * (n + add) / (total + add * terms)), exact: products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = F.lit(scale).cast("decimal(12,0)") * wide(n + F.lit(add).cast("bigint"))
    return F.lit(1).cast("bigint") + F.call_function("div", product, wide(total + F.lit(add).cast("bigint") * terms))


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed distance of every two sources of a language, both ways.

    kept: (lang, source, term, p); groups: (lang, source, p0, n_terms, n_sources), p0 being the p of an absent term. Terms are
    dealt into blocks of at most about CELLS numbers, sources into tiles of TILE that a task compares with all sources. The result has
    a row for every two sources of a language, as asked for; no task holds more than TILE of them against all.
    """
    blocks = (F.lit(1) + F.col("n_terms") * F.col("n_sources") / F.lit(CELLS)).cast("bigint")
    tiles = (F.lit(1) + (F.col("n_sources") - 1) / F.lit(TILE)).cast("bigint")
    right = (groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
             .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))).select("lang", "block", "tile", "source", "p0"))
    left = (kept.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
            .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))).select("lang", "block", "tile", "source", "term", "p"))

    def compare(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        names = sources["source"].to_numpy()
        column = pd.Index(names).get_indexer(terms["source"])
        row, found = pd.factorize(terms["term"])
        shares = np.tile(sources["p0"].to_numpy("i8"), (len(found), 1))
        shares[row, column] = terms["p"].to_numpy("i8")
        a = np.arange(key[2] * TILE, min(len(names), (key[2] + 1) * TILE))
        sums = [np.abs(shares[:, i + 1:] - shares[:, i:i + 1]).sum(axis=0) for i in a]
        first = np.repeat(a, [len(s) for s in sums])
        second = np.concatenate([np.arange(i + 1, len(names)) for i in a]) if len(a) else first
        return pd.DataFrame({"lang": key[0], "a": names[first], "b": names[second],
                             "value": np.concatenate(sums).astype("i8") if sums else np.array([], "i8")})

    keys = ("lang", "block", "tile")
    pairs = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "lang string, a string, b string, value bigint")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return pairs.select("lang", "value", both.alias("_s")).select("lang", "_s.source", "_s.item", "value")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30,
                  top: int = 50, add: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of `docs`.

    A group's share of a term is p = 1 + floor(scale * (count + add) / (N + add * V)), over the V terms that at least `least_docs`
    rows of its language hold. Part `pair`: the item is another source of the language, the value the summed difference of
    shares. Part `term`: the item is a term with a larger share than in the whole language, the value by how much; the first `top`.
    Values fall; equal ones go by the item's UTF-8 bytes.

    Null text, lang and source are ''. Repeated rows count as often as they stand there. A group without terms has pairs only, with all
    its shares at those of absent terms; a language without kept terms has pairs of value 0; an empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = Window.partitionBy("lang", "term")
    kept = pin(pin(term_counts(docs, text_col, lang_col, source_col), "terms")
               .withColumns({"d": F.sum("d").over(own), "n_lang": F.sum("n").over(own), "mark": F.row_number().over(own.orderBy("source"))})
               .where(F.col("d") >= least_docs).select("lang", "source", "term", "n", "n_lang", (F.col("mark") == 1).cast("bigint").alias("first")),
               "kept_terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    per_lang = Window.partitionBy("lang")
    groups = pin(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
                 .join(totals, ["lang", "source"], "left").na.fill(0, ["total", "first"])
                 .withColumns({"n_terms": F.sum("first").over(per_lang), "lang_total": F.sum("total").over(per_lang),
                               "n_sources": F.count("*").over(per_lang)}).drop("first"), "groups")
    p = share(F.col("n"), F.col("total"), F.col("n_terms"), add, scale)
    q = share(F.col("n_lang"), F.col("lang_total"), F.col("n_terms"), add, scale)

    ahead = (thinned(kept.select("lang", "source", "term", "n", "n_lang"), top).join(groups, ["lang", "source"])
             .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = ahead.withColumn("rank", rank).where(F.col("rank") <= top)

    absent = F.when(F.col("n_terms") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("n_terms"), add, scale)).otherwise(F.lit(0))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n_terms", "n_sources", p.alias("p"))
    pairs = source_distances(shares, groups.withColumn("p0", absent)).withColumn("rank", rank)
    result = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return result(pairs, "pair").unionAll(result(terms, "term"))
