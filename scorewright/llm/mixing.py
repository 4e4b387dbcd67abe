"""Mixing sources to target weights with exact budgets.

Every document gets a hash-random key. Within its source, documents are sorted by that key in ranges: keys
are uniform, so equal slices of the key space hold about equally many rows and a hot source simply has more
of them. Running totals are taken per range and the totals of the ranges before are added. Each source has
a budget in words; it is passed through whole as often as it fits, and the last pass is cut at the exact
word where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .common import row_columns, whole_row
from .common import WORD

#: Ranges that the whole table is sorted in, for each shuffle partition; a source has its share of them.
RANGES = 4
#: A source is passed through this often at most.
MAX_EPOCHS = 2


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to one row per source (source, source_size).

    Weights are dealt to the sources by name, null last, and repeat. `share` times all words are divided by
    weight; no target exceeds `max_epochs` times its source, and what is over goes to the others by weight. That
    is a water level: sources in order of size to weight fill up until the level of the rest is below their own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    level = ((F.lit(float(share)) * F.sum("source_size").over(every) - before(F.col("_cap")))
             / (F.sum("weight").over(every) - before(F.col("weight"))))
    filled = (sizes.withColumn("weight", w).withColumns({"_cap": cap, "_ratio": cap / F.col("weight")})
              .withColumn("_level", level)
              .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source", "_level")))
                          .over(every)))
    water = F.coalesce(F.col("_water._level"), F.lit(float("inf")))
    return filled.withColumn("target", F.least(F.col("_cap"), water * F.col("weight"))).drop("_cap", "_ratio", "_level", "_water")


def mix_plan(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: int = MAX_EPOCHS, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             ranges: int | None = None) -> DataFrame:
    """One row per document: id, source, text_hash, size, source_size, target, taken.

    `size` counts words, 0 for null or blank texts, which take nothing. A null source is a source of its own.
    `taken` is the number of words used, repeats included: whole passes times the size, plus what the last pass
    takes, which for one document a source may be a part of it. The order is by hash of seed, id and text, so
    reruns agree; rows with equal ids and texts are interchangeable. Other columns are not read. An empty table
    gives no rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col)).cast("binary"))
    key = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")  # 60 bits
    rows = pin(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"),
                           F.xxhash64(F.col(text_col)).alias("text_hash"), key.alias("key")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = pin(source_targets(sizes, weights, share, max_epochs)
                  .withColumn("_all", F.sum("_rows").over(Window.partitionBy())), "targets")
    ranges = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = F.ceil(F.col("_rows") * ranges / F.col("_all"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    place = F.floor(F.col("key") / F.lit(float(1 << 60)) * slices)
    dealt = (rows.alias("r").join(targets.alias("t"), same("r", "t"))
             .select("r.*", "source_size", "target", place.alias("slice")))
    within = Window.partitionBy("source", "slice").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("source", "slice").agg(F.sum("size").alias("total"))
               .select("source", "slice", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset")))
    local = dealt.withColumn("upto", F.sum("size").over(within))
    joined = local.alias("l").join(offsets.alias("o"), same("l", "o") & (F.col("l.slice") == F.col("o.slice")))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - start))
    return joined.select(F.col("_id").alias(id_col), F.col("l.source").alias("source"), "text_hash", "size", "source_size",
                         "target", (passes * F.col("size") + last).cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), F.lit(1), n), "")


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **options) -> DataFrame:
    """`docs` as the mix has them: a row per pass, the last one of a source cut at its budget.

    Column `n_chars`, where there is one, follows the text. Documents that take no words are absent. Other columns stay, whatever
    their names.
    """
    k = ["_k_id", "_k_text", "_k_source"]
    plan = (mix_plan(docs, weights, share, id_col=id_col, text_col=text_col, source_col=source_col, **options)
            .groupBy(F.struct(id_col).alias("_k_id"), F.col("text_hash").alias("_k_text"), F.struct("source").alias("_k_source"))
            .agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_same")))
    keyed = docs.select(F.struct(id_col).alias("_k_id"), F.xxhash64(text_col).alias("_k_text"), F.struct(source_col).alias("_k_source"),
                        whole_row(docs))
    nth = Window.partitionBy(*k).orderBy(F.lit(1))
    rows = keyed.join(plan.where("_taken > 0"), k)
    # Of rows that repeat each other the first ones are served first.
    number = F.when(F.col("_same") > 1, F.row_number().over(nth)).otherwise(F.lit(1))
    most = F.ceil(F.col("_taken") / (F.col("_size") * F.col("_same"))) * F.col("_size")
    mine = F.least(most, F.greatest(F.lit(0), F.col("_taken") - (F.col("_n") - 1) * most))
    rows = rows.withColumn("_n", number).withColumn("_mine", mine).where("_mine > 0")
    passes = F.sequence(F.lit(1), F.ceil(F.col("_mine") / F.col("_size")))
    rows = rows.withColumn("_pass", F.explode(passes))
    left = F.least(F.col("_size"), F.col("_mine") - (F.col("_pass") - 1) * F.col("_size"))
    text = F.col("_row").getField(text_col)
    rows = rows.withColumn("_text", F.when(left < F.col("_size"), first_words(text, left.cast("int"))).otherwise(text))
    replaced = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length("_text").cast("bigint")
    return rows.select(*row_columns(docs, replaced))
