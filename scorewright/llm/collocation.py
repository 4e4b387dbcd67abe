"""Phrases whose words stand together more often than their counts alone explain.

The stripes pattern: every prefix of a phrase keys an associative counter of the words that follow it. Tasks build stripes over
large pieces of text, send them to their prefix's bucket, and buckets merge them elementwise. The merged stripes hold all that is
asked: the phrases one word longer (their entries), the counts of prefixes (entries of the stripe before), and by
the largest entry that contains a phrase what subsumes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from . import bytewords
from .bytewords import mixed

#: Words of the corpus for each bucket of stripes; also the most occurrences of one prefix that meet in a bucket.
BUCKET_WORDS = 1 << 20
#: Prefixes that may follow a word are dealt out by the next word too if the word has more than this share of all, so there are at most
#: that many such words.
HOT_WORDS = 100_000
#: Parts in which the best phrases of a language are found first.
RANK_PARTS = 64

MARKS = bytewords.byte_set(".,;:!?\n\x0b\x0c\r")
INSIDE = ~(MARKS | bytewords.byte_set(" \t"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of (lang, text): the stripes of the empty prefix."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bytewords.chunks(batch, 1):
                w = bytewords.words(chunk.column(1), INSIDE)
                if not len(w.codes):
                    continue
                lang = chunk.column(0).dictionary_encode()
                size = len(w.names)
                keys, times = np.unique(lang.indices.to_numpy().astype("i8")[w.doc] * size + w.codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    lang.dictionary.take(pa.array(keys // size)).cast(pa.string()),
                    w.names.take(pa.array(keys % size)).cast(pa.string()), pa.array(times)], schema=schema)

    return rows.mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def stripes_of(chunk: pa.RecordBatch, max_words: int, buckets: int, usual: int, hot: dict[tuple[str, str], int]) -> pa.RecordBatch | None:
    """(lang, bucket, stripes) of (lang, text): a line per prefix, its next words with their counts behind it, all parted by tabs.

    No word holds a blank, tab or line end. A prefix is dealt into as many buckets, by its next word, as the rarest of its words asks for:
    `hot` names those words that ask for more than `usual`.
    """
    w = bytewords.words(chunk.column(1), INSIDE, MARKS)
    if not len(w.codes):
        return None
    lang, size = chunk.column(0).dictionary_encode(), len(w.names)
    word_hash, lang_hash = bytewords.hashes(w.names), bytewords.hashes(lang.dictionary)
    asked = np.full(len(lang.dictionary) * size, usual, "i8")
    if hot:
        places = [pc.index_in(pa.array([key[i] for key in hot], names.type), value_set=names).to_numpy(zero_copy_only=False)
                  for i, names in enumerate((lang.dictionary, w.names))]
        for of_lang, of_word, shards in zip(*places, hot.values()):
            if of_lang >= 0 and of_word >= 0:
                asked[int(of_lang) * size + int(of_word)] = shards
    # Whether a word and the next one may stand in the same phrase; one more for the last word.
    linked = np.append((w.doc[:-1] == w.doc[1:]) & (w.mark[:-1] == w.mark[1:]), False)
    at = np.flatnonzero(linked)
    # The phrases of the present length: names, hashes, languages, asked buckets; and which of them starts at each place of `at`.
    grams, gram = np.unique(lang.indices.to_numpy().astype("i8")[w.doc] * size + w.codes, return_inverse=True)
    gram, owner = gram[at], grams // size
    names, key_hash, shards = w.names.take(pa.array(grams % size)), mixed(word_hash[grams % size], lang_hash[owner]), asked[grams]
    blocks = []
    for length in range(1, max_words):
        keys, gram, times = np.unique(gram * size + w.codes[at + length], return_inverse=True, return_counts=True)
        if not len(keys):
            break
        prefix, follow = keys // size, keys % size
        spread = mixed(word_hash[follow], length) % shards[prefix].astype("u8")
        slot = owner[prefix] * buckets + (mixed(key_hash[prefix], spread) % np.uint64(buckets)).astype("i8")
        blocks.append(packed(slot, prefix, names, follow, w.names, times, lang.dictionary, buckets))
        if length + 1 < max_words:
            names = pc.binary_join_element_wise(names.take(pa.array(prefix)), w.names.take(pa.array(follow)), large(" "))
            key_hash, owner = mixed(key_hash[prefix], word_hash[follow]), owner[prefix]
            shards = np.minimum(shards[prefix], asked[owner * size + follow])
            go = linked[at + length]
            at, gram = at[go], gram[go]
    return pa.concat_batches(blocks) if blocks else None


def large(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


def packed(slot: np.ndarray, prefix: np.ndarray, names: pa.Array, follow: np.ndarray, words: pa.Array, times: np.ndarray,
           langs: pa.Array, buckets: int) -> pa.RecordBatch:
    """A row for each slot (language and bucket) of entries that are sorted by prefix and next word."""
    order = np.argsort(slot, kind="stable")
    slot, prefix = slot[order], prefix[order]
    opens = np.concatenate(([True], slot[1:] != slot[:-1]))
    head = opens | np.concatenate(([True], prefix[1:] != prefix[:-1]))
    heads = pc.binary_join_element_wise(large("\n"), names.take(pa.array(prefix, mask=~head)), large("")).fill_null("")
    entries = pc.binary_join_element_wise(heads, large("\t"), words.take(pa.array(follow[order])), large(" "),
                                          pa.array(times[order]).cast(pa.large_string()), large(""))
    begin = np.flatnonzero(opens)
    # The entries lie one behind the other in one buffer: a slot's row is a longer slice of it.
    places = np.frombuffer(entries.buffers()[1], "i8")[entries.offset:entries.offset + len(entries) + 1]
    rows = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places[np.append(begin, len(slot))]), entries.buffers()[2])
    return pa.RecordBatch.from_arrays([langs.take(pa.array(slot[begin] // buckets)).cast(pa.string()), pa.array(slot[begin] % buckets),
                                       rows.cast(pa.string())], names=["lang", "bucket", "stripes"])


def merged(rows: pa.Table, least: int) -> pa.Table:
    """(lang, prefix, next, f) of the entries that occur `least` times or more in the stripes of a bucket, added up by prefix and next word."""
    texts = rows.column("stripes").combine_chunks().cast(pa.large_string())
    lines = pc.split_pattern(texts, "\n")
    of_row = pc.list_parent_indices(lines).to_numpy()
    lines = pc.list_flatten(lines)
    full = pc.not_equal(lines, "")
    of_row, lines = of_row[full.to_numpy(zero_copy_only=False)], lines.filter(full)
    cells = pc.split_pattern(lines, "\t")
    sizes = pc.list_value_length(cells).to_numpy().astype("i8")
    cells = pc.list_flatten(cells)
    heads = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    entry = np.ones(len(cells), bool)
    entry[heads] = False
    line = np.repeat(np.arange(len(sizes)), sizes)[entry]
    pieces = pc.list_flatten(pc.split_pattern(cells.filter(pa.array(entry)), " "))
    even = np.arange(0, len(pieces), 2)
    prefix, follow = cells.take(pa.array(heads)).dictionary_encode(), pieces.take(pa.array(even)).dictionary_encode()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    own = langs.indices.to_numpy()[of_row].astype("i8") * max(len(prefix.dictionary), 1) + prefix.indices.to_numpy()
    size = max(len(follow.dictionary), 1)
    keys, at = np.unique(own[line] * size + follow.indices.to_numpy(), return_inverse=True)
    counts = np.zeros(len(keys), "i8")
    np.add.at(counts, at, pieces.take(pa.array(even + 1)).cast(pa.int64()).to_numpy())
    keys, counts = keys[counts >= least], counts[counts >= least]
    own = keys // size
    return pa.table({"lang": langs.dictionary.take(pa.array(own // max(len(prefix.dictionary), 1))).cast(pa.string()),
                     "prefix": prefix.dictionary.take(pa.array(own % max(len(prefix.dictionary), 1))).cast(pa.string()),
                     "next": follow.dictionary.take(pa.array(keys % size)).cast(pa.string()), "f": pa.array(counts)})


def phrase_counts(rows: DataFrame, words: DataFrame, max_words: int, least: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of 2 to `max_words` words that occur `least` times or more in (lang, text).

    words: the (lang, word, f) of the same rows. There is a bucket for every BUCKET_WORDS words. A prefix has at most the
    occurrences of its rarest word; if these are more than BUCKET_WORDS it is dealt out by its next word. Such words are named
    to the tasks where they have more than 1 of HOT_WORDS of all words, so at most HOT_WORDS are, however large the corpus is;
    all others have at most that share, and are dealt into as many buckets as it asks for.
    """
    total = words.agg(F.sum("f")).first()[0] or 0
    buckets, usual = 1 + total // BUCKET_WORDS, 1 + total // HOT_WORDS // BUCKET_WORDS
    hot = {(r["lang"], r["word"]): 1 + r["f"] // BUCKET_WORDS
           for r in words.where(F.col("f") > max(BUCKET_WORDS, total // HOT_WORDS)).collect()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bytewords.chunks(batch, 1):
                found = stripes_of(chunk, max_words, buckets, usual, hot)
                if found is not None:
                    yield found

    return (rows.mapInArrow(build, "lang string, bucket bigint, stripes string")
            .groupBy("bucket").applyInArrow(lambda t: merged(t, least), "lang string, prefix string, next string, f bigint")
            .select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "f"))


def first_words(words: Column, k: int | Column) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, least: int = 10,
                      subsumed_percent: int = 50, top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Texts are lower-cased in A-Z, cut at . , ; : ! ? and line ends, and into words at blanks and tabs. A phrase of 2 to `max_words` words of
    a piece with a >= `least` occurrences in its language is a candidate. Cutting it after k words gives l and r, the counts of
    both parts, and floor(scale * a * a / (l * r)); its score is that of the lowest cut, of equal ones the first. Of a
    candidate inside a longer one nothing is returned if that has `subsumed_percent` of its occurrences. n counts all words of
    the language. Scores fall; ties go by falling a, then by the phrase's UTF-8 bytes. All is exact.

    A null text is empty, a null language `und`; texts without words count for nothing. Repeated rows count as often as they
    stand there. An empty table, or one without candidates, gives no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = pin(word_counts(rows), "words")
    found = pin(phrase_counts(rows, words, max_words, least), "phrases")
    counts = found.unionAll(words.where(F.col("f") >= least))  # of all phrases of one word or more
    long = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # One row for every cut; both parts of a candidate occur at least as often as it does, so their counts are there.
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = (long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
            .select("lang", "phrase", "a", "k", first_words(F.col("w"), F.col("k")).alias("first"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
            .join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]))
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.call_function("div", F.lit(scale).cast("decimal(9,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("_m")).select("lang", "phrase", "a", "_m.score", "_m.l", "_m.r"))

    # Of each phrase inside a candidate, the most that any such candidate has.
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    around = (long.where(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = (scored.join(around, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(subsumed_percent) * F.col("a"))))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = (kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
