"""Substring dedup by sliding spans of consecutive sentences.

A text is cut into sentences, and each sentence again at marks of its own content, so that a passage is cut alike
wherever it stands and however long its neighbours' sentences are. From every such piece on, the shortest run of at
least `sentences` pieces and `words` words is hashed (95 bits, letters and digits only, lower-cased). Runs are joined
over all documents: the first occurrence of a run, by document and place, stays, and pieces that any later occurrence
covers are removed. n_sentences and n_removed count the pieces.

Occurrences that follow another one in the same batch of documents are known to be repeats before anything moves; only
the first of a batch takes part in the global comparison, so a passage that stands in very many documents is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_columns, whole_row

SENTENCES, WORDS = 3, 20
#: Up to a sentence's end before white space, or a line's end.
SENTENCE = re.compile(r"""[^.!?。！？\n]*(?:[.!?。！？]+(?:["')\]”’]*(?:\s+|\Z)|(?=\S))|\n\s*|\Z)""")
#: Letters of scripts that put no spaces between words; each counts as a word.
CLOSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
LETTERS = re.compile(rf"[{CLOSE}]|[^\W_{CLOSE}]+")
ASCII_LETTERS = re.compile("[a-z0-9]+")


def half(seed: int, close: bool) -> str:
    """A fixed half of the letters beyond a-z in either case, of scripts without spaces or of the others."""
    own = re.compile(f"[{CLOSE}]")
    return "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and bool(own.match(c)) == close
                   and len(low := c.lower()) == 1 and not low.isascii() and (ord(low) * 0x9E3779B1 + seed * 0x85EBCA6B) >> 15 & 1)


#: Every sentence is cut after words with certain two letters at their end, their white space and up to three other signs
#: between; without spaces, after certain two letters. What is cut depends on nothing but those few characters.
ENDS = [(f"[aeiouAEIOU{half(1, False)}]", f"[lnrtLNRT{half(2, False)}]"), ("[cdklmnrstvCDKLMNRSTV]", "[desyDESY]")]
MARK = re.compile("|".join([rf"{a}{b}[^\w\s]{{0,3}}\s" for a, b in ENDS] + [f"[{half(3, True)}](?=([{half(4, True)}]))"]))
ASCII_MARK = re.compile(r"(?:[aeiouAEIOU][lnrtLNRT]|[cdklmnrstvCDKLMNRSTV][desyDESY])[^\w\s]{0,3}\s", re.ASCII)
#: Where there is no mark this far on either side, the least hash of NEAR characters within that distance is one.
REACH, NEAR = 200, 8
#: Runs that are handed on at a time.
SLICE = 500_000
#: Factors of the hashes of a run's words, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(x, -1, 1 << 64) for x in BASES)


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0 .. n - 1, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n - 1, base, "u8")]))


#: Those that all but very long texts need.
POWERS = {base: powers(base, 1 << 14) for base in BASES + INVERSES}


def least_marks(part: str) -> list[int]:
    """Where a part without marks is cut: after characters whose hash is the only least one within REACH of them."""
    n = len(part)
    if n <= 2 * REACH:
        return []
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    h = np.zeros(n + 1, "u8")  # of the characters before each place
    for k in range(NEAR):
        h[k + 1:] = h[k + 1:] * np.uint64(BASES[0]) + codes[:n - k] * np.uint64(BASES[1])
    h = (h * np.uint64(BASES[1])) ^ (h >> np.uint64(29))
    least, width = h, 1  # the least of `width` places from each on
    while width < REACH:
        step = min(width, REACH - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.arange(REACH, n - REACH + 1)
    return at[(h[at] < least[at - REACH]) & (h[at] < least[at + 1])].tolist() if len(at) else []


def cut_sentences(text: str) -> list[str]:
    """The sentences with their white space; together they are the text."""
    out: list[str] = []
    open_ = ""
    for m in SENTENCE.finditer(text):
        piece = open_ + m.group()
        if not piece:
            continue
        # A full stop inside a number or a name ends nothing.
        if piece[-1] in ".!?。！？" and m.end() < len(text) and piece[-1] not in "。！？":
            open_ = piece
            continue
        open_ = ""
        if piece.isascii():
            stops = [x.end() for x in ASCII_MARK.finditer(piece)]
        else:
            stops = [x.end(1) if x.lastindex else x.end() for x in MARK.finditer(piece)]
        while stops and not piece[stops[-1]:].strip():  # white space goes with what is before it
            stops.pop()
        at = 0
        for stop in [*stops, len(piece)]:
            if stop - at > 2 * REACH:
                places = [0, *least_marks(piece[at:stop]), stop - at]
                out += [piece[at + i:at + j] for i, j in zip(places, places[1:])]
            else:
                out.append(piece[at:stop])
            at = stop
    if open_:
        out.append(open_)
    return out


class Worded(NamedTuple):
    words: list[list[str]]  # of each sentence, lower-cased
    own: np.ndarray         # the sentences that have words
    upto: np.ndarray        # words before each of those, and of all
    end: np.ndarray         # for each that begins a run, its number among them: the one after the last


def worded(sentences: list[str], least: int, words: int) -> Worded:
    """The shortest run from every sentence on; sentences without words are passed over."""
    found = [(ASCII_LETTERS if s.isascii() else LETTERS).findall(s.lower()) for s in sentences]
    counts = np.fromiter(map(len, found), "int64", len(found))
    own = np.flatnonzero(counts)
    upto = np.concatenate([[0], np.cumsum(counts[own])])
    end = np.maximum(np.arange(len(own)) + least, np.searchsorted(upto, upto[:-1] + words))
    return Worded(found, own, upto, end[end <= len(own)])  # ends never fall, so those are the first ones


def spans_of(sentences: list[str], least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and sentence after the last of every run."""
    _, own, _, end = worded(sentences, least, words)
    return own[:len(end)], own[end - 1] + 1


def runs(text: str, least: int, words: int) -> np.ndarray:
    """First sentence, 64 bits and 31 more of the hash of every run, in three columns."""
    found, own, upto, end = worded(cut_sentences(text), least, words)
    out = np.zeros((len(end), 3), "int64")
    out[:, 0] = own[:len(end)]
    if len(end):
        marks = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), "u8", int(upto[-1]))
        first, last = upto[:len(end)], upto[end]
        for k in range(2):
            base, back = (POWERS[x] if len(marks) <= len(POWERS[x]) else powers(x, len(marks)) for x in (BASES[k], INVERSES[k]))
            # A polynomial of the words' hashes: what a run adds to the sum before it, divided by the power that it starts with.
            total = np.concatenate([np.zeros(1, "u8"), np.cumsum(marks * base[:len(marks)])])
            h = (total[last] - total[first]) * back[first]
            out[:, 1 + k] = ((h ^ (h >> np.uint64(31))) * np.uint64(BASES[1 - k]) >> np.uint64(33 * k)).view("i8")
    return out


def without(text: str, starts: set[int], least: int, words: int) -> tuple[str, int, int]:
    """The text without the runs that begin at `starts`; how many sentences it had and has lost."""
    own = cut_sentences(text)
    if not starts:
        return text, len(own), 0
    gone = np.zeros(len(own) + 1, "int64")
    for a, b in zip(*[x.tolist() for x in spans_of(own, least, words)]):
        if a in starts:
            gone[a] += 1
            gone[b] -= 1
    lost = np.cumsum(gone)[:len(own)] > 0
    return "".join(s for s, x in zip(own, lost) if not x), len(own), int(lost.sum())


def places(batch: pa.RecordBatch) -> pa.Table:
    """The documents of a batch in the order of their ids (null first) and marks, each one once."""
    table = pa.Table.from_batches([batch])
    table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("mark", "ascending")], null_placement="at_start"))
    ids = table["_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    mark = table["mark"].to_numpy()
    return table.filter(pa.array((np.diff(ids, prepend=-2) != 0) | (np.diff(mark, prepend=~mark[:1]) != 0)))


def span_table(docs: DataFrame, sentences: int, words: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """bucket, and in arrays _id, mark, first, a, b of every run of it. Where an earlier run of its batch is equal, b is -1 and
    a is any number. What a run takes is little more than its hash: the arrays go document by document, so ids and marks repeat."""
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(table: pa.Table, which: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        doc, flat = np.repeat(which, [len(f) for f in found]), np.concatenate(found)
        mark, first, a, b = table["mark"].to_numpy()[doc], flat[:, 0], flat[:, 1].copy(), flat[:, 2].copy()
        again = pd.DataFrame({"a": a, "b": b}).duplicated().to_numpy()
        a[again], b[again] = mark[again] + first[again], -1
        bucket = a.view("u8") % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        own = [table["_id"].combine_chunks().take(pa.array(doc[order])), mark[order], first[order].astype("i4"), a[order], b[order].astype("i4")]
        lists = [pa.ListArray.from_arrays(ends, x if isinstance(x, pa.Array) else pa.array(x)) for x in own]
        return pa.RecordBatch.from_arrays([pa.array(names.astype("i4")), *lists], ["bucket", "_id", "mark", "first", "a", "b"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = places(batch)
            which, found, n = [], [], 0
            for k, text in enumerate(table["_text"]):
                own = runs(text.as_py(), sentences, words)
                if len(own):
                    which.append(k)
                    found.append(own)
                    n += len(own)
                if n >= SLICE:
                    yield packed(table, which, found)
                    which, found, n = [], [], 0
            if found:
                yield packed(table, which, found)

    return (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("_text"))
            .where("_text IS NOT NULL")
            .mapInArrow(find, f"bucket int, _id array<{kind}>, mark array<bigint>, first array<int>, a array<bigint>, b array<int>"))


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(_id, mark, first): where the runs begin that have occurred before; mark is a hash of the document's text.

    Null texts and texts without a whole run have none, nor has an empty table; a null id is the first of all.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (span_table(docs, sentences, words, buckets, id_col, text_col).repartitionById(buckets, "bucket")
            .select("bucket", F.inline(F.arrays_zip("_id", "mark", "first", "a", "b")))
            .select("bucket", "a", "b", F.struct("_id", "mark", "first").alias("place")))
    # Equal runs lie in one bucket, so nothing is dealt out again; a comes first, by which Spark sorts quickest.
    origin = F.min("place").over(Window.partitionBy("a", "b", "bucket"))
    return rows.withColumn("origin", origin).where("b < 0 OR place <> origin").select("place.*")


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """`docs` with repeated sentences taken out of the texts, and n_sentences and n_removed (replaced if there).

    The first occurrence is the one with the smallest id (null first), then by a hash of its text and by place; within a document
    too only the first stays. A null text stays null with counts of 0; a text wholly repeated becomes empty. Rows that
    repeat both id and text are one document and have the same result. All rows stay, and other columns, whatever their names.
    """
    spans = (repeated_spans(docs, sentences, words, id_col, text_col)
             .groupBy(F.struct(F.col("_id").alias("id")).alias("_k_id"), F.col("mark").alias("_k_mark"))
             .agg(F.collect_set("first").alias("_spans")))

    @F.pandas_udf("text string, total int, lost int")
    def clean(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None else without(t, set(() if f is None else f), sentences, words)
                for t, f in zip(texts, found)]
        return pd.DataFrame(rows, columns=["text", "total", "lost"])

    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("_k_id"), F.xxhash64(text_col).alias("_k_mark"), whole_row(docs))
    cleaned = rows.join(spans, ["_k_id", "_k_mark"], "left").withColumn("_clean", clean(F.col("_row").getField(text_col), "_spans"))
    return cleaned.select(*row_columns(docs, {
        text_col: F.col("_clean.text"), "n_sentences": F.col("_clean.total"), "n_removed": F.col("_clean.lost")}))
