"""Toxicity of texts after noisy-channel deobfuscation.

Writers hide words by look-alike signs (1d10t), spacing (i d i o t) and repetition (idiooot). An odd token is read
as a lattice: every run of a sign may stand for letters, for nothing or for a word break, at a cost. Viterbi decoding under a
character trigram model finds the likeliest reading. The trigrams are counted over all texts. A token of plain letters has
one reading only and needs no decoding.

The restored words are scored by a logistic regression over words and their beginnings. It is fitted on a bounded, hash-chosen
sample of the labelled rows; all else covers every row and whole texts. Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows the classifier is fitted on, about; all of them where there are fewer.
SAMPLE_ROWS = 4000
#: Features that are kept, and the least likelihood ratio (G squared) of one.
FEATURES, LEAST_G2 = 2000, 12.0
#: Tokens a worker remembers; a full memory is emptied.
CACHE = 300_000

#: Letters a sign may stand for.
LOOKALIKES = {"4": "a", "@": "a", "8": "b", "(": "c", "<": "c", "3": "e", "€": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il",
              "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "abcdefghijklmnopqrstuvwxyz"}
BREAK, OTHER, SYMBOLS = 0, 27, 28

PLAIN = re.compile(r"[^\W\d_]+")
EDGE = ".,;:?!\"'()[]{}«»“”„’‘…-"
DECORATION = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Four or more single letters or signs in a row, one separator between them.
SPACED = re.compile(r"(?<![^\s.,;:!?])[^\W_](?:[ ._*-][^\s._*-]){3,}(?![^\s.,;:!?])")


def symbol(c: str) -> int:
    """0 for a word break, 1 to 26 for a to z, 27 for any other letter."""
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else BREAK


# --- the language model -------------------------------------------------------------------------------------------------

def symbols_of(text: str) -> np.ndarray:
    """The symbols of a lower-cased text, with one break for every run of other characters and one at either end."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), "<u4")
    s = _SYMBOLS[np.minimum(codes, len(_SYMBOLS) - 1)]
    return s[np.concatenate(([True], (s[1:] != BREAK) | (s[:-1] != BREAK)))]


_SYMBOLS = np.array([symbol(chr(c)) for c in range(0x250)] + [OTHER], "int64")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts: 28 x 28 x 28 numbers, whatever the corpus is."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS ** 3, "int64")
        for batch in batches:
            for t in batch["_text"]:
                s = symbols_of(t)
                s = np.concatenate(([BREAK], s))
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"g": at, "n": total[at]})

    rows = (docs.select(F.col(text_col).alias("_text")).where("_text IS NOT NULL").mapInPandas(count, "g bigint, n bigint")
            .groupBy("g").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(SYMBOLS ** 3)
    for r in rows:
        counts[r["g"]] = r["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Minus log probability of a symbol after two others; a context's counts are filled up by the shorter context's."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 20 * two[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log(three)


# --- the channel --------------------------------------------------------------------------------------------------------

def readings(sign: str, run: int, edge: bool, single: bool) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with costs; a blank is a word break. single: it stands between single letters.

    Reading a sign as nothing saves what the model asks for a letter, so it costs more than reading it as one.
    """
    if sign.isalpha():
        once, twice = (sign, 0.0 if run == 1 else 8.0 if run == 2 else 0.5), (sign * 2, 0.0 if run == 2 else 0.7)
        return [once] if run == 1 else [once, twice]
    letters = LOOKALIKES.get(sign, "")
    out = [(letter * n, (3.0 if sign == "*" else 1.0) + 0.5 * (n != min(run, 2))) for letter in letters for n in range(1, min(run, 2) + 1)]
    if sign.isdigit():
        return [*out, ("", 5.0 if edge else 9.0)]
    if edge:
        return [*out, ("", 1.0 if not letters else 3.0)]
    return [*out, ("", 0.0 if single else 6.0 if letters else 4.0), (" ", 3.0 if single else 1.0)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
    # How many letters or digits stand together before and behind each run.
    size, before, behind = len(runs), [0] * (len(runs) + 1), [0] * (len(runs) + 1)
    for i in range(size):
        before[i + 1] = before[i] + runs[i][1] if runs[i][0].isalnum() else 0
        j = size - 1 - i
        behind[j] = behind[j + 1] + runs[j][1] if runs[j][0].isalnum() else 0
    return [readings(c, n, i in (0, size - 1), before[i] == 1 == behind[i + 1]) for i, (c, n) in enumerate(runs)]


def decode(token: str, costs: np.ndarray) -> str:
    """The likeliest reading of a lower-cased token; words are parted by blanks."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(BREAK, BREAK): (0.0, None)}  # chains of (letters, rest)
    for options in [*lattice(token), [(" ", 0.0)]]:
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, chain) in best.items():
            for letters, own in options:
                x, y, c = a, b, cost + own
                for letter in letters:
                    s = symbol(letter)
                    if s == BREAK and y == BREAK:
                        continue
                    c += costs[x, y, s]
                    x, y = y, s
                if (x, y) not in reached or c < reached[x, y][0]:
                    reached[x, y] = (c, (letters, chain) if letters else chain)
        best = reached
    _, chain = min(best.values(), key=lambda v: v[0])
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out)).strip()


class Reader:
    """Restored words of tokens and texts."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs

    def words(self, token: str) -> list[str]:
        """Of a lower-cased token without white space."""
        core = DECORATION.sub("", DECORATION.sub("", token).strip(EDGE)).strip(EDGE)
        if PLAIN.fullmatch(core) and not TRIPLE.search(core):
            return [core]
        if not any(c.isalpha() for c in core):
            return []
        return decode(core, self.costs).split()

    def spaced(self, text: str) -> list[str]:
        """Of the stretches of single letters in a lower-cased text."""
        return [w for m in SPACED.finditer(text) for w in decode(m.group(), self.costs).split()]

    def restore(self, text: str) -> str:
        """The text lower-cased, with spaced letters and odd tokens replaced by their readings."""
        joined = SPACED.sub(lambda m: decode(m.group(), self.costs), text.lower())
        return " ".join(w for t in joined.split() for w in self.words(t))


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings of 4 to 6 letters."""
    own = {"w" + word} | {"p" + word[:n] for n in (4, 5, 6) if len(word) > n}
    return [zlib.crc32(f.encode()) for f in own]


class Extractor:
    """Features of texts; `wanted` are the only ones that matter, if given, and they are then numbered as there."""

    def __init__(self, costs: np.ndarray, wanted: dict[int, int] | None = None):
        self.reader, self.wanted = Reader(costs), wanted
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_words(self, words: list[str]) -> tuple[int, ...]:
        found = {f for w in words for f in word_features(w)}
        return tuple(found if self.wanted is None else (self.wanted[f] for f in found if f in self.wanted))

    def features(self, text: str) -> set[int]:
        low, out = text.lower(), set()
        for token in set(low.split()):
            own = self.cache.get(token)
            if own is None:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                own = self.cache[token] = self.of_words(self.reader.words(token))
            if own:
                out.update(own)
        out.update(self.of_words(self.reader.spaced(low)))
        return out


# --- the classifier -----------------------------------------------------------------------------------------------------

def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of about `rows` labelled documents outside the held-out part, chosen by a hash of the id."""
    learn = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    share = min(1.0, rows / max(learn.count(), 1))
    chosen = (learn.where(F.shiftrightunsigned(F.xxhash64(id_col), 11) < int(share * (1 << 53)))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy("_id").limit(2 * rows))
    # At most 2 * rows rows of two numbers: small by construction.
    text = F.coalesce(text_col, F.lit(""))
    return (docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")
            .groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")))


def fit(features: list[np.ndarray], labels: np.ndarray, steps: int = 600) -> tuple[dict[int, float], float]:
    """(weights by feature, bias) of a regularised logistic regression on the features that tell the labels apart best."""
    n, pos = len(labels), labels.sum()
    bias = math.log((pos + 0.5) / (n - pos + 0.5))
    if not pos or pos == n:
        return {}, bias
    flat = np.concatenate(features)
    row = np.repeat(np.arange(n), [len(f) for f in features])
    names, column = np.unique(flat, return_inverse=True)
    a = np.bincount(column, labels[row], len(names))
    b = np.bincount(column, minlength=len(names)) - a

    def part(k: np.ndarray, total: float, both: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) * n / (total * np.maximum(both, 1e-9))), 0)

    g2 = 2 * (part(a, pos, a + b) + part(b, n - pos, a + b) + part(pos - a, pos, n - a - b) + part(n - pos - b, n - pos, n - a - b))
    best = np.argsort(-g2, kind="stable")[:FEATURES]
    best = best[g2[best] >= LEAST_G2]
    if not len(best):
        return {}, bias
    number = np.full(len(names), -1)
    number[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), "f4")
    kept = number[column] >= 0
    x[row[kept], number[column[kept]]] = 1
    w, y = np.zeros(len(best)), labels.astype("f8")
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        e = (p - y) / n
        gw, gb = x.T @ e + 4e-5 * w, e.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.99 * v_w + 0.01 * gw * gw
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.99 * v_b + 0.01 * gb * gb
        scale = 0.1 * math.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        w -= scale * m_w / (np.sqrt(v_w) + 1e-9)
        bias -= scale * m_b / (math.sqrt(v_b) + 1e-9)
    return dict(zip(names[best].tolist(), w.tolist())), float(bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from a score of 0.5 on), replaced if there.

    Labels are learnt only from rows with an id whose crc32 mod 5 is not 0; contradicting labels of an id count as 1. A null or empty
    text is scored as one without words. With labels of one kind only, or none, every text has the same score. Repeated rows
    are scored alike, and an empty table gives no rows.
    """
    costs = costs_of(trigram_counts(docs, text_col))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = Extractor(costs)
        for batch in batches:
            found = [np.array(sorted(extractor.features(t)), "<u4").tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"].astype(str), "features": found, "label": batch["_label"].astype("int64")})

    rows = (sample_of(docs, labels, sample_rows, id_col, text_col, label_col)
            .mapInPandas(extract, "_id string, features binary, label bigint").toPandas().sort_values("_id"))
    weights, bias = fit([np.frombuffer(f, "<u4") for f in rows["features"]], rows["label"].to_numpy()) if len(rows) else ({}, -5.0)
    wanted = {f: i for i, f in enumerate(weights)}
    values = np.array(list(weights.values()))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(costs, wanted)
        for batch in texts:
            sums = np.array([bias + sum(values[i] for i in sorted(extractor.features(t))) for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return (docs.withColumn("score", score(F.coalesce(text_col, F.lit(""))))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, columns as they are."""
    columns = docs.columns
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    renamed = labels.withColumnRenamed(id_col, "_id")
    return score_toxicity(named, renamed, "_id", "_text", **options).where("predicted = 0").select("_row.*")
