"""Quality of texts by attention-based multiple-instance learning.

A label belongs to a whole document; which of its passages earn it is not known. Every passage of PASSAGE words is encoded by
the signs it is made of, how its words are built and repeat, and hashes of its words. A hidden layer turns that into a vector; gated
attention, tanh times sigmoid, weighs the passages of a document; their weighted sum is scored. All of it is learnt together from the
labels of a bounded sample of documents. Every passage of every text is scored, and a document's weights add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords

#: Labelled documents the model is fitted on, about, and the most passages of one of them, both chosen by hash.
SAMPLE_ROWS, SAMPLE_PASSAGES = 4000, 16
#: Words of a passage, slots for hashes of its words.
PASSAGE, SLOTS = 100, 256
#: Width of the passage vector and of the gates.
WIDTH, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.004, 1e-4

NOT_SPACE = ~bytewords.byte_set(" \t\n\x0b\x0c\r")
#: Kinds of bytes whose shares describe a passage.
KINDS = [bytewords.byte_set(s) for s in (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r", ".", ",", "!", "?;:", "'\"()-",
    "#", "$", "%", "&", "*", "+<=>^~`", "@/\\", "[]{}", "|", "_")] + [np.arange(256) >= 128, np.arange(256) < 9]
#: Of each byte its kind, the last where it has none.
KIND = np.argmax(np.stack([*KINDS, np.ones(256, bool)]), axis=0)
KIND[KIND == len(KINDS)] = len(KINDS) - 1
UPPER, LETTER, SIGN = KINDS[1], KINDS[0] | KINDS[1] | KINDS[20], ~(KINDS[0] | KINDS[1] | KINDS[2] | KINDS[20])
FEATURES = len(KINDS) + 11 + SLOTS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, its text's row). A text without words has one passage, its features all zero but for the signs."""
    s = bytewords.spans(texts, NOT_SPACE)
    codes, names = bytewords.encoded(s)
    doc = np.searchsorted(s.texts, s.starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n_parts = np.maximum(1, -(-n_words // PASSAGE))
    first_part, first_word = np.cumsum(n_parts) - n_parts, np.cumsum(n_words) - n_words
    part = first_part[doc] + (np.arange(len(doc)) - first_word[doc]) // PASSAGE
    total, owner = int(n_parts.sum()), np.repeat(np.arange(len(texts)), n_parts)
    # A passage's bytes go from its first word, or the beginning of its text, to the next passage.
    nth = np.arange(total) - first_part[owner]
    begin = np.where(nth == 0, s.texts[owner], 0)
    begin[nth > 0] = s.starts[first_word[owner][nth > 0] + nth[nth > 0] * PASSAGE]
    bounds = np.append(begin, len(s.data))

    size = np.diff(bounds)
    x = np.zeros((total, FEATURES), "f4")
    kinds = np.bincount(np.repeat(np.arange(total), size) * len(KINDS) + KIND[s.data], minlength=total * len(KINDS))
    x[:, :len(KINDS)] = kinds.reshape(total, len(KINDS)) / np.maximum(size, 1)[:, None]
    per = lambda weights: np.bincount(part, weights, total)

    def within(chosen: np.ndarray) -> np.ndarray:
        """Of each word, how many of its bytes are chosen."""
        before = np.concatenate(([0], np.cumsum(chosen[s.data], dtype="i4")))
        return before[s.ends] - before[s.starts]

    if len(doc):
        words = np.maximum(per(None), 1)
        length = (s.ends - s.starts).astype("f8")
        upper, letters, signs = within(UPPER), within(LETTER), within(SIGN)
        mean = per(length) / words
        again = np.concatenate(([False], (codes[1:] == codes[:-1]) & (part[1:] == part[:-1])))
        pairs, times = np.unique(part * max(len(names), 1) + codes, return_counts=True)
        most = np.zeros(total)
        np.maximum.at(most, pairs // len(names), times)
        own = [mean / 10, np.sqrt(np.maximum(per(length ** 2) / words - mean ** 2, 0)) / 10, per(UPPER[s.data[s.starts]]) / words,
               per((upper == letters) & (letters > 1)) / words, per(SIGN[s.data[s.ends - 1]]) / words, per(signs > 1) / words,
               per(letters == 0) / words, per(again) / words, np.bincount(pairs // len(names), minlength=total) / words, most / words,
               np.log1p(per(None)) / 5]
        x[:, len(KINDS):len(KINDS) + 11] = np.stack(own, axis=1)
        slot = (bytewords.hashes(names) % np.uint64(SLOTS)).astype("i8")
        x[:, len(KINDS) + 11:] = np.sqrt(np.bincount(part * SLOTS + slot[codes], minlength=total * SLOTS).reshape(total, SLOTS) / words[:, None])
    return x, owner


class Model:
    """Passage encoder, gated attention and score."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        wide = lambda a, b: rng.normal(0, a ** -0.5, (a, b)).astype("f4")
        self.mean, self.scale = np.zeros(FEATURES, "f4"), np.ones(FEATURES, "f4")
        self.w = {"encode": wide(FEATURES, WIDTH), "shift": np.zeros(WIDTH, "f4"), "tanh": wide(WIDTH, GATES), "gate": wide(WIDTH, GATES),
                  "attend": wide(GATES, 1)[:, 0], "out": wide(WIDTH, 1)[:, 0], "bias": np.zeros(1, "f4")}

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages, document after document; sizes: how many each document has, one at least."""
        w, begin = self.w, np.cumsum(sizes) - sizes
        h = np.tanh(x @ w["encode"] + w["shift"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
        a /= np.repeat(np.add.reduceat(a, begin), sizes)
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["bias"], -30, 30)))}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, with a little decay of the matrices."""
        w, f, begin = self.w, self.forward(x, sizes), np.cumsum(sizes) - sizes
        d_o = (f["p"] - y) / len(y)
        d_z = np.repeat(d_o[:, None] * w["out"], sizes, axis=0)
        d_a = (d_z * f["h"]).sum(axis=1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, begin), sizes))
        d_tg = d_e[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_x = d_h * (1 - f["h"] ** 2)
        grads = {"encode": x.T @ d_x, "shift": d_x.sum(axis=0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
                 "attend": (f["t"] * f["g"]).T @ d_e, "out": f["z"].T @ d_o, "bias": np.array([d_o.sum()])}
        return {k: v + DECAY * w[k] if k in ("encode", "tanh", "gate", "out") else v for k, v in grads.items()}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int = 2) -> "Model":
        """Adam over batches of documents, the step falling to nothing. With one kind of label only, or none, all scores are that kind's share."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.w["bias"][:] = np.log(share / (1 - share))
        if not len(y) or y.min() == y.max():
            self.w["out"][:] = 0
            return self
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        x = (x - self.mean) * self.scale
        begin, rng = np.cumsum(sizes) - sizes, np.random.default_rng(seed)
        m, v = ({k: np.zeros(a.shape, "f4") for k, a in self.w.items()} for _ in range(2))
        steps, step = EPOCHS * -(-len(y) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                docs = order[i:i + BATCH]
                rows = np.concatenate([np.arange(begin[d], begin[d] + sizes[d]) for d in docs])
                step += 1
                for k, grad in self.gradients(x[rows], sizes[docs], y[docs]).items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad ** 2
                    fall = RATE * (1 - step / steps)
                    self.w[k] -= (fall * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype("f4")
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        x, owner = passages(texts)
        return self.forward((x - self.mean) * self.scale, np.bincount(owner, minlength=len(texts)))["p"].astype("f8")


def held_out(id_column: Column) -> Column:
    """Rows whose labels are not learnt from; a null id is none of them, but has no label either."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_passages(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> pd.DataFrame:
    """(id, label, n, features) of about `rows` labelled documents outside the held-out part, chosen by a hash of the id."""
    learn = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    share = min(1.0, rows / max(learn.count(), 1))
    chosen = (learn.where(F.shiftrightunsigned(F.xxhash64(id_col), 11) < int(share * (1 << 53)))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy("_id").limit(2 * rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in bytewords.chunks(batch, 2):
                x, owner = passages(chunk.column(2))
                parts = [np.flatnonzero(owner == i) for i in range(len(chunk))]
                # A long document lends SAMPLE_PASSAGES passages, in an order that depends on their number only.
                parts = [np.sort(p[np.argsort(bytewords.mixed(np.arange(len(p)), 7), kind="stable")[:SAMPLE_PASSAGES]]) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    chunk.column(0).cast(pa.string()), chunk.column(1).cast(pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([x[p].tobytes() for p in parts], pa.binary())], names=["id", "label", "n", "features"])

    # At most 2 * rows rows of two numbers are sent to the tasks, and at most SAMPLE_PASSAGES passages of each come back.
    return (docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
            .groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
            .mapInArrow(extract, "id string, label bigint, n bigint, features binary").toPandas().sort_values("id", ignore_index=True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = sample_passages(docs, labels, sample_rows, id_col, text_col, label_col)
    x = np.frombuffer(b"".join(rows["features"]), "f4").reshape(-1, FEATURES)
    return Model().fit(x, rows["n"].to_numpy("i8"), rows["label"].to_numpy("f8"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from a score of 0.5 on), replaced if there.

    Labels are learnt only from rows with an id whose crc32 mod 3 is not 1; contradicting labels of an id count as 1. A null or empty
    text is scored as one passage without words. With labels of one kind only, or none, every text has the same score. Repeated rows
    are scored alike, and an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [model.scores(c.column(0)) for c in bytewords.chunks(pa.RecordBatch.from_arrays([batch], names=["t"]), 0)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return (docs.withColumn("score", score(F.coalesce(text_col, F.lit(""))))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
