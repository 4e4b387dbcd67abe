"""Phrase collocations, source divergence and quality, held against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewright.llm import bytewords, collocation, divergence, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=120, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    stock = ["the", "The", "of", "cat", "Äpfel", "äpfel", "日本", "x1", "a-b", "New", "york", "city", "\x0e"]
    ends = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! ", " "]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(stock) + rng.choices(ends, [12, 1, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice([t, t, t, t + "new York City " * 3]), rng.choice(langs), rng.choice(["a", "a", "b", None, "ü"])))
    rows += [(1000, None, "en", "c"), (1001, "", "fr", "only"), (1002, " \t\n", None, None), (1003, "the of " * 500, "en", "a"), rows[3], rows[3]]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("term", "n", "phrase", "f", "rank", "value", "part", "word", "_part", "a.b", "score", "first")})
    return df


# --- words of bytes -----------------------------------------------------------------------------------------------------

def test_words_of_bytes_are_those_of_a_pattern():
    texts = ["", None, "a b", " b", "B ", "ä,Ö c", "日本 日本", "x" * 100, "\n", "a\nb"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for size in (1, 5, 1 << 20):
        got = []
        for chunk in bytewords.chunks(batch.slice(0), 0, size):
            w = bytewords.words(chunk.column(0), collocation.INSIDE)
            names = w.names.to_pylist()
            got += [[names[c] for c, d in zip(w.codes, w.doc) if d == i] for i in range(len(chunk))]
        assert got == [re.findall(r"[^ \t.,;:!?\n-\r]+", (t or "").translate(LOWER)) for t in texts]
    assert list(bytewords.chunks(batch.slice(0, 0), 0)) == []


# --- collocations -------------------------------------------------------------------------------------------------------

def plain_collocations(rows, max_words, least, percent, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        around = [b for (o, q), b in found.items() if o == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in around):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang, rows_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])}


@pytest.mark.parametrize("max_words,least,percent,top,bucket_words,hot_words", [
    (3, 10, 50, 2000, 1 << 20, 100_000), (3, 10, 50, 7, 20, 5), (4, 5, 80, 2000, 300, 100_000), (2, 1, 50, 2000, 10, 10)])
def test_collocations(spark, monkeypatch, max_words, least, percent, top, bucket_words, hot_words):
    monkeypatch.setattr(collocation, "BUCKET_WORDS", bucket_words)
    monkeypatch.setattr(collocation, "HOT_WORDS", hot_words)
    rows = corpus(max_words + least)
    got = collocation.mine_collocations(frame(spark, rows).repartition(3), max_words=max_words, least=least, subsumed_percent=percent, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(rows, max_words, least, percent, top)


def test_collocations_of_nothing(spark):
    assert collocation.mine_collocations(frame(spark, [])).count() == 0
    assert collocation.mine_collocations(frame(spark, [(1, None, None, None), (2, "one", "en", "a")])).count() == 0


def test_a_hot_prefix_is_dealt_into_many_buckets():
    text = " ".join(f"the w{i}" for i in range(4000))
    chunk = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    cold = collocation.stripes_of(chunk, 2, 64, 1, {}).to_pylist()
    hot = collocation.stripes_of(chunk, 2, 64, 1, {("en", "the"): 32, ("fr", "the"): 3, ("en", "absent"): 9}).to_pylist()
    stripes = lambda rows: [s for r in rows for s in r["stripes"].split("\n") if s.startswith("the\t")]
    assert len(stripes(cold)) == 1 and 16 <= len(stripes(hot)) <= 32
    assert sorted(e for s in stripes(hot) for e in s.split("\t")[1:]) == sorted(stripes(cold)[0].split("\t")[1:])
    assert max(len(s) for s in stripes(hot)) < len(stripes(cold)[0]) / 8


# --- divergence ---------------------------------------------------------------------------------------------------------

def plain_audit(rows, least, top):
    texts = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, la, so in rows]
    df, lang_n, group_n = collections.Counter(), collections.Counter(), collections.Counter()
    for la, so, w in texts:
        df.update((la, t) for t in set(w))
    for la, so, w in texts:
        for t in w:
            if df[la, t] >= least:
                lang_n[la, t] += 1
                group_n[la, so, t] += 1
    groups, out = {(la, so) for la, so, _ in texts}, set()
    share = lambda c, n, v: 1 + 1000000000 * (c + 5) // (n + 5 * v)
    for la, so in groups:
        terms = [t for l, t in lang_n if l == la]
        total = {s: sum(group_n[la, s, t] for t in terms) for l, s in groups if l == la}
        p = {s: [share(group_n[la, s, t], total[s], len(terms)) for t in terms] for s in total}
        q = [share(lang_n[la, t], sum(lang_n[la, u] for u in terms), len(terms)) for t in terms]
        pairs = [(-sum(abs(a - b) for a, b in zip(p[so], p[o])), o.encode()) for o in total if o != so]
        ahead = [(b - a, t.encode()) for a, b, t in zip(p[so], q, terms) if group_n[la, so, t] and a > b]
        out |= {(la, so, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))}
        out |= {(la, so, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(ahead)[:top])}
    return out


@pytest.mark.parametrize("least,top,part_rows,cells,tile", [(30, 50, 20_000, 1_000_000, 512), (2, 3, 2, 4, 1), (10_000, 5, 9, 9, 9)])
def test_audit(spark, monkeypatch, least, top, part_rows, cells, tile):
    for name, value in (("PART_ROWS", part_rows), ("CELLS", cells), ("FAN_IN", 2)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(least)
    audit = divergence.audit_sources(frame(spark, rows).repartition(3), least_docs=least, top=top)
    assert audit.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in audit.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(frame(spark, [])).count() == 0


def test_skyband_against_all_pairs():
    rng = np.random.default_rng(5)
    for k, high in itertools.product((1, 2, 7), (2, 5, 1000)):
        a, b, names = rng.integers(0, high, 200), rng.integers(0, high, 200), rng.permutation(200)
        beaten = ((a[:, None] >= a) & (b[:, None] <= b) & (names[:, None] < names)).sum(axis=0)
        assert sorted(divergence.skyband(a, b, names, k)) == list(np.flatnonzero(beaten < k))


def test_shares_beyond_64_bits(spark):
    row = spark.sql("SELECT 900000000000000 AS n, 1600000000000000 AS total, 7 AS v")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("v"), 5, 1_000_000_000)).first()[0]
    assert got == 1 + 1_000_000_000 * (900000000000000 + 5) // (1600000000000000 + 35)


# --- quality ------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " \n", "Plain words here. And more of them", "ALL CAPS!! " * 300, "x" * 20000, "a " * 101, "日本語 テスト " * 60, "\x0e\x7f~_|"]


def test_passages_do_not_depend_on_their_neighbours():
    x, owner = quality.passages(pa.array(TEXTS))
    assert np.bincount(owner).tolist() == [1, 1, 1, 1, 6, 1, 2, 2, 1] and x.shape[1] == quality.FEATURES and np.isfinite(x).all()
    for i, t in enumerate(TEXTS):
        alone, _ = quality.passages(pa.array([t], pa.string()))
        assert np.array_equal(alone, x[owner == i])
    kinds = [sum(quality.KIND[b] == k for b in TEXTS[3].encode()) / len(TEXTS[3]) for k in range(len(quality.KINDS))]
    assert np.allclose(x[owner == 3][0, :len(kinds)], kinds)


def test_gradients_and_attention():
    rng = np.random.default_rng(3)
    model, sizes, y = quality.Model(), np.array([1, 4, 2]), np.array([1.0, 0.0, 1.0])
    model.w = {k: v.astype("f8") for k, v in model.w.items()}
    x = rng.normal(size=(7, quality.FEATURES))

    def loss():
        p = model.forward(x, sizes)["p"]
        decay = sum((model.w[k] ** 2).sum() for k in ("encode", "tanh", "gate", "out")) * quality.DECAY / 2
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + decay

    grads = model.gradients(x, sizes, y)
    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            before = w[at]
            w[at] = before + 1e-5
            up = loss()
            w[at] = before - 1e-5
            slope, w[at] = (up - loss()) / 2e-5, before
            assert slope == pytest.approx(grads[name][at], abs=1e-7), name
    f = model.forward(x, sizes)
    assert np.allclose(np.add.reduceat(f["a"], [0, 1, 5]), 1)
    assert np.allclose(f["z"][1], (f["a"][1:5, None] * f["h"][1:5]).sum(axis=0))


def test_one_bad_passage_is_found_by_attention(spark):
    """A document is bad if one of its passages is junk; held-out documents, and where the attention lies."""
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["stone", "river", "walk", "green", "house", "over", "small"]) for _ in range(quality.PASSAGE))
    bad = lambda: " ".join(rng.choice(["click", "buy", "now"]) + "$$$" for _ in range(quality.PASSAGE))
    rows, labels = [], []
    for i in range(400):
        parts = [good() for _ in range(rng.randint(1, 6))]
        junk = rng.random() < 0.4
        if junk:
            parts[rng.randrange(len(parts))] = bad()
        rows.append((i, " ".join(parts), "en", "a"))
        labels.append((i, int(not junk)))
    docs, labelled = frame(spark, rows, extra=False), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labelled).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    # Labels of held-out rows have no say.
    turned = labelled.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r["score"] for r in quality.score_quality(docs, turned).orderBy("doc_id").collect()] == [got[i]["score"] for i in range(400)]
    model = quality.train(docs, labelled)
    x, _ = quality.passages(pa.array([good() + " " + bad() + " " + good() + " " + good()]))
    assert model.forward((x - model.mean) * model.scale, np.array([4]))["a"].argmax() == 1


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (6, 0), (None, 1), (7, None), (9, 0)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).select("doc_id", "score", "predicted", "text").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    same = quality.score_quality(odd, labels.where("quality = 1")).select("score").distinct()
    assert same.count() == 1
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    assert quality.score_quality(odd, labels.limit(0)).select("score").distinct().count() == 1
