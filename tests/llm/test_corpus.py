import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scorewright.llm import chat_format, mixing, packing, queries

TOKENIZER = queries.TOKENIZER


# --- mixing -------------------------------------------------------------------------------------------------------------

def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes, weights, share, most=2):
    """Targets by sharing the excess out again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(most * sizes[s] for s in names if s not in free)
        all_w = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / all_w > most * sizes[s]}
        if not over:
            return {s: rest * w[s] / all_w if s in free else most * sizes[s] for s in names}
        free -= over


def test_targets_and_exact_budgets(docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "ü", None, "c"])) for i in range(300)]
    rows += [(500, None, "b"), (None, "x y z", None), (7, "rep eat", "c"), (7, "rep eat", "c"), (501, "", "only empty")]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = fill(sizes, [5, 2, 1], 1.5)
    for ranges in (1, 50):
        got = mixing.mix_plan(docs(rows).repartition(5), [5.0, 2.0, 1.0], ranges=ranges).collect()
        assert len(got) == len(rows)
        taken = collections.Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
        partial = collections.Counter(r["source"] for r in got if r["size"] and r["taken"] % r["size"])
        assert all(n <= 1 for n in partial.values())
    again = mixing.mix_plan(docs(rows[::-1]), [5.0, 2.0, 1.0]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_hold_the_taken_words(docs, odd):
    rng = random.Random(2)
    rows = [(i, "  ".join(f"w{i}_{k}" for k in range(rng.randint(1, 12))) + "\n", rng.choice("abcd")) for i in range(80)]
    frame = docs(rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(frame, [5.0, 2.0, 1.0]).collect()}
    out = mixing.mix_sources(frame, [5.0, 2.0, 1.0])
    assert out.columns == frame.columns
    got, texts = collections.Counter(), dict((r[0], r[1]) for r in rows)
    for r in out.collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += words(r["text"])
    assert got == collections.Counter({k: v for k, v in plan.items() if v})
    odd_out = mixing.mix_sources(odd, [5.0, 2.0, 1.0])
    assert odd_out.columns == odd.columns
    total = sum(words(r["text"]) for r in odd.collect())
    assert sum(words(r["text"]) for r in odd_out.collect()) == math.floor(1.5 * total)
    assert mixing.mix_plan(docs([]), [5.0]).count() == 0 == mixing.mix_sources(docs([]), [5.0]).count()


# --- chats --------------------------------------------------------------------------------------------------------------

def plain_chats(turns):
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    lines = {c: tuple(f"<|{r}|>\n{x}\n" for _, r, x in sorted(v)) for c, v in by.items()}
    keep = []
    for c, own in lines.items():
        longer = any(o[:len(own)] == own and len(o) > len(own) for o in lines.values())
        same = [d for d, o in lines.items() if o == own]
        if not longer and c == min(same, key=lambda d: (d is not None, d or 0)):
            keep.append((c, len(own), len(same), "".join(own)))
    return sorted(map(str, keep))


@pytest.mark.parametrize("block", [2, 1024])
def test_snapshots_collapse(spark, block):
    rng = random.Random(3)
    turns = []
    for c in range(60):
        base, n = rng.randrange(8), rng.randint(1, 7)
        turns += [(c, t + c % 3, "user" if t % 2 == 0 else "assistant", f"text {base} {t}") for t in range(n)]
    turns += [(70, 0, None, None), (71, None, "user", "a"), (71, None, "user", "a"), (None, 1, "user", "lost"), (None, 0, "user", "rows"), (72, 0, "", ""),
              (73, 0, "user", "x" * 50000)]
    rng.shuffle(turns)
    frame = spark.createDataFrame([(*t, "c") for t in turns], "conv_id bigint, turn bigint, role string, text string, position string")
    out = chat_format.render_chats(frame, block=block)
    got = out.collect()
    assert sorted(str((r["conv_id"], r["n_turns"], r["n_copies"], r["text"])) for r in got) == plain_chats(turns)
    parts = chat_format.render_chats(frame, block=block, part=2).collect()
    whole = collections.defaultdict(str)
    for r in sorted(parts, key=lambda r: r["part"]):
        whole[r["conv_id"]] += r["text"]
    assert whole == {r["conv_id"]: r["text"] for r in got}
    assert chat_format.render_chats(frame.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER["path"])


def check_packing(rows, texts, tokenizer, capacity):
    bins, pieces, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    for key, many in texts.items():
        want = []
        for t in many:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            total += len(ids)
            head = len(ids) % capacity
            cuts = ([0] if head else []) + list(range(head, len(ids), capacity)) + [len(ids)]
            want += [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key]) == sorted(want)
    return len(bins), total


def test_packing_of_odd_rows(odd, docs, tokenizer):
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(packing.pack(odd.repartition(3), **TOKENIZER).collect(), texts, tokenizer, 1024)
    check_packing(packing.pack(odd, capacity=7, **TOKENIZER).collect(), texts, tokenizer, 7)
    assert packing.pack(docs([]), **TOKENIZER).count() == 0
    ids = packing.pack(docs([(1, "some words"), (2, None)]), keep_ids=True, **TOKENIZER).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in ids} == {1: tokenizer.encode("some words").ids + [2], 2: [2]}


def test_packing_of_the_sample_table_is_tight(spark, tokenizer):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    bins, total = check_packing(queries.op9_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), texts, tokenizer, 1024)
    assert bins <= 1.02 * total / 1024 + 1


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encode, rng = packing.Encoder(**TOKENIZER).encode, random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x200B, 0x1680, 0x4E00, 0x660, 0x1F600, 0x301, 0x2155, 0xE0001]]
    for i in range(1500):
        t = "".join(rng.choice(pool if rng.random() < 0.5 else "ab 's\n\t 't'll1.,") for _ in range(rng.randint(0, 40)))
        t += "<|endoftext|>" * (i % 50 == 0)
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_uses_every_piece_once_and_pairs_large_ones():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.choice([10, 30, 64])
        counts = {n: rng.randint(0, 9) for n in range(1, capacity + 1)}
        patterns = packing.best_fit(counts, capacity)
        used = collections.Counter()
        for lengths, many in patterns:
            assert sum(lengths) <= capacity and many > 0 and sum(3 * n > capacity for n in lengths) <= 2
            for n in lengths:
                used[n] += many
        assert used == collections.Counter({n: c for n, c in counts.items() if c})
        least = max(math.ceil(sum(n * c for n, c in counts.items()) / capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
        assert sum(m for _, m in patterns) <= 11 / 9 * least + 1


# --- the pipeline -------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tokenizer):
    from scorewright.llm import exact_dedup, toxicity
    from test_shingles import plain_components
    from scorewright.session import pin

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = pin(stage(spark, before, sf), "stage")
        ids = sorted(r[0] for r in after.select("doc_id").distinct().collect())
        if name == "toxicity":
            scored = toxicity.score_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == sorted(r[0] for r in scored.where("predicted = 0").select("doc_id").collect())
        elif name == "exact_dedup":
            assert ids == sorted(r[0] for r in exact_dedup.exact_groups(before).where("kept").select("doc_id").collect())
        elif name == "simhash_near_dedup":
            # The stage links by the similarity of five-word shingles, 0.8 or more: all pairs say which documents stay.
            assert ids == sorted(set(plain_components([(r["doc_id"], r["text"]) for r in before.collect()])[1]))
        elif name == "source_mixing":
            plan = mixing.mix_plan(before, queries.MIX_WEIGHTS)
            assert after.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == plan.agg(F.sum("taken")).first()[0]
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            before = after
    texts = collections.defaultdict(list)
    for r in before.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(after.collect(), texts, tokenizer, 1024)


def test_pipeline_of_odd_and_empty_rows(spark, odd, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, docs([])):
        rows = start
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert rows.count() >= 0
