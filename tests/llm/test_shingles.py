import random

import pytest

import corpus_pipeline
from scorewright.llm import shingle_dedup
from test_dedup import roots


def plain_shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def plain_components(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a)
                             if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    least = {}
    for k, (i, _) in zip(root, rows):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return root, [least.get(k) for k in root]


def near_rows(rng):
    """Copies with some words changed, on both sides of the threshold; a common line; one larger group."""
    pool = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choice(pool) for _ in range(30))
    rows = []
    for g in range(60):
        base = [rng.choice(pool) for _ in range(rng.choice([4, 12, 40, 120, 400]))]
        for _ in range(25 if g == 0 else 3):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(pool)
            rows.append((len(rows), " ".join(own) + (" " + line if g % 3 == 0 else "")))
    return rows + [(len(rows) + k, f"{line} {rng.choice(pool)} {rng.choice(pool)} {rng.choice(pool)}") for k in range(20)]


def test_components_match_brute_force_jaccard(docs, odd):
    rows = near_rows(random.Random(11))
    for frame in (docs(rows).repartition(4), odd):
        own = [(r["doc_id"], r["text"]) for r in frame.collect()]
        root, want = plain_components(own)
        got = shingle_dedup.shingle_groups(frame).collect()
        assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((i, c)) for (i, _), c in zip(own, want))
        kept = shingle_dedup.drop_near_copies(frame)
        assert kept.columns == frame.columns and kept.count() == len(set(root))
    assert shingle_dedup.shingle_groups(docs([])).count() == 0


def test_order_of_shingles_changes_nothing(docs, monkeypatch):
    frame = docs(near_rows(random.Random(12)))
    want = {r["doc_id"]: r["component_id"] for r in shingle_dedup.shingle_groups(frame).collect()}
    monkeypatch.setattr(shingle_dedup, "ORDER_MOST", 0)
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.shingle_groups(frame).collect()} == want


@pytest.mark.parametrize("changed", [1, 3])
def test_pipeline_stage_merges_copies_with_changed_words(spark, docs, changed):
    rng = random.Random(13)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for k in range(12):
        own = list(base)
        for at in range(changed):
            own[1 + 60 * at + k] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs(rows), "").collect())
    assert got == sorted(set(plain_components(rows)[1])) == [0]


def test_stage_takes_candidates_from_fingerprints(spark, docs, monkeypatch):
    """SimHash is a step of the stage: sets whose fingerprints are close are verified, and no link depends on the radius."""
    rng = random.Random(14)
    rows = near_rows(rng)
    frame = docs(rows)
    prints = shingle_dedup.shingle_prints(frame, 5, 0.8, "doc_id", "text").cache()
    own = {r["node"]: r["fp"] for r in prints.collect()}
    found = {(r["a"], r["b"]) for r in shingle_dedup.fingerprint_pairs(prints, 3).collect()}
    close = [(a, b) for a in own for b in own if a < b and bin((own[a] ^ own[b]) & (2 ** 64 - 1)).count("1") <= 3]
    assert found and found <= set(close)
    place = {n: k for k, n in enumerate(own)}
    assert roots(len(own), [(place[a], place[b]) for a, b in found]) == roots(len(own), [(place[a], place[b]) for a, b in close])

    seen = []
    real = shingle_dedup.fingerprint_pairs
    monkeypatch.setattr(shingle_dedup, "fingerprint_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, frame, "").collect())
    assert len(seen) == 1 and got == sorted(set(plain_components(rows)[1]))


def test_bitmaps_bound_what_sets_share(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(15)
    rows, want = [], []
    for size in (1, 5, 200, 900, 5000, 70000):
        for kept in (0.0, 0.5, 0.95, 1.0):
            a = np.unique(rng.integers(-2 ** 63, 2 ** 63, size))
            b = np.unique(np.concatenate([a[:int(kept * size)], rng.integers(-2 ** 63, 2 ** 63, max(1, size // 10))]))
            x, y = shingle_dedup.bitmap(a), shingle_dedup.bitmap(b)
            rows.append((len(rows), x.tolist(), y.tolist()))
            want.append((len(a) - len(np.intersect1d(a, b)), int(np.unpackbits((x & ~y).view("u1")).sum()) if len(x) == len(y) else 0))
    df = spark.createDataFrame(rows, "k int, x array<bigint>, y array<bigint>")
    got = {r["k"]: r["v"] for r in df.select("k", shingle_dedup.alone(F.col("x"), F.col("y")).alias("v")).collect()}
    assert [got[k] for k in range(len(rows))] == [v for _, v in want] and all(v <= n for n, v in want)


def test_blocks_match_brute_force_jaccard(docs, monkeypatch):
    """Parts of a few sets each, so that most pairs lie in two parts; bitmaps of two lengths."""
    monkeypatch.setattr(shingle_dedup, "PAIRED", 1)
    monkeypatch.setattr(shingle_dedup, "BLOCK", 3)
    monkeypatch.setattr(shingle_dedup, "COMPARED", 64)
    rng = random.Random(16)
    base = [f"w{rng.randrange(5000)}" for _ in range(1026)]
    rows = near_rows(rng)
    for k in range(12):  # sets around 1,024 shingles
        own = base[:rng.choice([1026, 1029 - 40])] + [f"y{k}-{j}" for j in range(rng.randint(0, 120))]
        rows.append((len(rows), " ".join(own)))
    want = plain_components(rows)[1]
    assert [r["component_id"] for r in shingle_dedup.shingle_groups(docs(rows).repartition(4)).orderBy("doc_id").collect()] == want


def test_unlinked_group_makes_few_pairs(docs, monkeypatch):
    """Texts of one origin that are each just too different from any other: no row for every two of them."""
    rng = random.Random(17)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for start in (5, 55, 105):
            own[start + rng.randrange(40)] = f"x{k}-{start}"
        rows.append((k, " ".join(own)))
    given = []
    real = shingle_dedup.verified
    monkeypatch.setattr(shingle_dedup, "verified", lambda pairs, *a: given.append(pairs.count()) or real(pairs, *a))
    got = [r["component_id"] for r in shingle_dedup.shingle_groups(docs(rows)).orderBy("doc_id").collect()]
    assert got == plain_components(rows)[1]
    assert sum(given) < 10 * len(rows)
