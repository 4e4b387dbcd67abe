import hashlib
import random
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scorewright.llm import common, embedding_dedup, exact_dedup, simhash, substring_dedup

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(max(find(a), find(b)))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 260), rng.randint(100, 260)) for _ in range(110)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots(300, pairs)
    assert got == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- exact --------------------------------------------------------------------------------------------------------------

def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for i, t in rows:
        n = (t or "").translate(UPPER)
        ids = [x for x in groups[n] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def check_exact(rows, got):
    assert sorted(map(str, [(r[0], r[1], r[2], r[4]) for r in got])) == sorted(map(str, exact_brute(rows)))
    assert sum(r["kept"] for r in got) == len({(t or "").translate(UPPER) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_groups_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_exact(rows, exact_dedup.exact_groups(odd).collect())


def test_exact_groups_of_long_shared_texts(docs):
    rng = random.Random(1)
    body = " ".join(rng.choice(["alpha", "Beta", "gamman ", "über", "einer "]) for _ in range(3000))
    rows = [(i, body if i % 3 else body.upper() if i % 2 else body + "!") for i in range(30)] + [(40, body[:-1]), (41, body[1:])]
    check_exact(rows, exact_dedup.exact_groups(docs(rows)).collect())


def test_chunks_make_up_the_text_and_survive_an_insertion(docs):
    rng = random.Random(2)
    body = " ".join("".join(rng.choice("aeiounrstl") for _ in range(5)) for _ in range(4000))
    frame = docs([(1, body), (2, "inserted here " + body)])
    a, b = [r["c"] for r in frame.orderBy("doc_id").select(exact_dedup.chunks(F.col("text")).alias("c")).collect()]
    assert "".join(a) == body and all(len(c) <= 4096 for c in a)
    assert len(set(a) & set(b)) >= len(a) - 2


def test_a_hash_that_stands_for_two_chunks_is_told_apart(docs, spark, monkeypatch):
    frame = docs([(1, "one text"), (2, "another"), (3, "one text")])
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("bigint") + real(F.lit(0)) * 0 if len(c) == 1 else real(*c))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(frame).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_drop_copies_keeps_one_row_and_all_columns(odd, docs):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [(r["text"] or "").translate(UPPER) for r in rows]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(UPPER) for r in odd.collect()})
    assert exact_dedup.drop_copies(docs([])).count() == 0 == exact_dedup.exact_groups(docs([])).count()


# --- simhash ------------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_of_odd_rows(odd, docs):
    got = simhash.simhash_groups(odd).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(str((r[0], int(r[1], 16))) for r in got) == sorted(str((i, plain_fingerprint(t))) for i, t in rows)
    prints = sorted({int(r["f"], 16) for r in got})
    root = roots(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    least = {}
    for r in got:
        k = root[prints.index(int(r["f"], 16))]
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(root[prints.index(int(r["f"], 16))]) for r in got)
    assert simhash.simhash_groups(docs([])).count() == 0 == simhash.drop_near_copies(docs([])).count()


@pytest.mark.parametrize("radius,paired", [(2, 64), (2, 1), (3, 1), (1, 2), (3, 64)])
def test_links_find_all_components(spark, radius, paired):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c for c in centres}
    for c in centres[:12]:
        for _ in range(25):
            values.add(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    values = sorted(values | {0, 1, 3})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= radius]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    place = {v: i for i, v in enumerate(signed)}
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.links(frame, radius, paired).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in found)
    assert roots(len(values), found) == roots(len(values), pairs)


def test_allocation_is_the_cheapest_and_parts_hold_correlated_bits():
    costs = [[0, 9, 50, 90], [0, 2, 4, 60], [0, 8, 30, 70]]
    want = min((a + b + c, [i, j, k]) for i, a in enumerate(costs[0], -1) for j, b in enumerate(costs[1], -1)
               for k, c in enumerate(costs[2], -1) if i + j + k == 0)
    assert simhash.allocate(costs, 0) == want
    bits = np.random.default_rng(0).integers(0, 2, (4000, 64)).astype(float)
    bits[:, 10:20] = bits[:, :1]
    parts = simhash.bit_parts(bits.T @ bits, 4000, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(range(10, 20)) <= set(p) for p in parts)


def test_drop_near_copies_keeps_one_of_each_component(odd, docs):
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    near = [(20 + i, " ".join(words[:200] + [f"x{i}"] + words[200:])) for i in range(4)]
    frame = docs(near + [(1, "some other text altogether")])
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(frame).collect()}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(frame).collect()) == sorted(set(groups.values()))
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["component_id"] for r in simhash.simhash_groups(odd).collect()})


# --- substrings ---------------------------------------------------------------------------------------------------------

def test_sentences_make_up_the_text():
    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choice("ab .!?\n。x1'\"") for _ in range(rng.randint(0, 60)))
        assert "".join(substring_dedup.cut_sentences(t)) == t
    assert substring_dedup.cut_sentences("Pi is 3.14 now. Then! \nNew") == ["Pi is 3.14 now. ", "Then! \n", "New"]


def prose(rng, n):
    return [" ".join(rng.choice("abcdefghij") * rng.randint(2, 6) + str(rng.randrange(99)) for _ in range(rng.randint(5, 12))) + ". " for _ in range(n)]


def test_repeated_passages_go_and_the_rest_stays(docs):
    rng = random.Random(6)
    passage = "".join(prose(rng, 7))
    rows = []
    for i in range(30):
        own = prose(rng, 12)
        rows.append((i, "".join(own[:6]) + (passage if i % 3 == 0 else "") + "".join(own[6:])))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs(rows)).collect()}
    for i, t in rows:
        assert got[i]["text"] == (t.replace(passage, "") if i % 3 == 0 and i else t)
        assert got[i]["n_removed"] == (7 if i % 3 == 0 and i else 0)


def plain_cut(text):
    """Sentences of plain prose, cut again where a word ends in one of the pairs of letters: character by character."""
    out, own = [], ""
    for k, c in enumerate(text):
        own += c
        bare = own[:-1].rstrip(".,")[-2:]
        pair = len(bare) == 2 and (bare[0] in "aeiou" and bare[1] in "lnrt" or bare[0] in "cdklmnrstv" and bare[1] in "desy")
        if c == " " and text[k + 1:k + 2] != " " and (text[k - 1] == "." or pair):
            out.append(own)
            own = ""
    return out + [own] * bool(own)


def plain_spans(own, least, words):
    """The shortest run from every piece with words on, as its words."""
    worded = [k for k, s in enumerate(own) if any(c.isalnum() for c in s)]
    for n, first in enumerate(worded):
        for m in range(n + least, len(worded) + 1):
            body = " ".join(" ".join(own[k] for k in worded[n:m]).replace(".", " ").lower().split())
            if len(body.split()) >= words:
                yield first, worded[m - 1] + 1, body
                break


def test_stretches_without_marks_are_cut_by_their_content():
    rng = random.Random(14)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    for plain in (shared, shared.replace(" ", ""), "日" * 5000, "a" * 5000):
        cuts = []
        for before, after in (("", ""), ("some other words z9 " * 17, " and z8" * 90)):
            t = before + plain + after
            own = substring_dedup.cut_sentences(t)
            assert "".join(own) == t
            ends = np.cumsum([len(s) for s in own]) - len(before)
            cuts.append({int(e) for e in ends if 500 < e < len(plain) - 500})
        assert cuts[0] == cuts[1] and (bool(cuts[0]) == (len(set(plain)) > 1))


def test_repeats_match_a_plain_version_on_odd_rows(odd, docs):
    rng = random.Random(7)
    pool = prose(rng, 9)
    rows = [(i % 37, "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows = sorted(set(rows), key=lambda r: r[0])
    rows = [r for k, r in enumerate(rows) if k == 0 or rows[k - 1][0] != r[0]]
    seen, want = set(), {}
    for i, t in rows:
        own, gone = plain_cut(t), set()
        for first, end, body in plain_spans(own, 3, 20):
            gone |= set(range(first, end)) if body in seen else set()
            seen.add(body)
        want[i] = ("".join(s for k, s in enumerate(own) if k not in gone), len(own), len(gone))
    got = substring_dedup.remove_repeats(docs(rows).repartition(3)).collect()
    assert {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in got} == want
    out = substring_dedup.remove_repeats(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert [r["text"] for r in out.where("doc_id IS NULL AND text IS NULL").collect()] == [None]
    twice = [r["text"] for r in out.where("doc_id = 3").collect()]
    assert twice == ["Hello World again and again"] * 2
    assert substring_dedup.remove_repeats(docs([])).count() == 0


# --- embeddings ---------------------------------------------------------------------------------------------------------

def brute_links(rows, cosine):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], "f8") / np.linalg.norm(np.array(rows[i][1], "f8")) for i in ok}
    pairs = [(a, b) for a in ok for b in ok if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    root = roots(len(rows), pairs)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(least.get(root[i], k), k)
    return sorted((str(rows[i][0]), n[i], str(least.get(root[i]))) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4, 256])
def test_embedding_groups_match_brute_force(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30 if i % 4 else 0] + rng.normal(size=24) * (0.05 if i % 2 else 0.4)).astype("f4").tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, [2 * x for x in rows[1][1]]), (401, rows[2][1][:5]), (402, rows[2][1][:5])]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (505, [float("inf")] * 24),
             (None, rows[3][1]), (None, None), (7, rows[7][1]), (506, [1e-30] * 24), (507, [1e30] * 24)]
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id bigint, embedding array<float>, cid string")
    got = embedding_dedup.embedding_groups(frame, block=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.embedding_groups(frame.limit(0)).count() == 0


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    for n, hashes in ((300, 1), (50_000, 2), (2_000_000, 3)):
        p = embedding_dedup.plan(n, 64)
        assert p["hashes"] == hashes
        x = rng.normal(size=(1500, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (embedding_dedup.addresses(v, p["tables"], p["hashes"], p["probes"], 5) for v in (x, y))
        met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
        assert met.any(axis=1).mean() > 0.98


def test_rotation_is_orthonormal():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)


def hashes_of(text):
    return [tuple(r[1:]) for r in substring_dedup.runs(text, 3, 20).tolist()]


def test_passages_between_other_words_are_caught(spark):
    """Passages of over 50 words of the sample texts, put between any two words of other texts."""
    rng = random.Random(10)
    texts = [r["text"].split(" ") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").collect()]
    texts = [t for t in texts if len(t) > 150 and len(set(t)) > len(t) / 3]
    caught = 0
    for _ in range(200):
        source, hosts = rng.choice(texts), [rng.choice(texts), rng.choice(texts)]
        at = rng.randrange(len(source) - 55)
        made = []
        for h in hosts:
            p = rng.randrange(len(h))
            made.append(" ".join([*h[:p], *source[at:at + 55], *h[p:]]))
        first, second = (set(hashes_of(t)) for t in made)
        caught += bool(first & second)
    assert caught > 185


def test_planted_passages_go_whole_whatever_stands_beside_them():
    """How many planted passages are found, in all kinds of sample texts, and how much of each goes."""
    import pyarrow.parquet as pq
    rng = random.Random(10)
    texts = [t.split(" ") for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    texts = [t for t in texts if len(t) > 150]
    found, gone = 0, 0.0
    for _ in range(300):
        source, at = rng.choice(texts), 0
        at = rng.randrange(len(source) - 51)
        passage, made = source[at:at + 51], []
        for h in (rng.choice(texts), rng.choice(texts)):
            p = rng.randrange(1, len(h))
            made.append((" ".join(h[:p]) + " ", " ".join(passage), " " + " ".join(h[p:])))
        first = set(hashes_of("".join(made[0])))
        text, (before, own, _) = "".join(made[1]), made[1]
        starts = {at for (at, *_), h in zip(substring_dedup.runs(text, 3, 20).tolist(), hashes_of(text)) if h in first}
        pieces, lost = substring_dedup.cut_sentences(text), set()
        for a, b in zip(*substring_dedup.spans_of(pieces, 3, 20)):
            lost |= set(range(a, b)) if a in starts else set()
        found += bool(starts)
        ends = np.cumsum([len(s) for s in pieces])
        cut = sum(max(0, min(ends[i], len(before) + len(own)) - max(ends[i] - len(pieces[i]), len(before))) for i in lost)
        gone += cut / len(own)
    assert found >= 0.98 * 300 and gone >= 0.9 * 300


@pytest.mark.parametrize("letters,space", [("абвгдежзиклмнопрстуф", " "), ("的一是不了在人有我他这中大来上国个到说们", ""), ("äöüßéèñçåøæœšžýðþłęą", " ")])
def test_passages_in_other_scripts_are_cut_alike(letters, space):
    rng = random.Random(14)
    make = lambda n: space.join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    hit = 0
    for _ in range(50):
        passage = make(80)
        first, second = (set(hashes_of(space.join([make(rng.randint(3, 60)), passage, make(40)]))) for _ in range(2))
        hit += bool(first & second)
    assert hit >= 48


def test_columns_of_any_name_survive(odd):
    from scorewright.llm import mixing

    names = ["_taken", "_size", "_same", "_n", "_mine", "_pass", "_k_id", "_k_text", "_k_mark", "_k_n", "_spans", "_clean", "_row", "`a.b`"]
    for out in (exact_dedup.drop_copies(odd), substring_dedup.remove_repeats(odd), mixing.mix_sources(odd, [1.0])):
        assert [c for c in out.columns if c in odd.columns] == odd.columns
        rows = out.select(*names).collect()
        assert rows and all(tuple(r) == ("x",) * len(names) for r in rows)


def test_vectors_at_the_ends_of_the_range_of_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-201]), (4, [0.6, 0.8]), (5, [1e-310, 1e-311]), (6, [1e308, -1e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"])
           for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 4: (2, 1), 3: (1, 3), 5: (1, 3), 6: (0, 6)}
