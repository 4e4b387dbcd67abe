"""Near-dedup by SimHash, verified by the Jaccard similarity of word shingles and completed without loss.

Documents are linked if their sets of shingles have a similarity of at least `similarity`, and links are followed to
components. Candidates are sets whose SimHash fingerprints differ in few bits, found by the generalised pigeonhole (`simhash`).
As fingerprints of similar sets may differ in many bits, sets that share rare shingles are candidates too. Two sets of n and m shingles can be so similar only if they share one of the first n - ceil(similarity n) + 1
and m - ceil(similarity m) + 1 in whatever order all shingles are put, and the first one they share must leave enough
after it in both (prefix and position filters). The order puts shingles that are common in a sample last, so that lines
that many texts share bring few together; any order gives the same result. Candidates are verified on the whole sets; before,
a bitmap of each set's hashes bounds what two can share, so the sets of few pairs have to meet.

Of shingles with the same sharers only the first is followed. What shares a shingle is first compared with one of the sharers
only; then those that are not yet in one component are. Few sharers are paired by a join, which makes at most `PAIRED` rows of
one. More are compared in blocks, bitmap by bitmap, and only pairs that the bitmaps let pass become rows. To tell that sets
which share shingles are in no two cases similar, each has to be held against each, so these comparisons, unlike the rows, grow
with the square of what a group leaves unlinked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from . import simhash
from .common import components, keep_rows

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Bits in which the fingerprints of candidates may differ. No link depends on it.
RADIUS = 2
#: Bits of a set's bitmap, as powers of 2: the first one with as many bits as the set has hashes, else the last.
BITMAPS = (10, 13, 16)
#: Texts whose shingles are counted for the order, and how many common shingles it puts last. Neither changes a result.
ORDER_ROWS, ORDER_MOST = 20_000, 100_000
#: Most sharers of a shingle that are paired by a join, and about how many of more make a block.
PAIRED, BLOCK = 8, 512
#: Words of bitmaps that are compared at a time.
COMPARED = 1 << 20
#: Texts that are worked on at a time.
SLICE = 500
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles; a text of fewer words is one shingle, and one without words the shingle 0."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return np.zeros(1, "int64")
    k = min(words, len(tokens))
    own = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), "u8", len(tokens))
    out = np.zeros(len(own) - k + 1, "u8")
    for j in range(k):  # a chained hash of the words' hashes
        out = (out ^ own[j:j + len(out)]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out.view("i8"))


def prefix(own: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not among `common` (sorted) by hash, then the common ones by rank."""
    size = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    last = common[at] == own
    return np.concatenate([own[~last], own[last][np.argsort(rank[at[last]], kind="stable")]])[:size]


def bitmap(own: np.ndarray) -> np.ndarray:
    """The first bits of each hash of a set, as places in a bitmap."""
    k = next((k for k in BITMAPS if len(own) <= 1 << k), BITMAPS[-1])
    bits = np.zeros(1 << k, bool)
    bits[own.view("u8") >> np.uint64(64 - k)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def common_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several texts of a sample, sorted, and their ranks from rare to common."""
    share = max(1, docs.count() // ORDER_ROWS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["_text"]]
            h, n = np.unique(np.concatenate([np.empty(0, "int64"), *sets]), return_counts=True)
            yield pd.DataFrame({"h": h[n > 1], "n": n[n > 1]})

    mark = F.xxhash64(text_col)
    counts = (docs.where(F.pmod(mark, F.lit(share)) == 0).select(F.col(text_col).alias("_text")).mapInPandas(count, "h bigint, n bigint")
              .groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(ORDER_MOST).toPandas())
    counts = counts.sort_values("h")
    return counts["h"].to_numpy("int64"), np.lexsort((counts["h"], counts["n"])).argsort()


def shingle_prints(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """_id, mark (a hash of the text), node (a hash of the set of shingles), n (its size), prefix, fp (the set's fingerprint) and
    bits (its bitmap) per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    common, rank = common_shingles(docs, words, text_col)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at:at + SLICE]
                sets = [shingle_set(t, words) for t in part["_text"]]
                yield pd.DataFrame({"_id": part["_id"].array, "mark": part["mark"].array,
                                    "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "u8").view("i8"),
                                    "n": [len(s) for s in sets], "prefix": [prefix(s, similarity, common, rank) for s in sets],
                                    "fp": np.array([simhash.majority(s) for s in sets], "i8"), "bits": [bitmap(s) for s in sets]})

    return (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("_text"))
            .mapInPandas(read, f"_id {kind}, mark bigint, node bigint, n int, prefix array<bigint>, fp bigint, bits array<bigint>"))


def enough(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m that share so many are similar enough."""
    return shared * (1 + similarity) >= (n + m) * similarity - 1e-6


def alone(x: Column, y: Column) -> Column:
    """Bits of x that y has not: at least so many hashes of the one set are not in the other. Bitmaps of two lengths tell nothing."""
    lone = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), lone).otherwise(0)


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    @F.pandas_udf("array<bigint>")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in texts])

    sketches = prints.select("node", "n", "bits").dropDuplicates(["node"])
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    most = F.least(F.col("n_a") - alone(F.col("bits_a"), F.col("bits_b")), F.col("n_b") - alone(F.col("bits_b"), F.col("bits_a")))
    pairs = pin(pairs.distinct().join(side("b"), "b").join(side("a"), "a")
                .where(enough(most, F.col("n_a"), F.col("n_b"), similarity)).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = pin(prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("_m")), "wanted")
    # Joined first, so that only wanted texts travel where their number allows that.
    found = docs.select(F.xxhash64(text_col).alias("_m"), F.col(text_col).alias("_text")).join(texts, "_m").dropDuplicates(["_m"])
    sets = pin(found.select("node", of_texts("_text").alias("own")), "sets")
    close = enough(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"), similarity)
    return pin(pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("t")), "b")
               .join(sets.select(F.col("node").alias("a"), F.col("own").alias("s")), "a").where(close).select("a", "b"), "links")


def fingerprint_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): sets whose fingerprints differ in at most `radius` bits; of equal fingerprints, the smallest set with each other."""
    values = pin(prints.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    ends = [values.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    close = simhash.links(values.select("fp"), radius).join(ends[0], "a").join(ends[1], "b").select("first_a", "first_b")
    equal = prints.join(values, "fp").where("node <> first").select("first", "node")
    return close.union(equal).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def block_pairs(rows: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets of different roots that share an h and may be similar by its places and by their bitmaps; `rows` has hub, h, node,
    n, pos and root.

    What shares any h of one hub is compared once. It is dealt into parts of about `BLOCK` sets, and every two parts are compared
    in a group of their own.
    """
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows["i"].iat[0] == rows["j"].iat[0]
        x, y = (rows[rows["part"] == rows[c]] for c in "ij")
        (nx, rx, ix), (ny, ry, iy) = ([side[c].to_numpy("int64") for c in ("n", "root", "node")] for side in (x, y))
        if not len(x) or not len(y):
            return pd.DataFrame({"a": ix[:0], "b": ix[:0]})
        held = []
        for side in (x, y):  # the places of each h: (row, pos)
            h, pos = (np.concatenate(side[c].to_list()) for c in ("h", "pos"))
            row = np.repeat(np.arange(len(side)), [len(v) for v in side["h"]])
            order = np.argsort(h, kind="stable")
            names, starts = np.unique(h[order], return_index=True)
            held.append(dict(zip(names.tolist(), np.split(np.column_stack([row, pos])[order], starts[1:]))))
        near = np.zeros((len(x), len(y)), bool)
        for h in held[0].keys() & held[1].keys():
            (u, pu), (v, pv) = held[0][h].T, held[1][h].T
            near[np.ix_(u, v)] |= enough(np.minimum((nx[u] - pu)[:, None], ny[v] - pv), nx[u][:, None], ny[v], similarity)
        near &= rx[:, None] != ry
        if one:
            near &= ix[:, None] < iy
        width = max(len(b) for b in rows["bits"])
        (sx, mx), (sy, my) = ((np.array([len(b) for b in side["bits"]]), np.stack([np.pad(b, (0, width - len(b))) for b in side["bits"]]).view("u8"))
                                for side in (x, y))
        p, q = np.nonzero(near)
        keep = [np.zeros(0, bool)]
        for at in range(0, len(p), step := max(1, COMPARED // width)):
            u, v = p[at:at + step], q[at:at + step]
            same = sx[u] == sy[v]
            shared = np.minimum(nx[u] - same * np.bitwise_count(mx[u] & ~my[v]).sum(axis=1, dtype="int64"),
                                ny[v] - same * np.bitwise_count(my[v] & ~mx[u]).sum(axis=1, dtype="int64"))
            keep.append(enough(shared, nx[u], ny[v], similarity))
        keep = np.concatenate(keep)
        u, v = ix[p[keep]], iy[q[keep]]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    sets = rows.groupBy("hub", "node", "n", "root").agg(F.collect_list("h").alias("h"), F.collect_list("pos").alias("pos"))
    sets = pin(sets, "sharers")
    parts = sets.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    bits = prints.select("node", "bits").join(sets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    dealt = (sets.join(parts, "hub").join(bits, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
             .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other"))
    return dealt.groupBy("hub", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def shingle_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """(a, b): links between sets of shingles that give the components of all that are similar enough."""
    rows = prints.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    same = Window.partitionBy("h")  # one shuffle for what is shared and who shares it
    met = pin(rows.withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)}).where("lo < hi").drop("lo", "hi").distinct(), "met")
    after = enough(F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")), F.col("n"), F.col("n2"), similarity)

    # All prefixes have the same order, so of shingles with the same sharers one comes first in each, and leaves the most after it.
    hubs = (met.groupBy("h").agg(F.min(F.struct("node", "n", "pos")).alias("x"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("who"))
            .groupBy("c", "who", F.col("x.node").alias("node2"), F.col("x.n").alias("n2"))
            .agg(F.min(F.struct(F.col("x.pos").alias("pos"), "h")).alias("y")).select(F.col("y.h").alias("h"), "node2", "n2", F.col("y.pos").alias("pos2")))
    shared = pin(met.join(hubs, "h"), "shared")
    hubbed = shared.where((F.col("node") > F.col("node2")) & after).select(F.col("node2").alias("a"), F.col("node").alias("b"))
    some = verified(fingerprint_pairs(prints).unionByName(hubbed), docs, prints, words, similarity, text_col)

    roots = pin(components(some), "roots")
    rooted = shared.select("h", "node", "n", "pos", F.col("node2").alias("hub")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("h", "c")
    left = pin(rooted.join(several, "h"), "left")
    few = left.where(F.col("c") <= PAIRED)
    first = few.select("h", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "root")])
    rest = (few.join(first, "h").where((F.col("node") > F.col("node2")) & (F.col("root") != F.col("root2")) & after)
            .select(F.col("node2").alias("a"), F.col("node").alias("b")))
    rest = rest.unionByName(block_pairs(left.where(F.col("c") > PAIRED), prints, similarity))
    return some.unionByName(verified(rest, docs, prints, words, similarity, text_col))


def shingle_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id, node, root (its component's smallest node), component_id (the smallest id reachable by
    links, itself included), mark.

    A null text counts as empty; texts without words are alike, and a text of fewer words than a shingle is one shingle.
    Null ids are passed over for component_id, which is null if a component has no other. Repeated rows are documents
    like any other. Other columns are not read. An empty table gives no rows.
    """
    prints = pin(shingle_prints(docs, words, similarity, id_col, text_col), "prints")
    values = pin(prints.groupBy("node").agg(F.min("_id").alias("first_id")), "values")
    roots = components(shingle_links(docs, prints, words, similarity, text_col))
    named = pin(values.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id"), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(least, "root").select("node", "component_id", "root")
    return prints.join(of_set, "node").select(F.col("_id").alias(id_col), "node", "root", "component_id", "mark")


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, all columns as they are."""
    groups = shingle_groups(docs, words, similarity, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("mark"))).alias("first")
    kept = (groups.groupBy("root").agg(first)
            .select(F.struct("first.id").alias("_k_id"), F.col("first.mark").alias("_k_mark")))
    return keep_rows(docs, kept, id_col, F.xxhash64(text_col))
