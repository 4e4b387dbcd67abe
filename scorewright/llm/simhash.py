"""SimHash near-dedup with the generalised pigeonhole principle.

A document's fingerprint has 64 bits, each the majority among its shingles' hashes. Documents with fingerprints
that differ in at most `radius` bits are linked, and links are followed to components.

The bits are divided into m parts with thresholds t_1..t_m of -1 or more that add up to radius - m + 1. Then any two
linked fingerprints agree up to t_i bits in some part i: otherwise they would differ in at least sum(t_i + 1) =
radius + 1 bits. Bits that go together are put in one part, so the others stay selective; the thresholds are chosen by
dynamic programming on the candidates and probes that each part would give at each threshold, estimated from all
fingerprints. A fingerprint is filed once per part under its bits there and probes all values within the part's
threshold; what meets is verified. A key where many meet is not paired out: there each fingerprint lists the values
around it, up to half the radius away, and is linked with the smallest fingerprint that lists the same value. That
finds the same components with rows in proportion to the fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import components, keep_rows

BITS, SEED = 64, 42
#: Most rows under one key that are compared with each other; more are linked through the values around them. A comparison
#: takes some nanoseconds and a listed value, of which a fingerprint has 65, about a microsecond, so pairs are the cheaper
#: way well beyond this.
PAIRED = 512
#: What a probe costs beside a candidate that is verified.
PROBE_COST = 2.0
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    pairs = zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist())
    return majority(np.array([digest(view[a:b], SEED) for a, b in pairs], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed number."""
    counts = np.zeros(BITS, "int64")
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE].view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, fp and mark (a hash of the text) per document."""
    @F.pandas_udf("bigint")
    def of_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("_id"), of_texts(F.coalesce(text_col, F.lit(""))).alias("fp"),
                       F.xxhash64(text_col).alias("mark"))


def bit_counts(values: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits set, for all pairs of bits (64 x 64 numbers)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "c": total[i, j].astype("int64")})

    both = np.zeros((BITS, BITS))
    for r in values.select("fp").mapInPandas(count, "i int, j int, c bigint").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        both[r["i"], r["j"]] = r["c"]
    return both


def bit_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each starts with the bit that is most correlated with the rest and takes those closest to it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in free if b not in part), key=lambda b: (near[b, part].sum(), -b)))
        parts.append(sorted(part))
        free = [b for b in free if b not in part]
    return parts


def part_value(bits: list[int], fp: Column) -> Column:
    """The bits of one part, in their places."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def flips(bits: list[int], radius: int) -> list[int]:
    """Signed masks with at most `radius` of the bits set."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per part, that add up to `total` at the least cost; costs[i][t + 1] is that of t = -1, 0, 1, ..."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        reached: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, own in enumerate(cost, start=-1):
                if used + t not in reached or c + own < reached[used + t][0]:
                    reached[used + t] = (c + own, [*chosen, t])
        best = reached
    return best[total]


def choose_parts(values: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to search, from counts over all fingerprints."""
    n = values.count()
    if n < 2:
        return []
    both = bit_counts(values)
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)  # of two fingerprints, in each bit
    options = {m: bit_parts(both, n, m) for m in range(2, radius + 3)}
    named = [(m, i, bits) for m, parts in options.items() for i, bits in enumerate(parts)]
    # Pairs that agree in a part, exactly: rows per value, then their squares. A column per part, so one scan.
    stacked = values.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), part_value(bits, F.col("fp")).alias("v")) for k, (_, _, bits) in enumerate(named)])).alias("x"))
    equal = {r["k"]: r["pairs"] for r in stacked.groupBy("x.k", "x.v").agg(F.count("*").cast("double").alias("c"))
             .groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs")).collect()}
    best = None
    for m, parts in options.items():
        costs = []
        for k, (of, _, bits) in enumerate(named):
            if of != m:
                continue
            within = np.array([1.0])
            for b in bits:
                within = np.convolve(within, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(radius + 1):
                probes = n * sum(math.comb(len(bits), x) for x in range(t + 1))
                row.append(PROBE_COST * probes + equal[k] + n * n * within[1:t + 1].sum())
            costs.append(row)
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return best[1]


def links(values: DataFrame, radius: int = 2, paired: int = PAIRED) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that give the components of all within `radius`."""
    spark = values.sparkSession
    parts = choose_parts(values, radius)
    if not parts:
        return spark.createDataFrame([], "a bigint, b bigint")
    filed = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), part_value(bits, F.col("fp")).alias("key")) for i, (bits, _) in enumerate(parts)])).alias("x"))
    rows = filed.select("x.*", "fp", F.lit(True).alias("own"))
    for i, (bits, t) in enumerate(parts):
        if t > 0:
            around = F.explode(F.array(*[F.lit(m) for m in flips(bits, t)[1:]]))
            probes = values.select(F.lit(i).alias("part"), around.alias("m"), part_value(bits, F.col("fp")).alias("v"), "fp")
            rows = rows.unionByName(probes.select("part", F.col("v").bitwiseXOR(F.col("m")).alias("key"), "fp", F.lit(False).alias("own")))
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("filed")).where("n > 1 AND filed > 0")
    meeting = pin(rows.join(sizes, ["part", "key"]), "meeting")
    few, many = meeting.where(F.col("n") <= paired), meeting.where(F.col("n") > paired)
    left, right = few.where("own").alias("l"), few.alias("r")
    close = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius
    pairs = (left.join(right, (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key"))
                       & (F.col("l.fp") != F.col("r.fp")) & (~F.col("r.own") | (F.col("l.fp") < F.col("r.fp"))) & close)
             .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")))
    # Two are within the radius if the values up to half of it (rounded down) from one and up to half (rounded up)
    # from the other meet.
    inner, outer = flips(list(range(BITS)), radius // 2), flips(list(range(BITS)), radius - radius // 2)
    near = F.posexplode(F.array(*[F.lit(m) for m in outer])).alias("i", "m")
    ball = (many.select("fp").distinct().select("fp", near)
            .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"), (F.col("i") < len(inner)).alias("core")))
    hubs = ball.where("core").groupBy("value").agg(F.min("fp").alias("hub"))
    spokes = ball.join(hubs, "value").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(spokes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   paired: int = PAIRED) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest id reachable by links, itself included), mark.

    A null text counts as empty; texts without words have fingerprint 0 and are linked with any other within the
    radius. Null ids are passed over for component_id, which is null if a component has no other. Repeated rows are
    documents like any other. Other columns are not read. An empty table gives no rows.
    """
    prints = pin(fingerprints(docs, words, id_col, text_col), "prints")
    values = pin(prints.groupBy("fp").agg(F.min("_id").alias("first_id")), "values")
    roots = components(links(values.select("fp"), radius, paired))
    named = (values.join(roots, values["fp"] == roots["node"], "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "mark")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, all columns as they are."""
    groups = simhash_groups(docs, words, radius, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("mark"))).alias("first")
    # A component without any id is told apart by its fingerprint.
    kept = (groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(first)
            .select(F.struct("first.id").alias("_k_id"), F.col("first.mark").alias("_k_mark")))
    return keep_rows(docs, kept, id_col, F.xxhash64(text_col))
