"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

A rotation multiplies by random signs and applies the Hadamard transform, three times over; a hash is the largest
coordinate of the rotated vector with its sign. Several hashes make a bucket, several buckets (tables) a vector's
addresses; it also probes the buckets whose coordinates come next in size. Vectors that meet in a bucket, one of them at
home, are compared by cosine in double precision.

Equal vectors are one class from the start. A bucket of many vectors is cut into blocks and each pair of blocks is a
cell of its own, so a hot bucket is spread and a cell's memory is bounded. A pair that meets several times counts where it
meets first, which both vectors' addresses tell. A cell hands out no pairs: only each vector's number of links and, for
the components, one link to the smallest vector it reaches within the cell.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import components

#: Vectors of a bucket that make a block.
BLOCK = 256
#: Coordinates that a probe may choose from in each hash.
DEEP = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def addresses(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers (rows x tables x probes); the first of each table is the home bucket."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    rng = np.random.default_rng([seed, d])
    deep = min(DEEP, width)
    combos = np.array(list(itertools.product(range(deep), repeat=hashes)))
    out = np.empty((n, tables, probes), "int64")
    for t in range(tables):
        loss, code = np.zeros((n, len(combos))), np.zeros((n, len(combos)), "int64")
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :deep]
            top = np.take_along_axis(y, order, axis=1)
            own = combos[:, k]
            code = code * (2 * width) + (2 * order + (top < 0))[:, own]
            loss += ((np.abs(top[:, :1]) - np.abs(top)) ** 2)[:, own]
        # Without loss comes first, whatever ties: the choice of the largest coordinate everywhere.
        loss[:, 0] = -1
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, :best.shape[1]] = np.take_along_axis(code, best, axis=1)
        out[:, t, best.shape[1]:] = out[:, t, :1]
    return out


def plan(n: int, d: int) -> dict[str, int]:
    """Hashes so that random vectors make small buckets, and tables and probes that keep the recall with more of them."""
    hashes = max(1, round(math.log(max(n, 2)) / math.log(2 * max(d, 2))))
    return {"hashes": hashes, "tables": max(4, 2 * hashes), "probes": max(4, 2 ** hashes)}


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def of_length_one(vectors: np.ndarray) -> np.ndarray:
    """Rows over their length. They are first scaled by a power of two, which is exact, so that no square leaves the range of doubles."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def met(home: np.ndarray, probed: np.ndarray) -> np.ndarray:
    return (home[:, None] == probed).any(axis=1)


def cell_links(table: int, bucket: int, vectors: np.ndarray, codes: np.ndarray, one: np.ndarray, two: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices) of a cell that are linked and meet here first; one and two are the blocks' rows, equal in a block's own cell."""
    # Lengths and products in double precision: the vectors' own scale is kept out of the comparison.
    unit = of_length_one(vectors)
    a, b = np.nonzero(unit[one] @ unit[two].T >= cosine)
    a, b = one[a], two[b]
    if one is two:
        a, b = a[a < b], b[a < b]
    ca, cb = codes[a], codes[b]
    here = (ca[:, table, 0] == bucket) | (cb[:, table, 0] == bucket)
    for t in range(table):
        here &= ~(met(ca[:, t, 0], cb[:, t]) | met(cb[:, t, 0], ca[:, t]))
    ha, hb = ca[:, table, 0], cb[:, table, 0]
    both = (ha != hb) & met(ha, cb[:, table]) & met(hb, ca[:, table])
    here &= ~(both & (np.minimum(ha, hb) != bucket))
    return a[here], b[here]


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_cells(rows: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """(cid, links, root) per vector and cell with links; rows arrive cell by cell."""
    keys = ["dims", "t", "bucket", "i", "j"]

    def cell(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2 or not g["home"].any():
            return None
        g = g.sort_values("cid")
        vectors = np.array(g["vector"].tolist(), "float64")
        codes = np.array(g["codes"].tolist(), "int64").reshape(len(g), tables, probes)
        first, block = g.iloc[0], g["block"].to_numpy()
        one = np.nonzero(block == first["i"])[0]
        two = one if first["i"] == first["j"] else np.nonzero(block == first["j"])[0]
        a, b = cell_links(int(first["t"]), int(first["bucket"]), vectors, codes, one, two, cosine)
        if not len(a):
            return None
        cid, copies = g["cid"].to_numpy(), g["copies"].to_numpy()
        links = np.bincount(a, copies[b], len(g)) + np.bincount(b, copies[a], len(g))
        label = smallest_reached(len(g), a, b)
        some = links > 0
        return pd.DataFrame({"cid": cid[some], "links": links[some].astype("int64"), "root": cid[label][some]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
                last = tuple(batch[keys].iloc[-1])
                if tuple(held[0][keys].iloc[0]) == last:
                    continue  # one cell still
            rows = pd.concat(held, ignore_index=True) if held else None
            held = []
            if rows is None:
                continue
            if batch is not None:
                open_ = (rows[keys] == rows[keys].iloc[-1]).all(axis=1)
                held, rows = [rows[open_]], rows[~open_]
            found = [x for _, g in rows.groupby(keys, sort=False) if (x := cell(g)) is not None]
            if found:
                yield pd.concat(found, ignore_index=True)

    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInPandas(cells, "cid bigint, links bigint, root bigint"))


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                     tables: int | None = None, hashes: int | None = None, probes: int | None = None, seed: int = 5,
                     block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are components of their
    own, and so are vectors of another length to each other. Equal vectors are linked. Repeated ids are
    vectors of their own; null ids are passed over for component_id unless there is no other, and kept compares nulls as
    equal. Other columns are not read. An empty table gives no rows.
    """
    rows = pin(vectors.select(F.col(id_col).alias("_id"), F.when(usable(F.col(vector_col)), F.col(vector_col)).alias("vector"))
               .withColumn("mark", F.xxhash64("vector")), "vectors")
    classes = pin(rows.where("vector IS NOT NULL").groupBy("mark", "vector")
                  .agg(F.count("*").alias("copies"), F.min("_id").alias("first_id"))
                  .select(F.monotonically_increasing_id().alias("cid"), F.size("vector").alias("dims"), "*"), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max("dims").alias("d")).first()
    chosen = plan(size["n"], size["d"] or 2)
    tables, hashes, probes = tables or chosen["tables"], hashes or chosen["hashes"], probes or chosen["probes"]

    def address(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby("dims"):
                x = np.array(g["vector"].tolist(), "float64")
                codes = addresses(of_length_one(x), tables, hashes, probes, seed)
                yield g.assign(codes=list(codes.reshape(len(g), -1)))

    kind = classes.schema["vector"].dataType.simpleString()
    coded = pin(classes.select("cid", "dims", "copies", "vector").mapInPandas(
        address, f"cid bigint, dims int, copies bigint, vector {kind}, codes array<bigint>"), "codes")
    filed = (coded.select("cid", "dims", F.posexplode("codes").alias("p", "bucket"))
             .groupBy("cid", "dims", F.floor(F.col("p") / probes).cast("int").alias("t"), "bucket")
             .agg(F.max(F.col("p") % probes == 0).alias("home")))
    sizes = (filed.groupBy("dims", "t", "bucket").agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
             .where("n > 1 AND any_home").drop("any_home"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = (filed.join(sizes, ["dims", "t", "bucket"]).withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cid", "t", "bucket", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    found = pin(compare_cells(placed.join(coded, "cid"), cosine, tables, probes), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = (classes.join(links, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
             .select("mark", "vector", "first_id", F.coalesce("root", "cid").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = named.join(least, "root").select("mark", "vector", "n_links", "component_id")
    linked = rows.where("vector IS NOT NULL").join(result, ["mark", "vector"]).select("_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id",
                                            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
