"""All pairs of a group from one sorted pass over its value counts.

The U of two sides is the sum over values of the one's count times the other's running count, so with the counts of a group
as a matrix of values by entities the U of every pair is one product of matrices; so are the tie terms. A group's histogram is
sent once, whatever the number of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Entities of a group that are held against each other as one dense block.
BLOCK = 256

_COLUMNS = ["u", "_ties", "_sa", "_qa", "min_a", "max_a", "_sb", "_qb", "min_b", "max_b"]


def group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where the rows of sorted columns change; nulls are equal to each other."""
    rows = len(columns[0])
    change = np.zeros(max(rows - 1, 0), bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1)) if rows else np.array([], "i8")


def pair_terms(value: np.ndarray, entity: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(a, b, n_a, n_b, terms) of every two of `size` entities a < b, of one group's counts sorted by value; terms in the order of _COLUMNS."""
    step = np.concatenate(([0], np.cumsum(value[1:] != value[:-1])))
    total = np.bincount(entity, n, size)
    sums, squares = np.bincount(entity, n * value, size), np.bincount(entity, n * value * value, size)
    low, high = np.full(size, np.inf), np.full(size, -np.inf)
    np.minimum.at(low, entity, value)
    np.maximum.at(high, entity, value)
    cubes = np.bincount(entity, n ** 3 - n, size)

    def dense(first: int) -> np.ndarray:
        """Values by the entities of a block."""
        own = (entity >= first) & (entity < first + BLOCK)
        m = np.zeros((step[-1] + 1, min(BLOCK, size - first)))
        m[step[own], entity[own] - first] = n[own]
        return m

    u, ties = np.zeros((size, size)), np.zeros((size, size))
    for i in range(0, size, BLOCK):
        left = dense(i)
        for j in range(i, size, BLOCK):
            right = left if i == j else dense(j)
            at = np.s_[i:i + BLOCK, j:j + BLOCK]
            u[at] = left.T @ (np.cumsum(right, axis=0) - right / 2)
            # (x + y)^3 - (x + y), less what either side has alone.
            ties[at] = 3 * ((left * left).T @ right + left.T @ (right * right))
    a, b = np.triu_indices(size, 1)
    terms = np.stack([u[a, b], ties[a, b] + cubes[a] + cubes[b], sums[a], squares[a], low[a], high[a], sums[b], squares[b], low[b], high[b]])
    return a, b, total[a], total[b], terms


def pair_sweep(hist: DataFrame, on: list[str], entity: str) -> DataFrame:
    """Sizes, U of side a, tie term and sums of every two entities of the same `on` (side a is the smaller name).

    hist: one row per `on`, entity and value, with its count n. A group is worked on whole, so its histogram must be bounded, as that
    of rounded scores is; entities stand against each other in blocks of BLOCK. Null entities stand against none.
    """
    cols = [*on, entity, "value", "n"]
    fields = {f.name: f for f in hist.select(*cols).schema.fields}
    names = [f"{entity}_a", f"{entity}_b"]
    schema = StructType([*[fields[k] for k in on], *[StructField(c, fields[entity].dataType) for c in names],
                         StructField("n_a", LongType()), StructField("n_b", LongType()), *[StructField(c, DoubleType()) for c in _COLUMNS]])
    out_names = schema.names
    k = len(on)

    def complete(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        """The pairs of a table of whole groups."""
        columns = [c.combine_chunks() for c in table.columns]
        value, n = columns[k + 1].to_numpy(zero_copy_only=False).astype("f8"), columns[k + 2].to_numpy(zero_copy_only=False).astype("f8")
        encoded = columns[k].dictionary_encode()
        rank = np.argsort(np.array(encoded.dictionary.take(pa.array(range(len(encoded.dictionary)))).cast(pa.binary())
                                   if pa.types.is_string(encoded.dictionary.type) else encoded.dictionary.to_numpy(zero_copy_only=False)), kind="stable")
        place = np.empty(len(rank), "i8")
        place[rank] = np.arange(len(rank))
        codes = place[encoded.indices.to_numpy(zero_copy_only=False)]
        rows, sides, sizes, terms = [], [], [], []
        for start, end in zip(starts, [*starts[1:], table.num_rows]):
            own, local = np.unique(codes[start:end], return_inverse=True)
            if len(own) < 2:
                continue
            a, b, n_a, n_b, found = pair_terms(value[start:end], local, n[start:end], len(own))
            rows.append(np.full(len(a), start))
            sides.append(np.stack([own[a], own[b]]))
            sizes.append(np.stack([n_a, n_b]))
            terms.append(found)
        if not rows:
            return None
        at, sides = pa.array(np.concatenate(rows)), rank[np.concatenate(sides, axis=1)]
        sizes, terms = np.concatenate(sizes, axis=1).astype("i8"), np.concatenate(terms, axis=1)
        return pa.RecordBatch.from_arrays(
            [*[c.take(at) for c in columns[:k]], *[encoded.dictionary.take(pa.array(s)) for s in sides], *map(pa.array, sizes), *map(pa.array, terms)],
            names=out_names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = group_starts([c.combine_chunks() for c in table.columns[:k]])
            if len(starts) > 1:
                done = complete(table.slice(0, starts[-1]), starts[:-1])
                if done is not None:
                    yield done
                held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            done = complete(pa.Table.from_batches(held), np.array([0]))
            if done is not None:
                yield done

    return (hist.select(*cols).where(hist[entity].isNotNull()).repartition(*on).sortWithinPartitions(*on, "value")
            .mapInArrow(sweep, schema))
