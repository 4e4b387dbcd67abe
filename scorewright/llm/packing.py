"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is decided once for the whole corpus on the
histogram of lengths, which has at most `capacity` rows whatever the corpus is. Pieces above one third of
the capacity are matched first, longest with the longest partner that still fits, two to a sequence at
most; shorter pieces go, longest first, into the tightest gap that takes them. Both work on many equal pieces at
a time. The outcome is a table of slots: for a length, which of its pieces lie at which offset of which sequences.

Pieces find their slot by their number among all pieces of their length. Each task numbers its own while it
tokenises, and the counts of the tasks before are added; no length is ever sorted or gathered.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

CAPACITY, END_ID = 1024, 2
#: How the tokenizer cuts a text before it merges (fixed value of its format).
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    `ranks` is the vocabulary of the tokenizer file `path` as ranks; merging by ranks gives the same ids about five
    times as fast. Texts that hold the string of a special token go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=CUT, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@functools.cache
def encoder(path: str, ranks: str) -> Encoder:
    return Encoder(path, ranks)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and before them what is left over."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, min(e, n) - s) for s, e in zip(starts, [*starts[1:], n])]


def piece_table(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; task and nth number those of one length within a task."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"
              + ", ids binary" * keep_ids)

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(path, ranks).encode, TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, "int64")
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"].array, batch["_text"]):
                ids = memoryview(encode(text) + end)
                for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * s:4 * (s + n)]
                    rows.append((key, i, s, n, zlib.crc32(own), task, int(seen[n])) + ((bytes(own),) if keep_ids else ()))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["_id"] = pd.array([r[0] for r in rows], dtype=batch["_id"].dtype)
            yield out

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return rows.mapInPandas(tokenise, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many sequences have them) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c}
    made: list[tuple[tuple[int, ...], int]] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if a + n <= capacity and left[n] > (n == a)), None)
            many = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            made.append(((a,) if b is None else (a, b), many))
            left[a] -= many
            if b is not None:
                left[b] -= many
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, many in made:
        gaps[capacity - sum(lengths)].append((lengths, many))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                each = capacity // n
                full, over = divmod(left[n], each)
                for k, many in ((each, full), (over, 1)):
                    if k and many:
                        gaps[capacity - k * n].append(((n,) * k, many))
                left[n] = 0
                break
            lengths, many = gaps[gap].pop()
            used = min(many, left[n])
            if many > used:
                gaps[gap].append((lengths, many - used))
            gaps[gap - n].append(((*lengths, n), used))
            left[n] -= used
    return [x for own in gaps.values() for x in own]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, first (number among the pieces of that length), sequence_id of the first, offset."""
    placed: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, many in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, placed[n], sequence, offset))
            placed[n] += many
            offset += n
        sequence += many
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64")


def assign(numbered: DataFrame, slots: pd.DataFrame) -> DataFrame:
    """Add sequence_id and offset to rows with length and number. `slots` is bounded by the capacity, not by the rows."""
    by = slots.sort_values(["length", "first"])
    length, first, sequence, offset = (by[c].to_numpy() for c in by.columns)
    names = [f.name for f in numbered.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + ", sequence_id bigint, offset bigint"
    low = {int(n): (int(np.searchsorted(length, n, "left")), int(np.searchsorted(length, n, "right"))) for n in np.unique(length)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.zeros(len(batch), "int64")
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            for n in np.unique(lengths):
                a, b = low[int(n)]
                own = lengths == n
                at[own] = a + np.searchsorted(first[a:b], numbers[own], "right") - 1
            yield batch[names].assign(sequence_id=sequence[at] + numbers - first[at], offset=offset[at])

    return numbered.mapInPandas(place, schema)


def pack(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text is an empty one and gives a piece of the end id alone. Null and repeated ids are kept as they are:
    each row is a document. Other columns are not read. An empty table gives no rows.
    """
    pieces = pin(piece_table(docs, path, ranks, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counts = pin(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = slot_table(best_fit(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    out = assign(numbered.drop("before", "task", "nth"), slots)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *["ids"] * keep_ids)
