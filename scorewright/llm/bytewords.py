"""Words of many texts at once, as NumPy and Arrow arrays over their UTF-8 bytes; no loop over words.

All separators are single ASCII bytes, which never occur inside a longer UTF-8 character, so texts can be cut byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 8 << 20

#: A-Z to a-z, all other bytes to themselves.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], "u1")


def byte_set(text: str) -> np.ndarray:
    """Which of the 256 bytes are characters of `text`, ASCII only."""
    found = np.zeros(256, bool)
    found[list(text.encode("ascii"))] = True
    return found


class Spans(NamedTuple):
    data: np.ndarray       # all bytes of the texts
    texts: np.ndarray      # where each text begins, and the end of the last
    starts: np.ndarray     # where each word begins
    ends: np.ndarray       # and ends
    held: np.ndarray       # of each byte, whether it is part of a word


class Words(NamedTuple):
    codes: np.ndarray      # of each word, its place in `names`
    names: pa.Array        # the different words, A-Z lower-cased
    doc: np.ndarray        # of each word, the row of its text
    mark: np.ndarray       # of each word, how many marks precede it in the chunk


def chunks(batch: pa.RecordBatch, text: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of its text column, one row at least."""
    column = batch.column(text).cast(pa.large_string())
    places = np.frombuffer(column.buffers()[1], "i8")[column.offset:column.offset + len(column) + 1] if len(column) else []
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(places, places[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def spans(texts: pa.Array, inside: np.ndarray) -> Spans:
    """The longest runs of bytes of the set `inside` in each of one or more texts (null: empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, "u1")[offsets[0]:offsets[-1]] if data is not None else np.array([], "u1")
    offsets = offsets - offsets[0]
    held = inside[data]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = held[edges]
    last[edges - 1] = held[edges - 1]
    return Spans(data, offsets, np.flatnonzero(first), np.flatnonzero(last) + 1, held)


def encoded(s: Spans) -> tuple[np.ndarray, pa.Array]:
    """(codes, names): the different words of spans, A-Z lower-cased, and each word's place among them."""
    places = np.concatenate(([0], np.cumsum(s.ends - s.starts))).astype("i8")
    own = LOWERED[s.data[s.held]]
    found = pa.LargeStringArray.from_buffers(len(s.starts), pa.py_buffer(places), pa.py_buffer(own)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype("i8"), found.dictionary


def hashes(names: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    return np.array([xxh64_intdigest(v.as_buffer()) for v in names], "u8")


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    x = (a.astype("u8") ^ (np.asarray(b, "u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(31))


def words(texts: pa.Array, inside: np.ndarray, marks: np.ndarray | None = None) -> Words:
    """The words of texts; `marks` is a set of bytes to count."""
    s = spans(texts, inside)
    codes, names = encoded(s)
    before = np.cumsum(marks[s.data], dtype="i8")[s.starts] if marks is not None else np.zeros(len(s.starts), "i8")
    return Words(codes, names, np.searchsorted(s.texts, s.starts, "right") - 1, before)
