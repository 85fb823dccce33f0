"""Vectorised text work on Arrow string columns: many documents at a time, in numpy, without a loop over words.

A chunk is the UTF-8 bytes of some consecutive rows with their offsets.  Words are maximal runs of bytes that are
not white space (space, U+0009 to U+000D); these bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Rows are handled so many bytes at a time, which bounds the working arrays (about 60 bytes for each byte).
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([seed + 1], U64)))


_place_keys = keys(4096, 11)


def place_keys(n: int) -> np.ndarray:
    """Random factors for the first ``n`` bytes of a word; a prefix of the same sequence whatever ``n``."""
    global _place_keys
    if n > len(_place_keys):
        _place_keys = keys(max(n, 2 * len(_place_keys)), 11)
    return _place_keys


@dataclass
class Chunk:
    first: int  #: row of the batch
    data: np.ndarray  #: uint8
    offsets: np.ndarray  #: int64, one more than rows, from 0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive rows of a string or binary column, up to ``limit`` bytes unless one row has more; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_large_binary(column.type) else "", column.type))
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Chunk(a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  #: row in the chunk of each word
    counts: np.ndarray  #: words of each row
    first: np.ndarray  #: index of each row's first word, and the total at the end


def words(chunk: Chunk) -> Words:
    w = ~_SPACE[chunk.data]
    n = len(w)
    edge = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    prev = np.zeros(n, bool)
    prev[1:] = w[:-1]
    prev[edge] = False
    starts = np.flatnonzero(w & ~prev)
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    doc = np.searchsorted(chunk.offsets, starts, "right") - 1
    counts = np.bincount(doc, minlength=chunk.rows).astype(np.int64)
    return Words(starts, ends, doc, counts, np.concatenate(([0], np.cumsum(counts))))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not overlap, ascending and not empty.

    Multilinear in the bytes: two different words meet with a chance of at most 2**-56.
    """
    if not len(starts):
        return np.empty(0, U64)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    source = place + np.repeat(starts, lens)
    value = place_keys(int(lens.max()))[place]
    value = value * (data[source].astype(U64) + U64(1))
    return mix(np.add.reduceat(value, at) + lens.astype(U64) * U64(0xA0761D6478BD642F))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes, at each word that has ``size - 1`` more behind it in the array."""
    if len(h) < size:
        return np.empty(0, U64)
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(31)
        out += h[k : len(h) - size + 1 + k]
    return mix(out)
