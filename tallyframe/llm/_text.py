"""Whole-batch text work in numpy: spans of bytes in an Arrow string column and 64-bit
hashes of them, without a Python loop over words.

Words here are runs of bytes that a 256-entry table marks; documents never share a word.
Hashes are polynomial sums of random byte values modulo 2^64, finished with a bit mixer.
They depend on fixed seeds only, so every task computes the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = _INV = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, every ASCII byte that is not a letter or a digit to a space.
WORD_FOLD = np.arange(256, dtype=np.uint8)
WORD_FOLD[:128] = 32
WORD_FOLD[48:58] = np.arange(48, 58)
WORD_FOLD[97:123] = np.arange(97, 123)
WORD_FOLD[65:91] = np.arange(97, 123)

#: A-Z to a-z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = np.arange(97, 123)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (multiply and xor-shift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _POW, _INV
    if len(_POW) < n:
        size = n + n // 8 + 4096
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE)]))
            _INV = np.cumprod(np.concatenate([one, np.full(size - 1, np.uint64(pow(int(_BASE), -1, 2**64)))]))
    return _POW, _INV


def doc_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 400_000):
    """Cut a record batch into runs of rows with about ``most_bytes`` of text each (one
    row at least), so numpy temporaries stay small whatever the batch holds."""
    n = batch.num_rows
    if n == 0:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
    i, base = 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(i, j - i)
        base, i = int(ends[j - 1]), j


def spans(data: np.ndarray, off: np.ndarray, keep: np.ndarray, cut: np.ndarray | None = None):
    """Runs of bytes with ``keep`` set, cut at document bounds and before bytes with ``cut``
    set: (starts, ends, first span of each document and one past the last)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)  # a span may not go on across this place
    edge[1:-1] = ~keep[:-1] | ~keep[1:]
    if cut is not None:
        edge[:-1] |= cut
    edge[off] = True
    s, e = np.flatnonzero(keep & edge[:-1]), np.flatnonzero(keep & edge[1:]) + 1
    return s, e, np.searchsorted(s, off)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: differences of running polynomial sums, shifted back
    by the inverse power of the span's start (an empty span hashes to a constant)."""
    pw, inv = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * pw[:len(data)], out=run[1:])
        return mix((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64) * _BASE)


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of ``n`` consecutive word hashes, by starting word."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * _BASE + h[j:len(h) - n + 1 + j]
        return mix(out)


def gram_hash_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The same hash for the words at ``at`` only."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = out * _BASE + h[at + j]
        return mix(out)


def gram_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starting words, documents) of the n-word windows that stay inside one document."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    cut = np.cumsum(count) - count
    start = np.arange(int(count.sum())) - np.repeat(cut, count) + np.repeat(bounds[:-1], count)
    return start, doc


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    c = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


class HashTable:
    """Open-addressing map from 64-bit hashes to int32 values, looked up a whole array at
    a time. Zero is a reserved key."""

    def __init__(self, capacity: int):
        self.bits = max(4, int(2 * capacity - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        """Insert new, distinct keys."""
        todo, mask = np.arange(len(h)), (1 << self.bits) - 1
        at = self._slot(h)
        while len(todo):
            free = self.keys[at[todo]] == 0
            cand = todo[free]
            _, firsts = np.unique(at[cand], return_index=True)
            won = cand[firsts]
            self.keys[at[won]], self.vals[at[won]] = h[won], v[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & mask
        self.n += len(h)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        at, mask = self._slot(h), (1 << self.bits) - 1
        k = self.keys[at]
        out = np.where(k == h, self.vals[at], np.int32(-1))
        todo = np.flatnonzero((k != h) & (k != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            k = self.keys[at[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.vals[at[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return out
