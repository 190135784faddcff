"""Vectorised word scanning over a batch of texts (NumPy over the Arrow buffers).

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, so ``[^\\x20\\x09-\\x0D]+`` on the
text.  Words are identified by a 64-bit hash of their bytes: a sum of per-byte random values
times powers of a random odd base, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
GRAM = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20  # bytes hashed at a time


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a batch: byte spans in ``data`` and the text each belongs to (ascending)."""

    data: np.ndarray     # uint8, the texts' bytes one after the other
    offsets: np.ndarray  # int64, text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray    # int64 per word
    end: np.ndarray      # int64 per word
    first: np.ndarray    # int64 per text + 1: word range of text i is first[i]:first[i + 1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        if not len(out):
            return out
        longest = int((self.end - self.start).max())
        power = np.ones(longest, dtype=np.uint64)
        if longest > 1:
            power[1:] = np.multiply.accumulate(np.full(longest - 1, _BASE, dtype=np.uint64))
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + _CHUNK, "right")))
            s, e = self.start[lo:hi], self.end[lo:hi]
            n = e - s
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            pos = np.arange(int(n.sum())) - np.repeat(at, n)
            byte = self.data[np.repeat(s, n) + pos]
            out[lo:hi] = np.add.reduceat(_BYTE[byte] * power[pos], at)
            lo = hi
        return mix(out + (self.end - self.start).astype(np.uint64))


def scan(texts: pa.Array) -> Words:
    """Words of every text; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)[offsets[0]:offsets[-1]] if buf is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    ink = ~_SPACE[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]  # words do not run over a text's end
    begins[cut] = ink[cut]
    ends[cut - 1] = ink[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets, "left"))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` consecutive word hashes that begin at each position (len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n] * GRAM[0]
    for j in range(1, k):
        out += h[j:j + n] * GRAM[j]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most_bytes`` of text (at least one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + most_bytes, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc has it


def give_back() -> None:
    """Hands freed memory back to the system.  A worker serves one stage after the other; what it would keep adds to what the next needs."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Batches put together until they have about ``most_bytes`` of text, and cut where they have more."""
    held, size = [], 0
    for b in slices(batches, column, most_bytes):
        held.append(b)
        size += b.column(column).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
