"""Words and word hashes of Arrow text columns, computed on the UTF-8 bytes with numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A null text has no
words. Texts are handled whole: a batch is cut between rows into pieces of about PIECE_BYTES, and a single longer text is
one piece whose hashes are made in steps, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
STEP_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 3
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept per base and grown when needed."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1024)
        known = np.full(size, base % 2**64, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base % 2**64, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """The words of a piece: text i has words at[i]:at[i + 1] of starts, ends and hashes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def shingles(self, k: int, multipliers: np.ndarray) -> np.ndarray:
        """Hash of the k words from each position on; positions too close to a text's end hold no meaning."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * multipliers[j]
        return mix(out)


def multipliers(k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that the texts of a piece hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and n + 1 offsets; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if lower:
        data = _LOWER[data]
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), _hashes(data, starts, ends))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes' random values, scrambled."""
    out = np.empty(len(starts), dtype=np.uint64)
    back = inverse(_BASE)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES, side="right")))
        low, high = starts[at], ends[to - 1]
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data[low:high]] * powers(_BASE, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * powers(back, high - low)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)
