"""Helpers for text work inside tasks: bounded batches and rolling hashes over whole columns."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; one longer text is handled alone.
BATCH_BYTES = 1 << 21
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def bounded(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of at most ``rows`` rows that hold about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size + -(-limit // rows)) // limit
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a bounded length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BATCH_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Rabin-Karp hashes of any spans of one symbol array, in constant time a span."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def joined(parts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All parts in one byte array, a gap after each, and where each begins (with the end)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(gap.join(parts) + gap, np.uint8), np.r_[0, np.cumsum(size + len(gap))]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a zero after each, and where each text begins (with the end)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.r_[0, np.cumsum(size + 1)]


class Kinds:
    """A yes-or-no property of characters over whole arrays of code points."""

    def __init__(self, test):
        self.test = test
        self.low = np.fromiter((test(chr(c)) for c in range(1 << 16)), bool, 1 << 16)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(codes, 0xFFFF)]
        high = codes > 0xFFFF
        if high.any():
            some, back = np.unique(codes[high], return_inverse=True)
            out[high] = np.fromiter((self.test(chr(c)) for c in some), bool, len(some))[back]
        return out
