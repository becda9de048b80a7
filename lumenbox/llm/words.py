"""Words, hashes and shingles of whole texts, computed on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[[b for b in range(128) if not chr(b).isalnum()]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) with their bytes and offsets from 0; of about ``limit`` bytes, or one longer text."""
    data, at = buffers(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that ``apart`` does not list."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inner = ~apart[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inner[:-1]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inner[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inner & ~before)
    end = np.flatnonzero(inner & ~after) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over prefix sums, then mixed with the length."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = (p[: len(data) + 1] for p in _grown(len(data) + 1))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of k words (A-Z lower-cased, split at ASCII white space).

    With fewer than k words, one hash of all of them; without words, none.
    """
    odd = [U64(2 * int(x) + 1) for x in mix(np.arange(1, k + 1, dtype=U64)) >> U64(1)]
    for a, b, data, at in slices(column):
        data = LOWER[data]
        start, end, row = spans(data, at, WHITE)
        h = hashes(data, start, end)
        first = np.searchsorted(row, np.arange(b - a + 1))
        runs = np.zeros(max(0, len(h) - k + 1), U64)
        for j in range(k):
            runs += h[j : j + len(runs)] * odd[j]
        runs = mix(runs)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                x = np.full(1, hi - lo, U64)
                for j, v in enumerate(h[lo:hi]):
                    x = x + np.asarray([v]) * odd[j]
                yield mix(x ^ U64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, U64)
