"""Word hashing over Arrow string columns, a few numpy passes over the bytes.

A word is a run of bytes other than space and 0x09-0x0D; upper-case A-Z is folded on request.
Hashes are 64 bits: two different words or shingles are taken as equal with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Of each byte, as it is and folded: its random number, 0 for white space.
_CODES = [np.where(SPACE, np.uint64(0), _RANDOM[fold]) for fold in (np.arange(256), LOWER)]
_powers = np.ones((2, 1), dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The powers of _P and of its inverse, n of each at least."""
    global _powers
    if _powers.shape[1] < n:
        base = np.array([[int(_P)], [pow(int(_P), -1, 2**64)]], dtype=np.uint64)
        _powers = np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(base, n + n // 4, axis=1)], axis=1), axis=1, dtype=np.uint64)
    return _powers


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting takes a fraction of the time that np.unique's hashing does."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def portions(batches, column: int, limit: int = 1 << 20):
    """The batches cut into rows of about ``limit`` bytes of text, so that arrays beside it stay small."""
    for b in batches:
        yield from slices(b, column, limit)


def slices(rows, column, limit: int):
    """A batch or table cut into rows of about ``limit`` bytes of text."""
    _, ends = flat(rows.column(column))
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield rows.slice(i, j - i)
        i = j


def gathered(batches, column: int, limit: int):
    """A column of texts in pieces of about ``limit`` bytes, which may span batches."""
    parts, size = [], 0
    for b in portions(batches, column, limit):
        parts.append(b.column(column))
        size += int(flat(parts[-1])[1][-1])
        if size >= limit:
            yield pa.chunked_array(parts)
            parts, size = [], 0
    if parts:
        yield pa.chunked_array(parts)


def words(data: np.ndarray, ends: np.ndarray, lower: bool, chunk: int = 1 << 17):
    """(hash, start, end) of every word, and the index of each text's first word.

    A word's hash is the sum of its bytes' numbers times powers of their places, mixed: a difference of running
    sums, moved to the word's start. Works in slices of about ``chunk`` bytes, cut before a word, so memory doesn't
    follow the longest text.
    """
    n = len(data)
    hashes, starts, stops, a = [], [], [], 0
    first = np.zeros(n + 1, dtype=bool)
    first[ends] = True
    while a < n:
        z = min(n, a + chunk)
        while z < n and not (SPACE[data[z]] or first[z]):
            step = np.flatnonzero(SPACE[data[z : z + chunk]] | first[z : min(z + chunk, n)])
            z = z + int(step[0]) if len(step) else min(n, z + chunk)
        part = data[a:z]
        gap = blank(part)
        edge = gap[:-1] | first[a + 1 : z]  # before byte i + 1
        start, stop = ~gap, ~gap
        start[1:] &= edge
        stop[:-1] &= gap[1:] | first[a + 1 : z]
        start, stop = np.flatnonzero(start), np.flatnonzero(stop)
        if len(start):
            power, inverse = _power(z - a)
            code = _CODES[lower][part] * power[: z - a]
            total = np.cumsum(code)
            hashes.append(mix((total[stop] - total[start] + code[start]) * inverse[start]))
            starts.append(start + a)
            stops.append(stop + 1 + a)
        a = z
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, ends)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values (texts' ends are the caller's to mind)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k * int(_Q) % 2**64), dtype=np.uint64)
    for j in range(k):
        out = out + h[j : j + n] * np.uint64(pow(int(_Q), j + 1, 2**64))
    return mix(out)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists of longs."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flatly = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flatly.view(np.int64), pa.int64()))
