"""Vectorised text primitives on Arrow string buffers (numpy, no per-word Python).

All functions work on UTF-8 bytes: every character class the operators use is
either ASCII or "any non-ASCII character", so byte classes are exact.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1


def tidy(run):
    """A function over Arrow batches that gives freed memory back when its task ends: workers live on and are many."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pieces(batch, rows: int = 1024):
    """A batch in slices of at most so many rows."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges of at most ``limit`` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256: True inside any of the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: words between ASCII white space
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: words of lower-case letters, digits and all characters beyond ASCII
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, extended on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, BLOCK_BYTES + 2)
            for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Word starts and ends (positions in data) and the index of each row's first word.

    ``data`` holds the rows' bytes from 0, ``offsets`` their bounds. The third
    array has one entry more than there are rows.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over all bytes."""
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), the number of characters before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
