"""Words and hashes of many texts at once, as numpy arrays over their bytes.

An Arrow string column already holds its texts as one byte buffer with
offsets.  Everything here works on such a buffer, a chunk of CHUNK_BYTES at a
time, so memory does not depend on the size of a batch (a longer single
text is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown as needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 14)
            ones = np.full(self.n, _BASE, np.uint64), np.full(self.n, _INVERSE, np.uint64)
            ones[0][0] = ones[1][0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in ones)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of ``symbols`` (random 64-bit
    values): equal runs have equal hashes wherever they stand."""
    up, down = _powers.upto(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


# fixed values: blank and \t \n \v \f \r separate words
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of parts of a string
    column; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        to = min(max(to, row + 1), len(texts))
        yield row, to, data[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text's end: starts, ends
    and the number of the text each is in."""
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside.copy()
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside.copy()
    first = offsets[:-1]
    before[first[first < len(inside)]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
