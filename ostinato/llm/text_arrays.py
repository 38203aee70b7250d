"""Vectorised hashing of words and spans over Arrow string columns.

All functions work on one flat array of UTF-8 bytes and on offsets into it, so a batch of texts costs a few passes
of numpy and no loop over words. Batches are cut by bytes (see ``slices``), so memory doesn't follow the longest batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled whole.
SLICE_BYTES = 1 << 18
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(lower: bool) -> np.ndarray:
    """A random 64-bit number for each byte; with ``lower``, A-Z share those of a-z."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    if lower:
        out[65:91] = out[97:123]
    return out


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            made = []
            for base in (self.base, self.inverse):
                out = np.ones(size, dtype=np.uint64)
                done, factor = 1, base
                while done < size:
                    out[done : 2 * done] = out[:done] * np.uint64(factor)
                    done, factor = 2 * done, factor * factor & _MASK
                made.append(out)
            self.up, self.down = made
        return self.up[:n], self.down[:n]


powers = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one running polynomial sum."""
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows first..end in those bytes); a null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind, word = pa.large_string(), np.int64
    else:
        column, kind, word = column.cast(pa.string()), pa.string(), np.int32
    if column.null_count:
        column = pa.compute.fill_null(column, pa.scalar("", kind))
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=word)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without \\x20 and \\x09-\\x0D), and for each row the number of its first word."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    left = np.zeros(len(data) + 1, dtype=bool)
    left[offsets[offsets < len(data)]] = True  # a word never crosses into the next text
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | left[: len(data)]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | left[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose words are hashes[first[i]:first[i + 1]]: the hashes of all runs of ``size`` words, and each one's row.

    A row of fewer words has its whole sequence as its only run; a row without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    total = np.zeros(len(row), dtype=np.uint64)
    for k in range(size):
        use = k < n[row]
        value = hashes[np.where(use, at + k, 0)] if len(hashes) else np.zeros(len(row), np.uint64)
        total = mix(total * np.uint64(3) + np.where(use, value, np.uint64(0)) + np.uint64(k + 1))
    return total, row


def set_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs sorted by row and hash, and the row bounds within them."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    if len(h):
        keep = np.empty(len(h), dtype=bool)
        keep[0] = True
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[keep], r[keep]
    return h, r, np.searchsorted(r, np.arange(n_rows + 1), side="left")
