"""Vectorised scans over Arrow text columns.

A batch of texts is one byte buffer with offsets. Everything here works on whole buffers with numpy, so no Python
object is made per word. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; a null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = U64(pow(base, done, 1 << 64))
            np.multiply(have[:done], step, out=have[done : 2 * done])
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows so that each piece holds about `most` bytes of the column, or one longer row."""
    _, at = text_buffer(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    edge[at] = True
    starts = np.flatnonzero(edge[:n] & solid)
    ends = np.flatnonzero(edge[1:] & solid) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; the hash of any span follows from two of its values."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(data * _powers_of(_BASE, len(data)) if len(data) else np.zeros(0, U64), out=out[1:])
    return out


def span_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, alike wherever the span stands."""
    raw = (running[ends] - running[starts]) * _powers_of(_INVERSE, len(running))[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words, one for each start that has them."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(size):
        total *= U64(0x2545F4914F6CDD1D)
        total += word_hashes[k : k + n]
    return mix(total)


def row_of(counts_before: np.ndarray) -> np.ndarray:
    """The row of each item, from the number of items before each row."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the rows' spans."""
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=running[1:], dtype=np.int64)
    return running[at[1:]] - running[at[:-1]]
