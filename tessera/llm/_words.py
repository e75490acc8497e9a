"""Vectorised word and shingle hashing over Arrow string buffers.

No Python string is made per word: a slice of the column is one byte buffer,
words are found with a byte-class table, and every word's polynomial hash
comes out of one running sum (the multiplier is odd, so it has an inverse
modulo 2**64 and any sub-range of the sum can be brought to the same base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Byte classes: words are runs of non-space bytes, or runs of letters, digits and non-ASCII bytes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), on a fresh array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int, row_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``max_bytes`` each, a row's text and ``row_bytes`` for what it costs besides (one larger row is a run of its own)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row_bytes
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_array(column: pa.Array) -> pa.Array:
    """The column as strings without nulls (null reads as empty)."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string array without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of bytes."""
    running = np.zeros(len(data) + 1, U64)
    np.multiply(data.astype(U64) + U64(1), _powers(len(data), _BASE), out=running[1:])
    np.cumsum(running, out=running)
    hashed = (running[ends] - running[starts]) * _powers(len(data), _INVERSE)[starts]
    return mix(hashed ^ (ends - starts).astype(U64))


def words(column: pa.Array, classes: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words per row."""
    column = text_array(column)
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(max(rows, 0), np.int64)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = classes[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[:-1][cuts]  # a row begins a word of its own
    starts = np.flatnonzero(first)
    stop = inside[:-1] & ~inside[1:]
    stop[cuts - 1] = inside[:-1][cuts - 1]
    ends = np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return range_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows and the row of each; a row of fewer words is one window, a row without words has none."""
    begin = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[row]
    left = begin[row] + counts[row]
    out = np.zeros(len(at), U64)
    padded = np.concatenate([hashes, np.zeros(size, U64)])
    for k in range(size):
        w = padded[at + k]
        short = at + k >= left
        if short.any():
            w[short] = U64(0)
        out = (out ^ w) * U64(_BASE) + U64(k + 1)
        out ^= out >> U64(29)
    return mix(out), row


class SortedHash:
    """A sorted array of 64-bit hashes of exact keys, with a table of where each leading-bits bucket starts."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys.astype(U64))
        self.order = np.argsort(hashed)
        self.hashes = np.append(hashed[self.order], U64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, len(keys).bit_length())
        self.shift = U64(64 - bits)
        edges = np.arange(1 << bits, dtype=U64) << self.shift
        self.start = np.searchsorted(self.hashes[:-1], edges).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in sorted order, -1 where absent."""
        out = np.full(len(keys), -1, np.int32)
        if len(self.hashes) == 1:
            return out
        hashed = mix(keys)
        at = self.start[(hashed >> self.shift).astype(np.int64)]
        here = self.hashes[at]
        hit = (here == hashed) & (at < len(self.hashes) - 1)
        out[hit] = at[hit]
        live = np.flatnonzero(here < hashed)
        while len(live):
            at_live = at[live] + 1
            at[live] = at_live
            want, here = hashed[live], self.hashes[at_live]
            hit = (here == want) & (at_live < len(self.hashes) - 1)
            out[live[hit]] = at_live[hit]
            live = live[here < want]
        return out
