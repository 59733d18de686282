"""Whole batches of texts as byte arrays: words, hashes and offsets without a loop per word.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a
run of such characters. Texts of an Arrow batch lie in one buffer, so splitting, lower-casing
(A-Z) and hashing are array operations over that buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Texts of at most this many bytes are worked on together; a longer text stands alone.
SLICE_BYTES = 1 << 19
# Multiplier of the word hash, odd so that it can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 2
MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# A random number for each byte value, the same in every process.
BYTE_CODE = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


class _Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def upto(self, n):
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 64)
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, U64(factor))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def mix(x):
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def slices(column, max_bytes=SLICE_BYTES):
    """Cut a string array into (first row, array) pieces of about max_bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, before + max_bytes, "right"))
        last = max(last, first + 1)
        yield first, column.slice(first, last - first)
        first = last


def buffer_of(column):
    """The bytes of a string array without nulls, and the offsets of its rows in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def edges_of(inside, offsets):
    """Starts and ends of the runs of True within rows."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = inside & (~before | cut[:n])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = inside & (~after | cut[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words_in(data, offsets):
    """Starts and ends of all words, and how many each row has."""
    starts, ends = edges_of(~SPACE[data], offsets)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data, starts, ends):
    """A 64-bit hash of each span of bytes, from running sums of byte codes times powers."""
    up, down = POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def hashed_words(column, lower=True):
    """Hashes of all words of a string array (without nulls) and the number of words per row."""
    data, offsets = buffer_of(column)
    if lower:
        data = LOWER[data]
    starts, ends, counts = words_in(data, offsets)
    return hash_spans(data, starts, ends), counts


def byte_runs(data, offsets, width):
    """All runs of two or four bytes inside rows, as numbers in text order, and the runs per row."""
    kind = {2: "<u2", 4: "<u4"}[width]
    total = max(len(data) - width + 1, 0)
    runs = np.ndarray(total, kind, np.ascontiguousarray(data), strides=(1,)) if total else np.zeros(0, kind)
    inside = np.ones(total, bool)
    for back in range(1, width):  # runs that reach into the next row
        at = offsets[1:] - back
        inside[at[(at >= offsets[:-1]) & (at >= 0) & (at < total)]] = False
    return runs[inside], np.maximum(np.diff(offsets) - width + 1, 0)


def combine(left, right):
    """Hash of an ordered pair of hashes."""
    return mix(left * U64(0x9FB21C651E98DF25) + right)


def group_starts(counts):
    """First position of each row's run when rows have the given counts."""
    return np.cumsum(counts) - counts


def sums_per_row(values, counts):
    """Sum of each row's run of values; rows may be empty. Values may have a second axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
