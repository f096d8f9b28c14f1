"""Words and their hashes for whole columns of text at once.

The functions work on the bytes of an Arrow text column with numpy, so that a task
never makes a Python object per word.  All of them take blocks of a few MB, which
bounds what a task holds whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_PIECE_BYTES = 512 << 10

_RNG = np.random.Generator(np.random.PCG64(20260101))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """A table of 256 truth values: the bytes inside the given ranges, ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if inverse else table


# Words are runs of bytes of these classes; bytes of 0x80 and more are parts of
# characters beyond ASCII and always belong to a word.
NOT_SPACE = byte_class((0x09, 0x0D), (0x20, 0x20), inverse=True)
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


@dataclass(frozen=True)
class Block:
    """Some rows of a text column: their bytes, and where each row starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a text column in blocks of up to `limit` bytes, or of one row.

    Null rows have no bytes.
    """
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    every = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)
    offsets = every[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        start, end = offsets[first], offsets[last]
        yield Block(first, data[start:end], offsets[first : last + 1] - start)
        first = last


def _powers(count: int, base: int) -> np.ndarray:
    powers = np.empty(count, np.uint64)
    powers[0] = 1
    filled = 1
    while filled < count:
        step = min(filled, count - filled)
        powers[filled : filled + step] = powers[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return powers


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of a block: byte positions, row within the block, and a 64-bit hash."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # per row, the index of its first word; one entry more than rows

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _long_sum(data: np.ndarray, value: np.ndarray, powers: np.ndarray) -> np.uint64:
    """The polynomial of some bytes, of any number, a piece at a time."""
    total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = np.uint64(pow(_BASE, _PIECE_BYTES, 1 << 64))
    for low in range(0, len(data), _PIECE_BYTES):
        piece = value[data[low : low + _PIECE_BYTES]]
        total += factor * np.sum(piece * powers[: len(piece)], dtype=np.uint64)
        factor *= step
    return total[0]


def words_of(block: Block, kind: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """All words of a block; `fold` maps each byte before it is looked at."""
    data, offsets = block.data, block.offsets
    inside = kind[fold][data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    del before, after
    hashes = np.empty(len(starts), np.uint64)
    value = _BYTE_VALUE[fold]
    most = min(_PIECE_BYTES, len(data)) + 1
    powers, inverse = _powers(most, _BASE), _powers(most, pow(_BASE, -1, 1 << 64))
    for low in range(0, len(data), _PIECE_BYTES):
        high = min(low + _PIECE_BYTES, len(data))
        a, b = np.searchsorted(starts, (low, high))
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value[data[low:high]] * powers[: high - low], out=sums[1:])
        # The last word of a piece may run on.
        c = b - 1 if a < b and ends[b - 1] > high else b
        s, e = starts[a:c] - low, ends[a:c] - low
        hashes[a:c] = (sums[e] - sums[s]) * inverse[s]
        for i in range(c, b):
            hashes[i] = _long_sum(data[starts[i] : ends[i]], value, powers)
    hashes = mixed(hashes + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(starts, ends, rows, hashes, first)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, by doubling; empty if there are too few."""
    if length < 1 or len(hashes) < length:
        return np.zeros(0, np.uint64)
    result, done = None, 0
    power, size = hashes, 1
    rest = length
    while rest:
        if rest & 1:
            if result is None:
                result, done = power, size
            else:
                tail = power[done:]
                kept = min(len(result), len(tail))
                factor = np.uint64(pow(_WINDOW_BASE, size, 1 << 64))
                result, done = result[:kept] * factor + tail[:kept], done + size
        rest >>= 1
        if rest:
            factor = np.uint64(pow(_WINDOW_BASE, size, 1 << 64))
            power, size = power[:-size] * factor + power[size:], size * 2
    return mixed(result[: len(hashes) - length + 1])


def within_row(rows: np.ndarray, length: int) -> np.ndarray:
    """For each run of `length` words: does it lie in one row?"""
    if len(rows) < length:
        return np.zeros(0, bool)
    return rows[: len(rows) - length + 1] == rows[length - 1 :]
