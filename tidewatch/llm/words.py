"""Vectorised word splitting and hashing over Arrow string columns (numpy, inside tasks).

Everything works on the UTF-8 bytes of a slice of rows at once, so the cost is a
few nanoseconds a byte and the memory is bounded by the slice, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer row is handled alone.
SLICE_BYTES = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that sums of hashes spread over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = _seeded(256, 7)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        _powers[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
SAME = np.arange(256, dtype=np.uint8)


def _separators(keep) -> np.ndarray:
    return np.array([not keep(b) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
BY_SPACE = _separators(lambda b: not (b == 32 or 9 <= b <= 13))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
BY_ALNUM = _separators(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


@dataclass
class Words:
    """Words of rows `lo` to `hi` of an array, in order. first: index of each row's first word, and the end."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    row_bytes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(column, separators: np.ndarray, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[Words]:
    data, offsets = text_buffers(column)
    table = LOWER if lower else SAME
    for lo, hi in slices(offsets, most):
        a, b = int(offsets[lo]), int(offsets[hi])
        part = table[data[a:b]]
        rows = (offsets[lo : hi + 1] - a).astype(np.int64)
        word = ~separators[part]
        n = len(part)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        edge = rows[:-1][rows[:-1] < n]
        before[edge] = False
        edge = rows[1:][rows[1:] > 0] - 1
        after[edge] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = _power_table(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[part] * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
        yield Words(lo, hi, hashes, np.searchsorted(starts, rows), starts, ends, part, rows)


def chain(hashes: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each of `starts` on (default: each word that has n-1 after it)."""
    if starts is None:
        starts = np.arange(max(0, len(hashes) - n + 1))
    out = np.full(len(starts), 0x243F6A8885A308D3, U64)
    for k in range(n):
        out = mix(out + hashes[starts + k] * U64(0x9E3779B97F4A7C15 + 2 * k))
    return out


def hash_text(text: str) -> int:
    """The hash that split_words gives one word."""
    found = next(split_words(pa.array([text]), BY_SPACE, lower=False))
    return int(found.hashes[0])
