"""Vectorised text helpers on Arrow batches: word boundaries and 64-bit hashes.

A batch's texts lie in one UTF-8 byte array with document offsets, so a numpy call covers many
documents. All hashes are polynomial sums modulo 2**64 followed by a bit mixer; they depend on the
hashed bytes or words alone, never on their place.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A value for each byte, so that neighbouring byte values are far apart.
_BYTES = (np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=_U) << _U(29))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n; kept between calls up to a block."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    up, down = np.ones(n, _U), np.ones(n, _U)
    if n > 1:
        up[1:], down[1:] = _U(_BASE), _U(_INVERSE)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    if n <= 2 * BLOCK:
        _powers[:] = [up, down]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def give_back() -> None:
    """Hand freed memory back to the system at the end of a batch: workers live on, and what they hold adds up over stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this platform
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes as they are."""
    return _LOWER[raw]


def spans(raw: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per document): words between ASCII white space (``space``), or runs of
    digits, a-z and non-ASCII characters (``alnum``). No word crosses documents."""
    mask = ~_SPACE[raw] if kind == "space" else _ALNUM[raw]
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    edge = np.searchsorted(starts, offsets, "left")
    return starts, ends, np.diff(edge)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items; document borders are the caller's."""
    if len(items) < k:
        return np.zeros(0, _U)
    up, down = powers(len(items) + 1)
    total = np.zeros(len(items) + 1, _U)
    np.cumsum(items * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(items) - k + 1])


def range_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of items[start:end] for many ranges."""
    up, down = powers(len(items) + 1)
    total = np.zeros(len(items) + 1, _U)
    np.cumsum(items * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every ``width`` consecutive grams, the leftmost if equal, by doubling."""
    value, place = grams, np.arange(len(grams))

    def best(v, p, shift, n):
        right = v[shift : shift + n] < v[:n]
        return np.where(right, v[shift : shift + n], v[:n]), np.where(right, p[shift : shift + n], p[:n])

    span = 1
    while span < width and len(value):
        shift = min(span, width - span)
        value, place = best(value, place, shift, max(0, len(value) - shift))
        span += shift
    return place
