"""Words and their 64-bit hashes over a whole batch of texts at once, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. UTF-8 never uses those bytes inside a longer
character, so the runs are exactly the matches of ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20_240_607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 17
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def joined_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return buf, at - at[0]


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the texts."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_SPACE[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z. Works in blocks, so memory does not follow the text."""
    out = np.empty(len(starts), np.uint64)
    codes = _CODE_LOWER if lower else _CODE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[buf[low:high]] * _power(_BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _power(_BASE_INVERSE, high - low + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive word hashes; the caller drops those that cross texts."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    steps, total, power = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64), 1
    if n <= 8:
        for j in range(n):
            total += h[j : j + steps] * _U(power)
            power = power * _BASE % 2**64
        return mixed(total + _U(n))
    out = np.empty(steps, np.uint64)
    for i in range(0, steps, _BLOCK):  # prefix sums, each block with powers of its own
        part = h[i : i + _BLOCK + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
        m = len(part) - n + 1
        out[i : i + m] = (sums[n:] - sums[:m]) * _power(_BASE_INVERSE, m)
    return mixed(out + _U(n))


def shingle_sets(buf: np.ndarray, at: np.ndarray, n: int, lower: bool = True):
    """Yields for each text the sorted distinct hashes of its n-word shingles; fewer words count as one shingle."""
    starts, ends, bound = words(buf, at)
    h = word_hashes(buf, starts, ends, lower)
    rolled = rolling(h, n)
    for i in range(len(at) - 1):
        a, b = int(bound[i]), int(bound[i + 1])
        if b - a >= n:
            yield distinct(rolled[a : b - n + 1])
        elif b > a:
            yield rolling(h[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cuts a batch into runs of rows whose texts take about ``most`` bytes, so that work arrays stay small."""
    text = batch.column(column)
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)) if len(text) else np.empty(0, np.int64)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
    trim()


def trim() -> None:
    """Gives memory that is free inside the process back to the machine: Arrow's, and with glibc also numpy's and Python's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
