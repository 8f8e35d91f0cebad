"""Words and pre-tokens of whole Arrow string columns as numpy arrays, without Python strings.

A column becomes one byte buffer with row offsets. Pieces of the buffer are hashed from running sums of
byte values times powers of an odd number, all modulo 2^64, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidra.llm.common import mixed

#: A batch is cut to slices of about this many bytes; arrays of eight bytes a character are made of them.
SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_STEP = 2048


def _powers(base: int) -> list[np.ndarray]:
    small, x = [], 1
    for _ in range(_STEP):
        small.append(x)
        x = x * base % (1 << 64)
    large, y = [], 1
    for _ in range(1 << 15):
        large.append(y)
        y = y * x % (1 << 64)
    return [np.array(small, np.uint64), np.array(large, np.uint64)]


def _reach(powers: list[np.ndarray], n: int) -> None:
    """Double the large steps until they reach byte ``n``; 64 MB are there from the start."""
    while len(powers[1]) <= n // _STEP:
        large = powers[1]
        powers[1] = np.concatenate([large, large * (large[-1:] * large[1:2])])


_UP, _DOWN = _powers(_ODD), _powers(_INVERSE)
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32
VALUES_LOWER = _VALUES[_LOWERED]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Texts:
    """Row i is ``raw[start[i]:start[i + 1]]``; null rows are empty."""

    raw: np.ndarray
    start: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.start) - 1


def texts_of(column: pa.Array) -> Texts:
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in runs of rows with about ``most`` bytes of ``column``; one long row stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Hasher:
    """Hashes of substrings of a buffer."""

    def __init__(self, raw: np.ndarray, values: np.ndarray = _VALUES):
        n = len(raw)
        _reach(_UP, n)
        _reach(_DOWN, n)
        with np.errstate(over="ignore"):
            powers = (_UP[1][: n // _STEP + 1, None] * _UP[0][None, :]).ravel()[:n]
            powers *= values[raw]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(powers, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            back = _DOWN[0][start % _STEP] * _DOWN[1][start // _STEP]
            return mixed((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of all rows in order: byte range, hash, and how many each row has."""

    start: np.ndarray
    end: np.ndarray
    hashed: np.ndarray
    count: np.ndarray


def words_of(texts: Texts, values: np.ndarray = VALUES_LOWER, blank: np.ndarray = _BLANK) -> Words:
    raw = texts.raw
    inside = ~blank[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[texts.start] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    start = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    end = np.flatnonzero(ends) + 1
    count = np.diff(np.searchsorted(start, texts.start))
    return Words(start, end, Hasher(raw, values).of(start, end), count)


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, rows one after another, and their number a row.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    h, n = words.hashed, words.count
    ends = np.cumsum(n)
    begin = ends - n
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for i in range(k):
            whole = whole * np.uint64(_ODD) + mixed(h[i : len(h) - k + 1 + i] + np.uint64(i + 1)) if len(whole) else whole
        whole = mixed(whole + np.uint64(k))
        sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        out = np.zeros(int(sizes.sum()), np.uint64)
        to = np.cumsum(sizes) - sizes
        full = np.repeat(n >= k, sizes)
        where = np.arange(len(out)) - np.repeat(to, sizes) + np.repeat(begin, sizes)
        out[full] = whole[where[full]]
        for r in np.flatnonzero((n > 0) & (n < k)):
            x = np.uint64(0)
            for i in range(n[r]):
                x = x * np.uint64(_ODD) + mixed(h[begin[r] + i : begin[r] + i + 1] + np.uint64(i + 1))[0]
            out[to[r]] = mixed(np.array([x + np.uint64(n[r])], np.uint64))[0]
    return out, sizes
