"""Vectorised words, windows and sets over Arrow text columns.

Texts are handled as the UTF-8 bytes of an Arrow array, many documents at a
time, in blocks of about ``BLOCK_BYTES`` so that memory stays bounded whatever
the batch holds; one longer text forms a block of its own and stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_WINDOW_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words in bytes that are not white space.
WORD = ~SPACE

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows; a null text is empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        pass_type = pa.large_string() if part.type != pa.large_string() else part.type
        part = pc.fill_null(part.cast(pass_type), "")
        start = 0
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None and part.buffers()[2].size else np.zeros(0, np.uint8)
        while start < len(part):
            stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), len(part))
            own = offsets[start : stop + 1]
            yield start, data[own[0] : own[-1]], own - own[0]
            start = stop


_power_cache = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _power_cache
    if len(_power_cache) < n:
        base = np.full(max(n, 256), _STEP, np.uint64)
        base[0] = 1
        _power_cache = np.multiply.accumulate(base)
    return _power_cache[:n]


class Words:
    """Words of a block: byte spans, 64-bit hashes and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, fold: np.ndarray = PLAIN):
        inside = kind[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before[firsts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lens = self.ends - self.starts
        self.lens = lens
        if len(lens):
            parts, lo = [], 0
            while lo < len(lens):  # runs of words of about BLOCK_BYTES, so that a long text needs no more at once
                hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + BLOCK_BYTES, "right")))
                run = slice(self.starts[lo], self.ends[hi - 1])
                own = lens[lo:hi]
                code = _BYTE_CODE[fold[data[run][inside[run]]]]
                at = np.cumsum(own) - own
                place = np.arange(len(code)) - np.repeat(at, own)
                code *= powers(int(own.max()) + 1)[place]
                parts.append(mix(np.add.reduceat(code, at) + own.astype(np.uint64) * _STEP))
                lo = hi
            self.hashes = np.concatenate(parts)
        else:
            self.hashes = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of each run of ``size`` words of a row."""
    total = len(words.hashes)
    n = total - size + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    rows = words.rows()
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words.hashes[j : n + j] * _WINDOW_CODE[j]
    ok = rows[:n] == rows[size - 1 :]
    at = np.flatnonzero(ok)
    return rows[at], at, mix(h[at])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted: (hashes of all rows, offsets by row).

    A row of fewer words, but not none, has one shingle: its whole sequence.
    """
    rows, _, h = windows(words, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            seq = words.hashes[words.first[r] : words.first[r + 1]]
            own[k] = (seq * _WINDOW_CODE[: len(seq)]).sum(dtype=np.uint64) ^ _BYTE_CODE[len(seq)]
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(own)])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
    n_rows = len(words.first) - 1
    return h, np.searchsorted(rows, np.arange(n_rows + 1))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over [offsets[i], offsets[i+1]), also where that is empty."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
