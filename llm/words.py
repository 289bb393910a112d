"""Words and word n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A word is a longest run of bytes other than space and tab to carriage return. Hashes are polynomials
modulo 2**64 over random bytes, mixed; they depend on the words only, not on their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; a longer text is handled alone.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        made = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[kind] = (made[0], made[1])
    return _powers[kind][0][:n], _powers[kind][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: `first[d]` to `first[d + 1]` are those of text d."""

    data: np.ndarray  # bytes of all texts, one after the other
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """A hash for the n words from each word on; the last ones of a text run into the next."""
        m = len(self.hashes)
        if m < n:
            return np.zeros(0, np.uint64)
        up, down = _power("word", m)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(self.hashes * up, out=total[1:])
        return mix((total[n:] - total[: m - n + 1]) * down[: m - n + 1])

    def text(self, a: int, b: int) -> bytes:
        """Words a to b of all, joined by one space."""
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    size = len(data)
    space = _SPACE[data]
    opens, closes = np.ones(size, bool), np.ones(size, bool)
    opens[1:], closes[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    opens[edges], closes[edges - 1] = True, True
    starts = np.flatnonzero(opens & ~space)
    ends = np.flatnonzero(closes & ~space) + 1
    up, down = _power("byte", size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) over a batch; null texts have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, words_of(_LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi
