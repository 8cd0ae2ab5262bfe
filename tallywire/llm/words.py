"""Words of whole texts as 64-bit hashes, for a batch of texts at once.

Texts are UTF-8, only A-Z are lower-cased, and a word is a run of bytes other than
0x20 and 0x09-0x0D. Those bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are handled in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits parts words here.
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@dataclass
class Words:
    """Words of a run of texts; those of text i are at ``first[i]:first[i + 1]``."""

    data: np.ndarray  # lower-cased bytes of all texts of the run
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    lo: int  # texts lo:hi of the batch
    hi: int

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


class Reader:
    """Cuts batches of texts into words at ``blank`` bytes; keeps tables between batches."""

    def __init__(self, blank: np.ndarray = BLANK) -> None:
        self.size, self.blank = 0, blank
        self.up = self.down = np.empty(0, dtype=U)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, RUN_BYTES)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INVERSE, self.size)

    def runs(self, texts: pa.Array) -> Iterator[Words]:
        """The words of each run of a batch; a null text is empty."""
        data, offsets = buffer_of(texts)
        for lo, hi in spans(offsets):
            yield self.words(LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1], lo)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, wherever they lie."""
        n = len(data)
        self._grow(n)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE[data] * self.up[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(hashes + (ends - starts).astype(U) * U(0xA0761D6478BD642F))

    def words(self, data: np.ndarray, offsets: np.ndarray, lo: int) -> Words:
        n = len(data)
        bounds = offsets - offsets[0]
        inside = ~self.blank[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        hashes = self.hashes(data, starts, ends)
        first = np.searchsorted(starts, bounds)
        return Words(data, starts, ends, hashes, first, lo, lo + len(offsets) - 1)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls become empty."""
    texts = pa.array(texts) if not isinstance(texts, pa.Array) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data, offsets


def spans(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list array from values and the lengths of its lists."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
