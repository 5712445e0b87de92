"""Elias-Fano coding of sorted integers in numpy, laid out in one byte string.

``n`` sorted values below ``u`` take about ``2 + log2(u / n)`` bits each: the low
bits of each value stand in a packed array, the high bits as gaps in a bit
vector (a one per value, a zero per step of the high part). ``Sequence`` reads
such a string, for instance a memory map of a file, and answers many successor
searches at once without decoding the sequence.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: values that a step works on at once: its temporary arrays do not grow with the sequence
AT_ONCE = 1 << 17


def pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """Values below 2**bits in ``bits`` bits each, in 64-bit words (one spare)."""
    n = len(values)
    words = np.zeros(n * bits // 64 + 2, U)
    if n == 0 or bits == 0:
        return words
    for lo in range(0, n, AT_ONCE):  # starts on a word's first bit
        part = values[lo:lo + AT_ONCE]
        at = np.arange(lo, lo + len(part), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(U)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
        over = np.where(shift > 0, part >> ((U(64) - shift) & U(63)), U(0))
        words[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    return words


def read_low(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if bits == 0:
        return np.zeros(len(index), U)
    at = index * bits
    word, shift = at >> 6, (at & 63).astype(U)
    over = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return ((words[word] >> shift) | over) & U((1 << bits) - 1)


def encode(values: np.ndarray, universe: int) -> bytes:
    """``values``: uint64, ascending, below ``universe``."""
    n = len(values)
    bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = pack_low(values & U((1 << bits) - 1), bits)
    length = n + (int(values[-1] >> U(bits)) if n else 0) + 1
    marks = np.zeros((length + 127) // 64 * 64, np.uint8)
    for lo in range(0, n, AT_ONCE):
        part = values[lo:lo + AT_ONCE]
        marks[(part >> U(bits)).astype(np.int64) + np.arange(lo, lo + len(part))] = 1
    vector = np.packbits(marks, bitorder="little").view(U)
    head = np.array([n, bits, len(low), len(vector)], np.int64)
    return head.tobytes() + low.tobytes() + vector.tobytes()


class Sequence:
    """Read side of ``encode``; ``data`` is any buffer, such as ``np.memmap``."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray | memoryview) else data
        self.n, self.bits, n_low, n_high = (int(x) for x in raw[:32].view(np.int64))
        self.low = raw[32:32 + 8 * n_low].view(U)
        self.high = raw[32 + 8 * n_low:32 + 8 * (n_low + n_high)].view(U)
        self.size = 32 + 8 * (n_low + n_high)
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        words = np.arange(1, len(ones) + 1, dtype=np.int64) << 6
        self._ones = np.concatenate([[0], ones])
        self._zeros = np.concatenate([[0], words - ones])

    @staticmethod
    def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Position of the r-th (from 0) one in each 64-bit word."""
        pos = np.zeros(len(word), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & U((1 << half) - 1)).astype(np.int64)
            up = r >= n
            r = r - n * up
            word = np.where(up, word >> U(half), word)
            pos += half * up
        return pos

    def _select(self, r: np.ndarray, zeros: bool) -> np.ndarray:
        directory = self._zeros if zeros else self._ones
        w = np.searchsorted(directory, r, side="right") - 1
        w = np.minimum(w, len(self.high) - 1)
        word = self.high[w]
        return (w << 6) + self._in_word(~word if zeros else word, r - directory[w])

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the positions ``index``."""
        high = self._select(index, False) - index
        return (high.astype(U) << U(self.bits)) | read_low(self.low, self.bits, index)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Position of the first value >= each of ``values`` (n where there is none)."""
        if self.n == 0:
            return np.zeros(len(values), np.int64)
        high = (values >> U(self.bits)).astype(np.int64)
        last = int(self._zeros[-1]) - 1
        top = high > last  # beyond the last high part that occurs
        h = np.where(top, last, high)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) + 1 - h, 0)
        hi = self._select(h, True) - h
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        want = values & U((1 << self.bits) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = read_low(self.low, self.bits, mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        lo[top] = self.n
        return lo

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each of ``values``, -1 where it isn't there."""
        out = np.full(len(values), -1, np.int64)
        for lo in range(0, len(values), AT_ONCE):
            part = values[lo:lo + AT_ONCE]
            at = self.successor(part)
            ok = np.flatnonzero(at < self.n)
            ok = ok[self.get(at[ok]) == part[ok]]
            out[lo + ok] = at[ok]
        return out
