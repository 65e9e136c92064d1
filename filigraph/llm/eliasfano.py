"""Elias-Fano sequences over memory-mapped bytes, with vectorised select, access and search."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SEL = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SEL[_b, _k] = _i


def _select_in(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    parts = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_POP[parts], axis=1, dtype=np.uint8)
    k = k.astype(np.uint8)
    at = (upto <= k[:, None]).sum(1)
    row = np.arange(len(k))
    left = k - np.where(at > 0, upto[row, np.maximum(at, 1) - 1], 0).astype(np.uint8)
    return at * 8 + _SEL[parts[row, at], left]


def packed_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value in a row, lowest bit first, and eight spare bytes."""
    if not width:
        return bytes(8)
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out = [np.packbits(np.unpackbits(raw[k : k + (1 << 16)], axis=1, bitorder="little")[:, :width], bitorder="little").tobytes() for k in range(0, len(raw), 1 << 16)]
    return b"".join(out) + bytes(8)


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``: low parts of ``width`` bits, high parts in unary.

    Layout: int64 header (n, width, words); high words; ones and zeros before each
    word (32 bits each); low parts, bit-packed.  A sequence may have 2**31 members.
    """

    def __init__(self, raw: np.ndarray):
        self.n, self.width, m = (int(x) for x in raw[:24].view(np.int64))
        at = 24
        self.high = raw[at : (at := at + 8 * m)].view(np.uint64)
        self.ones = raw[at : (at := at + 4 * m)].view(np.uint32)
        self.zeros = raw[at : (at := at + 4 * m)].view(np.uint32)
        low = raw[at:]
        self.words = np.ndarray(len(low) - 7, "<u8", low.data, 0, (1,)) if self.width else None  # a word at every byte
        self.mask = np.uint64((1 << self.width) - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        w = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
        v = values.astype(np.uint64)
        bits = n + (universe >> w) + 2
        if bits >= 1 << 32:
            raise ValueError("too long a sequence for its 32-bit directories")
        m = (bits + 63) // 64
        flags = np.zeros(m * 64, np.uint8)
        flags[(v >> np.uint64(w)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        per = flags.reshape(-1, 64).sum(1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32)
        zeros = (np.arange(m, dtype=np.int64) * 64 - ones).astype(np.uint32)
        return np.array([n, w, m], np.int64).tobytes() + high.tobytes() + ones.tobytes() + zeros.tobytes() + packed_bits(v, w)

    def _select(self, directory: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(directory, k.astype(np.uint32), "right") - 1
        bits = self.high[word]
        return word * 64 + _select_in(~bits if flip else bits, k - directory[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        top = (self._select(self.ones, i, False) - i).astype(np.int64)
        return (top << self.width) | self._low(i).astype(np.int64) if self.width else top

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1: successor search among the values that share its high part."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = x >> self.width
        end = self._select(self.zeros, h, True) - h
        start = np.where(h > 0, self._select(self.zeros, np.maximum(h, 1) - 1, True) - (h - 1), 0)
        if not self.width:
            return np.where(start < end, start, -1)
        want = x.astype(np.uint64) & self.mask
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(start < end)
        lo, hi, w = start[live], end[live], want[live]
        while len(live):
            mid = (lo + hi) >> 1
            below = self._low(mid) < w
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
            done = lo >= hi
            if done.any():
                d, at = live[done], lo[done]
                ok = at < end[d]
                ok[ok] = self._low(at[ok]) == w[done][ok]
                out[d[ok]] = at[ok]
                live, lo, hi, w = live[~done], lo[~done], hi[~done], w[~done]
        return out
