"""Entropy coders: Huffman trees and adaptive range coding of integers and bits."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping

from .codes import Bits, read, write

# Huffman -----------------------------------------------------------------------


def huffman_tree(weights: Mapping[int, int]):
    """A symbol, or a pair of trees.  Ties go to the tree whose smallest symbol is smallest; no symbols give None."""
    heap = [(n, s, s) for s, n in weights.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a[2], b[2])))
    return heap[0][2] if heap else None


def huffman_codes(tree) -> dict[int, str]:
    """Code words as text; a single symbol has an empty one."""
    out: dict[int, str] = {}
    todo = [(tree, "")] if tree is not None else []
    while todo:
        t, word = todo.pop()
        if isinstance(t, tuple):
            todo += [(t[0], word + "0"), (t[1], word + "1")]
        else:
            out[t] = word
    return out


def write_tree(w: Bits, tree, code: str = "gamma") -> None:
    """Pre-order: 0 for an inner node, 1 and the symbol for a leaf."""
    todo = [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            w.put(0, 1)
            todo += [t[1], t[0]]
        else:
            w.put(1, 1)
            write(w, t + 1, code)


def read_tree(r: Bits, code: str = "gamma"):
    stack: list[list] = []
    while True:
        if not r.take(1):
            stack.append([])
            continue
        t = read(r, code) - 1
        while stack:
            stack[-1].append(t)
            if len(stack[-1]) < 2:
                break
            t = tuple(stack.pop())
        else:
            return t


def write_huffman(w: Bits, symbols: Iterable[int], codes: Mapping[int, str]) -> None:
    for s in symbols:
        word = codes[s]
        w.put(int(word or "0", 2), len(word))


def read_huffman(r: Bits, tree, n: int) -> list[int]:
    out = []
    for _ in range(n):
        t = tree
        while isinstance(t, tuple):
            t = t[r.take(1)]
        out.append(t)
    return out


# numbers as tokens ---------------------------------------------------------------

SPLIT = 5  # numbers below 2**SPLIT are tokens of their own


def token(v: int) -> tuple[int, int, int]:
    """(token, raw bits, their number): small numbers are tokens; others give their length and next-to-highest bit."""
    if v < 1 << SPLIT:
        return v, 0, 0
    n = v.bit_length()
    raw = n - 2
    return (1 << SPLIT) + 2 * (n - SPLIT - 1) + (v >> raw & 1), v & ((1 << raw) - 1), raw


def untoken(t: int, take) -> int:
    if t < 1 << SPLIT:
        return t
    n, bit = (t - (1 << SPLIT)) // 2 + SPLIT + 1, (t - (1 << SPLIT)) & 1
    return (2 | bit) << (n - 2) | take(n - 2)


TOKENS = (1 << SPLIT) + 2 * (64 - SPLIT)


# range coding ----------------------------------------------------------------------


class _Model:
    """Adaptive frequencies of ``n`` symbols, halved when their sum is large."""

    def __init__(self, n: int, step: int, limit: int = 1 << 16):
        self.f, self.total, self.step, self.limit = [1] * n, n, step, limit

    def range(self, s: int) -> tuple[int, int]:
        return sum(self.f[:s]), self.f[s]

    def symbol(self, at: int) -> tuple[int, int, int]:
        low = 0
        for s, f in enumerate(self.f):
            if at < low + f:
                return s, low, f
            low += f
        raise ValueError("beyond the model")

    def saw(self, s: int) -> None:
        self.f[s] += self.step
        self.total += self.step
        if self.total > self.limit:
            self.f = [(f + 1) >> 1 for f in self.f]
            self.total = sum(self.f)


class RangeEncoder:
    """Carry-free range coder on 32 bits, byte by byte."""

    def __init__(self):
        self.low, self.width, self.out = 0, 0xFFFFFFFF, bytearray()

    def encode(self, low: int, size: int, total: int) -> None:
        self.width //= total
        self.low += low * self.width
        self.width *= size
        while True:
            if (self.low ^ (self.low + self.width)) < 1 << 24:
                pass
            elif self.width < 1 << 16:
                self.width = -self.low & 0xFFFF
            else:
                return
            self.out.append(self.low >> 24 & 0xFF)
            self.low, self.width = self.low << 8 & 0xFFFFFFFF, self.width << 8 & 0xFFFFFFFF

    def raw(self, v: int, bits: int) -> None:
        while bits:
            k = min(8, bits)
            bits -= k
            self.encode(v >> bits & ((1 << k) - 1), 1, 1 << k)

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24 & 0xFF)
            self.low = self.low << 8 & 0xFFFFFFFF
        return bytes(self.out)


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.width, self.code = data, 0, 0, 0xFFFFFFFF, 0
        for _ in range(4):
            self.code = self.code << 8 | self._byte()

    def _byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def place(self, total: int) -> int:
        self.width //= total
        return min((self.code - self.low & 0xFFFFFFFF) // self.width, total - 1)

    def took(self, low: int, size: int) -> None:
        self.low = self.low + low * self.width & 0xFFFFFFFF
        self.width *= size
        while True:
            if (self.low ^ (self.low + self.width)) < 1 << 24:
                pass
            elif self.width < 1 << 16:
                self.width = -self.low & 0xFFFF
            else:
                return
            self.code = (self.code << 8 | self._byte()) & 0xFFFFFFFF
            self.low, self.width = self.low << 8 & 0xFFFFFFFF, self.width << 8 & 0xFFFFFFFF

    def raw(self, bits: int) -> int:
        v = 0
        while bits:
            k = min(8, bits)
            bits -= k
            at = self.place(1 << k)
            self.took(at, 1)
            v = v << k | at
        return v


class _Contexts:
    """Models by the place in a list (first four apart) and the size of the number before."""

    def __init__(self):
        self.models: dict[tuple[int, int], _Model] = {}
        self.reset()

    def reset(self) -> None:
        """A new list begins; what was learnt stays."""
        self.place, self.before = 0, 0

    def model(self) -> _Model:
        return self.models.setdefault((min(self.place, 3), min(self.before, 24)), _Model(TOKENS, 32))

    def saw(self, v: int) -> None:
        self.place, self.before = self.place + 1, v.bit_length()


class NumberEncoder:
    """Adaptive range coding of non-negative integers."""

    def __init__(self):
        self.contexts, self.coder = _Contexts(), RangeEncoder()

    def put(self, v: int) -> None:
        t, raw, bits = token(v)
        m = self.contexts.model()
        self.coder.encode(*m.range(t), m.total)
        m.saw(t)
        self.coder.raw(raw, bits)
        self.contexts.saw(v)

    def finish(self) -> bytes:
        return self.coder.finish()


class NumberDecoder:
    def __init__(self, data: bytes):
        self.contexts, self.coder = _Contexts(), RangeDecoder(data)

    def take(self) -> int:
        m = self.contexts.model()
        t, low, size = m.symbol(self.coder.place(m.total))
        self.coder.took(low, size)
        m.saw(t)
        v = untoken(t, self.coder.raw)
        self.contexts.saw(v)
        return v


class BitEncoder:
    """Adaptive coding of bits in the context of the bit before."""

    def __init__(self):
        self.models, self.coder, self.before = (_Model(2, 24), _Model(2, 24)), RangeEncoder(), 0

    def put(self, b: bool) -> None:
        m = self.models[self.before]
        self.coder.encode(*m.range(int(b)), m.total)
        m.saw(int(b))
        self.before = int(b)

    def finish(self) -> bytes:
        return self.coder.finish()


class BitDecoder:
    def __init__(self, data: bytes):
        self.models, self.coder, self.before = (_Model(2, 24), _Model(2, 24)), RangeDecoder(data), 0

    def take(self) -> bool:
        m = self.models[self.before]
        s, low, size = m.symbol(self.coder.place(m.total))
        self.coder.took(low, size)
        m.saw(s)
        self.before = s
        return bool(s)
