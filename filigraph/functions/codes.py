"""Integer codes: bit lengths and code words as column expressions, and bit-exact kernels.

Lengths are closed forms, so costs of whole graphs are one aggregation.  Codes
for positive integers give null for 0 and below.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

FIBONACCI = [1, 2]
while FIBONACCI[-1] < 1 << 62:
    FIBONACCI.append(FIBONACCI[-1] + FIBONACCI[-2])


def bit_length(v: Column) -> Column:
    """Bits of v >= 1 in binary."""
    return F.length(F.bin(v))


def unary(v: Column) -> Column:
    return v + 1


def gamma(v: Column) -> Column:
    return F.when(v >= 1, 2 * bit_length(v) - 1)


def delta(v: Column) -> Column:
    n = bit_length(v)
    return F.when(v >= 1, 2 * bit_length(n) - 1 + n - 1)


def fibonacci(v: Column) -> Column:
    """Zeckendorf digits and a closing 1: one more than the Fibonacci numbers (1, 2, 3, 5, ...) up to v."""
    table = F.array(*[F.lit(f) for f in FIBONACCI[:60]])
    return F.when(v >= 1, F.size(F.filter(table, lambda f: f <= v)) + 1)


def truncated_binary(v: Column, n: Column) -> Column:
    """Phase-in code of [0, n)."""
    k = bit_length(n) - 1
    return F.when((n >= 1) & (v >= 0) & (v < n), F.when(v < F.shiftleft(F.lit(1).cast("long"), 1) * F.pow(2, k).cast("long") - n, k).otherwise(k + 1))


def zeta(v: Column, k: int = 3) -> Column:
    """Unary block number h = floor(log2 v / k), then truncated binary inside the block."""
    h = F.floor((bit_length(v) - 1) / k).cast("int")
    low = F.pow(F.lit(2.0), h * k).cast("long")
    return F.when(v >= 1, h + 1 + truncated_binary(v - low, low * (2**k - 1)))


def golomb(v: Column, b: int = 64) -> Column:
    return F.when(v >= 0, F.floor(v / b) + 1 + max(0, (b - 1).bit_length()))


def rice(v: Column, k: int) -> Column:
    return F.when(v >= 0, F.shiftright(v, k) + 1 + k)


def fed(v: Column, block: int = 64) -> Column:
    """Delta of the block number + 1, Fibonacci of the place in the block + 1."""
    return F.when(v >= 0, delta(F.floor(v / block) + 1) + fibonacci(v % block + 1))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.shiftright(v, 1)).otherwise(-F.shiftright(v + 1, 1))


def small_count(v: Column, code: str = "fibonacci") -> Column:
    """Two bits for 0, 1, 2; others follow an escape of two."""
    return F.when(v < 3, 2).otherwise(2 + length(v, code))


def elias_fano(n: Column, top: Column) -> Column:
    """A non-decreasing list of ``n`` members, the last of which is ``top``: length, low width, low parts, unary high parts."""
    low = F.when(n > 1, F.greatest(bit_length(F.greatest(F.floor((top + 1) / n), F.lit(1))) - 1, F.lit(0))).otherwise(0)
    return F.when(n == 0, 1).otherwise(gamma(n + 1) + gamma(low + 1) + n * low + n + F.floor(top / F.pow(F.lit(2.0), low)))


def length(v: Column, code: str, **p) -> Column:
    table = {"unary": unary, "gamma": gamma, "delta": delta, "fibonacci": fibonacci, "zeta": zeta, "golomb": golomb, "rice": rice, "fed": fed}
    return table[code](v, **p).cast("long")


def gamma_word(v: Column) -> Column:
    return F.when(v >= 1, F.concat(F.repeat(F.lit("0"), bit_length(v) - 1), F.bin(v)))


def delta_word(v: Column) -> Column:
    return F.when(v >= 1, F.concat(gamma_word(bit_length(v)), F.substring(F.bin(v), F.lit(2), bit_length(v))))


# bit-exact kernels ---------------------------------------------------------


class Bits:
    """A growing string of bits, most significant first; reads move ``at`` on."""

    def __init__(self, data: bytes | None = None, size: int | None = None):
        self._parts: list[str] = []
        self._size, self.at = 0, 0
        if data:
            text = bin(int.from_bytes(b"\x01" + data))[3:][:size]
            self._parts, self._size = [text], len(text)

    def __len__(self) -> int:
        return self._size

    @property
    def text(self) -> str:
        if len(self._parts) != 1:
            self._parts = ["".join(self._parts)]
        return self._parts[0]

    @property
    def bits(self) -> list[int]:
        return list(map(int, self.text))

    def put(self, value: int, width: int) -> None:
        if width:
            self._parts.append(f"{value & ((1 << width) - 1):0{width}b}")
            self._size += width

    def extend(self, other: Bits) -> None:
        self._parts.append(other.text)
        self._size += len(other)

    def take(self, width: int) -> int:
        end = self.at + width
        if end > self._size:
            raise EOFError("out of bits")
        v = int(self.text[self.at : end] or "0", 2)
        self.at = end
        return v

    def zeros(self) -> int:
        """Zeros up to the next one, which is taken too."""
        one = self.text.find("1", self.at)
        if one < 0:
            raise EOFError("out of bits")
        n, self.at = one - self.at, one + 1
        return n

    def bytes(self) -> bytes:
        n = -(-self._size // 8)
        return (int(self.text or "0", 2) << (8 * n - self._size)).to_bytes(n) if n else b""


def _positive(v: int) -> None:
    if v < 1:
        raise ValueError("only positive integers have a code word")


@functools.lru_cache(1 << 17)
def _word(v: int, code: str) -> str:
    w = Bits()
    _write(w, v, code)
    return w.text


def write(w: Bits, v: int, code: str, **p) -> None:
    """Append the code word of a number; words of small numbers are kept."""
    if p or not 0 <= v < 1 << 16:
        _write(w, v, code, **p)
    else:
        word = _word(v, code)
        w._parts.append(word)
        w._size += len(word)


def _write(w: Bits, v: int, code: str, **p) -> None:
    if code == "unary":
        w.put(0, v), w.put(1, 1)
    elif code == "gamma":
        _positive(v)
        w.put(0, v.bit_length() - 1), w.put(v, v.bit_length())
    elif code == "delta":
        _positive(v)
        n = v.bit_length()
        write(w, n, "gamma")
        w.put(v & ((1 << (n - 1)) - 1), n - 1)
    elif code == "fibonacci":
        _positive(v)
        digits, started = [], False
        for f in reversed(FIBONACCI):
            if f <= v:
                v -= f
                digits.append(1)
                started = True
            elif started:
                digits.append(0)
        for d in reversed(digits):
            w.put(d, 1)
        w.put(1, 1)
    elif code == "zeta":
        _positive(v)
        k = p.get("k", 3)
        h = (v.bit_length() - 1) // k
        w.put(0, h), w.put(1, 1)
        write_truncated(w, v - (1 << h * k), (1 << h * k) * ((1 << k) - 1))
    elif code == "golomb":
        b = p.get("b", 64)
        write(w, v // b, "unary")
        w.put(v % b, (b - 1).bit_length())
    elif code == "rice":
        write(w, v >> p["k"], "unary")
        w.put(v & ((1 << p["k"]) - 1), p["k"])
    elif code == "fed":
        b = p.get("block", 64)
        write(w, v // b + 1, "delta")
        write(w, v % b + 1, "fibonacci")
    else:
        raise ValueError(f"unknown code {code!r}")


def read(r: Bits, code: str, **p) -> int:
    if code == "unary":
        return r.zeros()
    if code == "gamma":
        n = r.zeros()
        return 1 << n | r.take(n)
    if code == "delta":
        n = read(r, "gamma")
        return 1 << (n - 1) | r.take(n - 1)
    if code == "fibonacci":
        v, last = 0, 0
        for f in FIBONACCI:
            b = r.take(1)
            if b and last:
                return v
            v, last = v + f * b, b
        raise ValueError("no end of a code word")
    if code == "zeta":
        k = p.get("k", 3)
        h = r.zeros()
        return (1 << h * k) + read_truncated(r, (1 << h * k) * ((1 << k) - 1))
    if code == "golomb":
        b = p.get("b", 64)
        q = r.zeros()
        return q * b + r.take((b - 1).bit_length())
    if code == "rice":
        q = r.zeros()
        return q << p["k"] | r.take(p["k"])
    if code == "fed":
        b = p.get("block", 64)
        q = read(r, "delta") - 1
        return q * b + read(r, "fibonacci") - 1
    raise ValueError(f"unknown code {code!r}")


def write_truncated(w: Bits, v: int, n: int) -> None:
    if not 0 <= v < n:
        raise ValueError("value outside its range")
    k = n.bit_length() - 1
    u = (1 << (k + 1)) - n
    w.put(v, k) if v < u else w.put(v + u, k + 1)


def read_truncated(r: Bits, n: int) -> int:
    k = n.bit_length() - 1
    u = (1 << (k + 1)) - n
    v = r.take(k)
    return v if v < u else (v << 1 | r.take(1)) - u
