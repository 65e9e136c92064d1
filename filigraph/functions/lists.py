"""Bit-exact codecs of sorted id lists, bitmaps, counts and permutations, over ``codes.Bits``.

Every ``write_x`` has its ``read_x``; ``cost(f, ...)`` gives the exact bits that a
writer would take.  Lists are strictly ascending non-negative integers.  A ``near``
id makes a list's first value relative to it (zigzag), which is short for local links.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .codes import Bits, read, read_truncated, write, write_truncated


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(v: int) -> int:
    return v >> 1 if v % 2 == 0 else -(v + 1 >> 1)


def cost(f: Callable, *args, **how) -> int:
    """The bits that ``f(w, ...)`` writes."""
    w = Bits()
    f(w, *args, **how)
    return len(w)


# counts ------------------------------------------------------------------------


def write_small(w: Bits, v: int, code: str = "fibonacci") -> None:
    """0, 1 and 2 take two bits; others follow two ones."""
    w.put(min(v, 3), 2)
    if v > 2:
        write(w, v, code)


def read_small(r: Bits, code: str = "fibonacci") -> int:
    v = r.take(2)
    return v if v < 3 else read(r, code)


def write_vector(w: Bits, values: Sequence[int], b: int = 4) -> None:
    """A dense vector of small numbers, by Golomb."""
    write(w, len(values) + 1, "gamma")
    for v in values:
        write(w, v, "golomb", b=b)


def read_vector(r: Bits, b: int = 4) -> list[int]:
    return [read(r, "golomb", b=b) for _ in range(read(r, "gamma") - 1)]


def write_sparse(w: Bits, values: Sequence[int], code: str = "fibonacci") -> None:
    """A vector of mostly zeros: its length, and the places and sizes of the others."""
    write(w, len(values) + 1, code)
    last = -1
    some = [(i, v) for i, v in enumerate(values) if v]
    write(w, len(some) + 1, code)
    for i, v in some:
        write(w, i - last, code)
        write(w, v, code)
        last = i


def read_sparse(r: Bits, code: str = "fibonacci") -> list[int]:
    out, last = [0] * (read(r, code) - 1), -1
    for _ in range(read(r, code) - 1):
        last += read(r, code)
        out[last] = read(r, code)
    return out


# lists ---------------------------------------------------------------------------


def write_gaps(w: Bits, xs: Sequence[int], code: str, near: int | None = None) -> None:
    """Length, first value, gaps."""
    write(w, len(xs) + 1, code)
    for k, x in enumerate(xs):
        first = x + 1 if near is None else zigzag(x - near) + 1
        write(w, x - xs[k - 1] if k else first, code)


def read_gaps(r: Bits, code: str, near: int | None = None) -> list[int]:
    out: list[int] = []
    for k in range(read(r, code) - 1):
        v = read(r, code)
        out.append(out[-1] + v if k else v - 1 if near is None else near + unzigzag(v - 1))
    return out


def write_stop(w: Bits, xs: Sequence[int], code: str, near: int | None = None) -> None:
    """No length: a 1 before each value, a 0 at the end."""
    for k, x in enumerate(xs):
        first = x + 1 if near is None else zigzag(x - near) + 1
        w.put(1, 1)
        write(w, x - xs[k - 1] if k else first, code)
    w.put(0, 1)


def read_stop(r: Bits, code: str, near: int | None = None) -> list[int]:
    out: list[int] = []
    while r.take(1):
        v = read(r, code)
        out.append(out[-1] + v if out else v - 1 if near is None else near + unzigzag(v - 1))
    return out


def intervals(xs: Sequence[int], least: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Maximal runs of ``least`` or more neighbouring numbers as (start, length), and the rest."""
    runs, rest, k = [], [], 0
    while k < len(xs):
        end = k + 1
        while end < len(xs) and xs[end] == xs[end - 1] + 1:
            end += 1
        if end - k >= least:
            runs.append((xs[k], end - k))
        else:
            rest += xs[k:end]
        k = end
    return runs, rest


def write_intervals(w: Bits, xs: Sequence[int], code: str, least: int = 4, near: int | None = None, sides: bool = False) -> None:
    """Intervals by start (from the end of the one before) and length, then the rest as gaps.

    With ``sides`` the rest is written in two stop-coded lists of distances, below and above ``near``.
    """
    runs, rest = intervals(xs, least)
    write(w, len(runs) + 1, code)
    end = 0
    for start, n in runs:
        write(w, start - end + 1, code)
        write(w, n - least + 1, code)
        end = start + n
    if sides:
        write_stop(w, [near - x - 1 for x in reversed(rest) if x < near], code)
        write_stop(w, [x - near for x in rest if x >= near], code)
    else:
        write_stop(w, rest, code, near)


def read_intervals(r: Bits, code: str, least: int = 4, near: int | None = None, sides: bool = False) -> list[int]:
    out, end = [], 0
    for _ in range(read(r, code) - 1):
        start = end + read(r, code) - 1
        end = start + read(r, code) + least - 1
        out += range(start, end)
    if sides:
        out += [near - x - 1 for x in read_stop(r, code)]
        out += [near + x for x in read_stop(r, code)]
    else:
        out += read_stop(r, code, near)
    return sorted(out)


def write_runs(w: Bits, xs: Sequence[int], code: str, near: int | None = None, least: int = 3) -> None:
    """The gaps as sections: 0 and a stretch of different gaps, or 1 and a gap that repeats ``least`` times or more."""
    write(w, len(xs) + 1, code)
    if not xs:
        return
    write(w, xs[0] + 1 if near is None else zigzag(xs[0] - near) + 1, code)
    gaps = [b - a for a, b in zip(xs, xs[1:])]
    k, plain = 0, []

    def flush() -> None:
        if plain:
            w.put(0, 1)
            write(w, len(plain), code)
            for g in plain:
                write(w, g, code)
            plain.clear()

    while k < len(gaps):
        end = k + 1
        while end < len(gaps) and gaps[end] == gaps[k]:
            end += 1
        if end - k >= least:
            flush()
            w.put(1, 1)
            write(w, gaps[k], code)
            write(w, end - k - least + 1, code)
        else:
            plain += gaps[k:end]
        k = end
    flush()


def read_runs(r: Bits, code: str, near: int | None = None, least: int = 3) -> list[int]:
    n = read(r, code) - 1
    if not n:
        return []
    v = read(r, code) - 1
    out = [v if near is None else near + unzigzag(v)]
    while len(out) < n:
        if r.take(1):
            g = read(r, code)
            for _ in range(read(r, code) + least - 1):
                out.append(out[-1] + g)
        else:
            for _ in range(read(r, code)):
                out.append(out[-1] + read(r, code))
    return out


def write_elias_fano(w: Bits, xs: Sequence[int]) -> None:
    """A non-decreasing list: length, low width, low parts, and high parts as unary gaps."""
    n = len(xs)
    write(w, n + 1, "gamma")
    if not n:
        return
    low = max(0, ((xs[-1] + 1) // n).bit_length() - 1) if n > 1 else 0
    write(w, low + 1, "gamma")
    for x in xs:
        w.put(x & ((1 << low) - 1), low)
    high = 0
    for x in xs:
        w.put(0, (x >> low) - high)
        w.put(1, 1)
        high = x >> low


def read_elias_fano(r: Bits) -> list[int]:
    n = read(r, "gamma") - 1
    if not n:
        return []
    low = read(r, "gamma") - 1
    lows = [r.take(low) for _ in range(n)]
    out, high = [], 0
    for x in lows:
        high += r.zeros()
        out.append(high << low | x)
    return out


# copies ----------------------------------------------------------------------------


def split_reference(target: Sequence[int], reference: Sequence[int]) -> tuple[list[bool], list[int]]:
    """Which of the reference's members are copied, and what else the target holds."""
    own, there = set(target), set(reference)
    return [x in own for x in reference], [x for x in target if x not in there]


def join_reference(reference: Sequence[int], copied: Sequence[bool], rest: Sequence[int]) -> list[int]:
    return sorted([*(x for x, c in zip(reference, copied) if c), *rest])


def rank_gaps(rest: Sequence[int], copied: Sequence[int]) -> list[int]:
    """Ids as ranks among those not copied: never larger, and dense where copies are."""
    out, k, copied = [], 0, sorted(copied)
    for x in rest:
        while k < len(copied) and copied[k] < x:
            k += 1
        out.append(x - k)
    return out


def unrank_gaps(ranks: Sequence[int], copied: Sequence[int]) -> list[int]:
    out, k, copied = [], 0, sorted(copied)
    for q in ranks:
        while k < len(copied) and copied[k] - k <= q:
            k += 1
        out.append(q + k)
    return out


def alternating(bits: Sequence[bool]) -> list[int]:
    """Lengths of alternating copied and skipped blocks, a copied one first (it may be empty); the last is left out."""
    out, now = [0], True
    for b in bits:
        if bool(b) != now:
            out.append(0)
            now = not now
        out[-1] += 1
    return out[:-1]


def write_blocks(w: Bits, bits: Sequence[bool], code: str) -> None:
    sizes = alternating(bits)
    write(w, len(sizes) + 1, code)
    for k, s in enumerate(sizes):
        write(w, s + (k == 0), code)


def read_blocks(r: Bits, n: int, code: str) -> list[bool]:
    out: list[bool] = []
    now = True
    for k in range(read(r, code) - 1):
        out += [now] * (read(r, code) - (k == 0))
        now = not now
    return out + [now] * (n - len(out))


def write_ones(w: Bits, bits: Sequence[bool], code: str) -> None:
    """Maximal runs of ones as (gap, length)."""
    runs, _ = intervals([i for i, b in enumerate(bits) if b], 1)
    write(w, len(runs) + 1, code)
    end = -1
    for start, n in runs:
        write(w, start - end, code)
        write(w, n, code)
        end = start + n


def read_ones(r: Bits, n: int, code: str) -> list[bool]:
    out, end = [False] * n, -1
    for _ in range(read(r, code) - 1):
        start = end + read(r, code)
        end = start + read(r, code)
        out[start:end] = [True] * (end - start)
    return out


def write_bitmap(w: Bits, bits: Sequence[bool], code: str = "") -> None:
    for b in bits:
        w.put(int(b), 1)


def read_bitmap(r: Bits, n: int, code: str = "") -> list[bool]:
    return [bool(r.take(1)) for _ in range(n)]


_COPIES = ((write_blocks, read_blocks), (write_ones, read_ones), (write_bitmap, read_bitmap))


def write_copy(w: Bits, bits: Sequence[bool], code: str) -> None:
    """The shortest of blocks (0), runs of ones (10) and a bitmap (11)."""
    best = min(range(3), key=lambda k: cost(_COPIES[k][0], bits, code) + (k > 0))
    w.put((0, 2, 3)[best], 1 + (best > 0))
    _COPIES[best][0](w, bits, code)


def read_copy(r: Bits, n: int, code: str) -> list[bool]:
    return _COPIES[0 if not r.take(1) else 1 + r.take(1)][1](r, n, code)


# permutations, matrices, pairs --------------------------------------------------------


def write_permutation(w: Bits, p: Sequence[int], how: str = "lehmer") -> None:
    """``raw``: fixed width; ``lehmer``: each value's rank among those left, truncated binary."""
    n = len(p)
    write(w, n + 1, "gamma")
    if how == "raw":
        for x in p:
            w.put(x, max(1, (n - 1).bit_length()))
        return
    left = list(range(n))
    for k, x in enumerate(p):
        at = left.index(x)
        write_truncated(w, at, n - k)
        left.pop(at)


def read_permutation(r: Bits, how: str = "lehmer") -> list[int]:
    n = read(r, "gamma") - 1
    if how == "raw":
        return [r.take(max(1, (n - 1).bit_length())) for _ in range(n)]
    left = list(range(n))
    return [left.pop(read_truncated(r, n - k)) for k in range(n)]


def write_triangle(w: Bits, links: set[tuple[int, int]], n: int) -> None:
    """An undirected graph on 0..n-1 as the upper triangle of its matrix."""
    for i in range(n):
        for j in range(i + 1, n):
            w.put(int((i, j) in links or (j, i) in links), 1)


def read_triangle(r: Bits, n: int) -> set[tuple[int, int]]:
    return {(i, j) for i in range(n) for j in range(i + 1, n) if r.take(1)}


def write_pairs(w: Bits, lists: Sequence[Sequence[int]], code: str = "fibonacci") -> None:
    """Links between two groups: of each source, its sorted targets."""
    for xs in lists:
        write_gaps(w, xs, code)


def read_pairs(r: Bits, n: int, code: str = "fibonacci") -> list[list[int]]:
    return [read_gaps(r, code) for _ in range(n)]


# commands ------------------------------------------------------------------------------

#: Prefix of each command, as (bits, width).
PREFIX = {"stop": (0, 1), "gap": (2, 2), "reference": (6, 3), "interval": (14, 4), "run": (30, 5), "block": (31, 5)}


def commands(xs: Sequence[int], least: int = 4) -> list[tuple]:
    """A list as commands: intervals, runs of equal gaps, single gaps, and the stop."""
    out: list[tuple] = []
    last, k = -1, 0
    while k < len(xs):
        end = k + 1
        while end < len(xs) and xs[end] == xs[end - 1] + 1:
            end += 1
        if end - k >= least:
            out.append(("interval", xs[k] - last, end - k))
        else:
            gap, end = xs[k] - last, k + 1
            while end < len(xs) and xs[end] - xs[end - 1] == gap:
                end += 1
            if end - k >= 3:
                out.append(("run", gap, end - k))
            else:
                out.append(("gap", gap))
                end = k + 1
        last, k = xs[end - 1], end
    return [*out, ("stop",)]


def write_commands(w: Bits, cmds: Sequence[tuple], code: str) -> None:
    """Each command: its prefix and numbers; a reference has its distance and copied places, a block its bits."""
    for op, *args in cmds:
        w.put(*PREFIX[op])
        if op == "reference":
            write(w, args[0], code)
            write_stop(w, args[1], code)
        elif op == "block":
            write_gaps(w, args[0], code)
        else:
            for a in args:
                write(w, a, code)


def read_commands(r: Bits, code: str) -> list[tuple]:
    out: list[tuple] = []
    while True:
        n = 0
        while n < 5 and r.take(1):
            n += 1
        op = ("stop", "gap", "reference", "interval", "run", "block")[n]
        if op == "stop":
            return [*out, ("stop",)]
        if op == "reference":
            out.append((op, read(r, code), read_stop(r, code)))
        elif op == "block":
            out.append((op, read_gaps(r, code)))
        else:
            out.append((op, *(read(r, code) for _ in range(1 if op == "gap" else 2))))


def replayed(cmds: Sequence[tuple], before: Callable[[int], Sequence[int]] | None = None) -> list[int]:
    """The sorted list that commands stand for; ``before(d)`` gives the list ``d`` vertices back."""
    out: set[int] = set()
    last = -1
    for op, *args in cmds:
        if op == "gap":
            last += args[0]
            out.add(last)
        elif op == "interval":
            out.update(range(last + args[0], last + args[0] + args[1]))
            last += args[0] + args[1] - 1
        elif op == "run":
            for _ in range(args[1]):
                last += args[0]
                out.add(last)
        elif op == "reference":
            ref = before(args[0])
            out.update(ref[i] for i in args[1])
        elif op == "block":
            out.update(args[0])
    return sorted(out)
