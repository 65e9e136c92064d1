"""Brute-force versions of the corpus operators, in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(t):
    return (t or "").translate(UPPER)


def line_dedup(docs):
    keys = {i: [x.strip(" \t\n\x0b\x0c\r").translate(UPPER) for x in (t or "").split("\n")] for i, t in docs}
    owner = defaultdict(set)
    for i, ks in keys.items():
        for k in ks:
            owner[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[i]) if not (len(k) >= 10 and len(owner[k]) >= 2 and min(owner[k]) != i)]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def quality_base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def shingles(t, n=5):
    w = WORD.findall(lower(t))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = sorted((root(ids[a]), root(ids[b])))
                up[s] = r
    return {i: (len(s), root(i)) for i, s in sets.items()}


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, window=10):
    wins = defaultdict(set)
    for k, t in items:
        w = BENCH.findall(lower(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            wins[tuple(w[i : i + n])].add(k)
    sizes = {len(x) for x in wins}
    out = {}
    for d, t in docs:
        w = BENCH.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        ids = sorted(str(k) for k in found if k is not None)
        out[d] = len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)
    return out


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def language_model(docs, held=(7, 2), least=(2, 3), discount=0.75):
    """n_tokens, n_known, N, base and model score, with exact (unquantised) probabilities."""
    tok = {k: [*WORD.findall(lower(t)), None] for k, (i, t) in enumerate(docs)}
    train = [k for k, (i, _) in enumerate(docs) if crc(i) % held[0] != held[1]]
    counts = [Counter(w for k in train for w in tok[k])]
    for level, few in enumerate(least, 2):
        c = Counter()
        for k in train:
            x = [None, *tok[k]]
            for j in range(level, len(x) + 1):
                g = tuple(x[j - level : j])
                c[g] += 1
        counts.append({g: n for g, n in c.items() if n >= few})
    total, v = sum(counts[0].values()), len(counts[0])
    rest = defaultdict(float)
    for c in counts[1:]:
        for g, n in c.items():
            h = g[:-1]
            whole = counts[0][h[0]] if len(h) == 1 else counts[len(h) - 1].get(h)
            if whole:
                rest[h] += (n - discount) / whole

    def p(ctx, w):
        if not ctx:
            return (counts[0][w] + 1) / (total + v + 1)
        low = p(ctx[1:], w)
        whole = counts[0][ctx[0]] if len(ctx) == 1 else counts[len(ctx) - 1].get(ctx)
        if not whole:
            return low
        n = counts[len(ctx)].get((*ctx, w), 0)
        return (max(n - discount, 0) / whole if n else 0) + (1 - rest[ctx]) * low

    out = []
    for k in range(len(docs)):
        x = [None, *tok[k]]
        base = sum(math.log10(p((), w)) for w in tok[k])
        score = sum(math.log10(p(tuple(x[max(0, j - len(least)) : j]), x[j])) for j in range(1, len(x)))
        out.append((len(tok[k]), sum(counts[0][w] > 0 for w in tok[k]), total, base, score))
    return out


def nearest(vectors, query, k):
    """Exact cosine neighbours by comparing with every vector."""
    s = [(sum(query.get(t, 0) * w for t, w in v.items()), i) for i, v in enumerate(vectors)]
    return sorted([(x, i) for x, i in s if x > 0], key=lambda x: (-x[0], x[1]))[:k]


__all__ = [n for n in dir() if not n.startswith("_")] + ["np"]


# 4: minimum covariance determinant ----------------------------------------------------


def _rank(x, p):
    import math

    return sorted(x)[max(0, math.ceil(p * len(x)) - 1)]


def mcd(x, floor, core=0.75, most=20):
    """Mean and scaled scatter of one group's rows, by concentration steps from three starts."""
    import numpy as np

    x, floor = np.asarray(x, float), np.asarray(floor)
    mid = np.array([_rank(c, 0.5) for c in x.T])
    sd = np.maximum([(_rank(c, 0.75) - _rank(c, 0.25)) / 1.349 for c in x.T], floor)
    z = (x - mid) / sd
    shapes = [np.eye(len(sd)), len(sd) * (z[:, :, None] * z[:, None] / np.maximum((z**2).sum(1), 1e-9)[:, None, None]).mean(0), np.atleast_2d(np.cov(np.tanh(z).T, bias=True))]
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        d = d2(m, c)
        near = x[d <= _rank(d, core)]
        return near.mean(0), np.atleast_2d(np.cov(near.T, bias=True)) + np.diag(floor**2)

    det = lambda e: np.linalg.slogdet(e[1])[1]
    best = min((step(*step(mid, s * np.outer(sd, sd) + np.diag(floor**2))) for s in shapes), key=det)
    for _ in range(3, most + 1):
        new = step(*best)
        fell = det(new) < det(best) - 1e-3
        if det(new) < det(best):
            best = new
        if not fell:
            break
    m, c = best
    return m, c * max(1.0, _rank(d2(m, c), 0.5) / 5.3481)
