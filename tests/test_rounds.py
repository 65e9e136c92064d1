"""Rounds on blocks of a graph against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from filigraph.graph import Graph
from filigraph.operators import community, overlap, rounds, traversal


def _graph(spark, seed=3, n=40, m=220):
    r = random.Random(seed)
    e = sorted({(r.randrange(n) * 5, min(r.randrange(n), r.randrange(n)) * 5) for _ in range(m)} | {(5, 5), (0, 0)})
    return e, Graph.of(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(i * 5,) for i in range(n + 2)], "id long")).kept()


def _cores(e, vs):
    out, k, left = {}, 0, set(vs)
    while left:
        d = Counter(v for a, b in e if a in left and b in left for v in (a, b))
        k = max(k, min(d[v] for v in left))
        gone = {v for v in left if d[v] <= k}
        out |= dict.fromkeys(gone, k)
        left -= gone
    return out


def test_cores_and_clustering(spark, monkeypatch):
    e, g = _graph(spark)
    vs = [r.id for r in g.vertices.collect()]
    near = {v: {b for a, b in e if a == v != b} | {a for a, b in e if b == v != a} for v in vs}
    each = [sum((a, b) in set(e) for a in x for b in x if a != b) / (len(x) * (len(x) - 1)) for x in near.values() if len(x) > 1]
    for size in (1 << 20, 60, 1):
        for at in (overlap, rounds):
            monkeypatch.setattr(at, "ROW_BLOCK", size)
        if size > 1:
            assert {r.id: r.core for r in traversal.k_cores(g).collect()} == _cores(e, vs)
        assert abs(overlap.average_clustering(g).first()[0] - sum(each) / len(each)) < 1e-12


def test_hubs_stay_bounded(spark):
    """Two hubs of many common leaves: no task makes the hubs' pairs of leaves."""
    n = 400
    e = [(h, i) for h in (0, 1) for i in range(2, n)] + [(0, 1)]
    g = Graph.of(spark.createDataFrame(e, "src long, dst long")).kept()
    # a leaf has one link between its two neighbours, a hub n - 2 among its n - 1
    want = ((n - 2) / 2 + 2 * (n - 2) / ((n - 1) * (n - 2))) / n
    assert abs(overlap.average_clustering(g).first()[0] - want) < 1e-12


def test_potts(spark, monkeypatch):
    e, g = _graph(spark, 9)
    turn = {r.id: r.t for r in g.vertices.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("t")).collect()}
    near = {v: {b for a, b in e if a == v != b} | {a for a, b in e if b == v != a} for v in turn}
    for gamma in (0.0, 0.25):
        label = {v: v for v in turn}
        for k in range(6):
            size, new = Counter(label.values()), dict(label)
            for v in turn:
                c = Counter(label[x] for x in near[v])
                if c and turn[v] == k % 2:
                    new[v] = min(c, key=lambda t: (-(c[t] - gamma * (size[t] - c[t])), t))
            still, label = new == label, new
            if k % 2 and still:
                break
        for size in (1 << 20, 50):
            for at in (overlap, rounds):
                monkeypatch.setattr(at, "ROW_BLOCK", size)
            assert {r.id: r.label for r in community.absolute_potts(g, gamma, 3).collect()} == label
