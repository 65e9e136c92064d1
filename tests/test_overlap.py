"""Overlaps in blocks against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from filigraph.operators import overlap
from filigraph.plans import queries


def test_blocks_of_any_size(spark, monkeypatch):
    r = random.Random(5)
    sets = {i * 7 - 50: {r.randrange(40) for _ in range(r.randrange(1, 9))} | ({99} if i % 2 else set()) for i in range(60)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "row_id long, item long")
    own = {i: s for i, s in sets.items() if i % 3 == 0}
    targets = rows.filter("row_id % 3 = 0").withColumnRenamed("row_id", "target_id").unionByName(spark.createDataFrame([(1000, 12345)], "target_id long, item long"))
    want = {(a, b): len(s & t) for a, s in own.items() for b, t in sets.items() if s & t}
    top = sorted((a, b) for a in own for b in sorted((b for t, b in want if t == a), key=lambda b: (-want[a, b], b))[:4])
    for size in (1 << 20, 25, 3):
        monkeypatch.setattr(overlap, "ROW_BLOCK", size)
        monkeypatch.setattr(overlap, "TARGET_BLOCK", size)
        x = overlap.overlaps(rows, targets)
        assert {(t.target_id, t.row_id): t.overlap for t in x.collect()} == want
        assert sorted((t.target_id, t.row_id) for t in overlap.topk_overlaps(rows, targets, 4).collect()) == top
        j = {(t.target_id, t.row_id): t.jaccard for t in overlap.jaccards(rows, targets).collect()}
        assert j.keys() == want.keys() and all(abs(j[a, b] - n / len(sets[a] | sets[b])) < 1e-12 for (a, b), n in want.items())
        best = {t.target_id: (t.row_id, t.overlap) for t in overlap.best_overlap(rows, targets).collect()}
        assert best.pop(1000) == (0, 0) and best == {a: max(((b, n) for (t, b), n in want.items() if t == a), key=lambda x: (x[1], -x[0])) for a in own}
    # no pair is shuffled
    assert "Join" not in x._jdf.queryExecution().toString()
    named = rows.withColumn("item", F.concat(F.lit("i"), "item"))
    assert overlap.overlaps(named, named.withColumnRenamed("row_id", "target_id").filter("target_id % 3 = 0")).count() == len(want)


def test_few_lookups_at_once():
    rows = (np.array([5, 8, 9]), None, np.array([1, 1, 2, 2, 3, 3]), np.array([0, 1, 0, 2, 1, 2], np.int32))
    targets = (np.array([1, 2, 3]), None, np.array([1, 2, 7, 1, 3, 2, 3]), np.array([0, 0, 0, 1, 1, 2, 2], np.int32))
    for most in (1, 3, 100):
        got = [(int(a), int(b), int(n)) for x in overlap._shared(rows, targets, most) for a, b, n in zip(*x)]
        assert got == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 2)]


def test_all_rows_are_targets():
    """The query leaves no row out, nor does its SQL."""
    assert "% 40" not in queries.SQL["overlap_jaccard"] and "% 40" in queries.SQL["overlap_topk"]
