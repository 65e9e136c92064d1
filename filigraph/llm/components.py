"""Connected components of an edge table.

Tables of at most ``one_task`` distinct edges are one task's work: every round of
stars costs the driver several queries, which are most of its memory for so few
rows.  Larger tables go through alternating large-star and small-star rounds.
Both ways give each vertex the smallest one it is connected with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_split_join, released, saved, ship

#: Edges that one task may hold: about 100 MB with all that is worked out of them.
ONE_TASK = 1 << 20


def smallest_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex connected with each): roots hook to smaller ones, then paths are halved."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, up = at[: len(a)], at[len(a) :], np.arange(len(v))
    while len(i):
        i, j = up[i], up[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while (up != up[up]).any():
            up = up[up]
    return v, v[up]


def _in_one_task(batches):
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if edges:
        v, root = smallest_connected(*(np.concatenate(x) for x in zip(*edges)))
        for k in range(0, len(v), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["v", "root"])


def _star(edges: DataFrame, both: bool, folder: str) -> DataFrame:
    """Links each vertex's (larger, or smaller) neighbours to the smallest of its neighbourhood."""
    near = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))  # a < b: v's smaller neighbours
    if both:
        near = near.unionByName(edges.select(F.col("a").alias("v"), F.col("b").alias("u")))
    least = saved(near.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count(F.lit(1)).alias("n")), folder)
    total = edges.count() * (2 if both else 1)
    far = heavy_split_join(near, least, ["v"], "n", total, least)
    if both:
        new = far.filter("u > v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        new = far.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return new.filter("a < b").distinct()


def components(edges: DataFrame, folder: str, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(v, root): for each vertex of an edge, the smallest vertex it is connected with.

    ``edges``: columns a and b, long; loops and repeated edges are harmless.  Every round
    is written to ``folder``.  Raises if the rounds do not suffice.
    """
    ship(edges.sparkSession)
    order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = saved(edges.select(*order).filter("a < b").distinct(), f"{folder}/e0")
    if now.count() <= one_task:
        return saved(now.coalesce(1).mapInArrow(released(_in_one_task), "v long, root long"), f"{folder}/roots")
    mark = None
    for k in range(1, most_rounds):
        large = saved(_star(now, True, f"{folder}/m{k}l"), f"{folder}/e{k}l")
        now = saved(_star(large, False, f"{folder}/m{k}s"), f"{folder}/e{k}s")
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == (r[0], r[1]):
            break
        mark = r[0], r[1]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())
