"""Projections, filters and basic statistics of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import saved, work_dir


def basic_stats(g: Graph) -> DataFrame:
    """n, m, density (m/(n(n-1)), twice that where undirected edges count once)."""
    n = g.vertices.agg(F.count(F.lit(1)).alias("n"))
    m = g.edges.filter(F.lit(g.directed) | (F.col("src") <= F.col("dst"))).agg(F.count(F.lit(1)).alias("m"))
    pairs = F.col("n") * (F.col("n") - 1)
    return n.join(F.broadcast(m)).select("n", "m", F.when(pairs > 0, (1 if g.directed else 2) * F.col("m") / pairs).otherwise(0.0).alias("density"))


def out_degree_stats(g: Graph) -> DataFrame:
    d = g.out_degrees()
    return d.agg(F.avg("out_degree").alias("avg_out"), F.max("out_degree").alias("max_out"), F.count_if(F.col("out_degree") == 0).alias("n_sinks"))


def sinks(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti")


def sources(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def average_out_degree(g: Graph, visited: DataFrame, p_avg: float = -1.0, np_steps: int = 0) -> DataFrame:
    """Mean out-degree over a multiset of visited ids, continuing a former mean over ``np_steps``."""
    d = visited.select("id").join(g.out_degrees(), "id").agg(F.sum("out_degree").alias("s"), F.count(F.lit(1)).alias("k"))
    old = p_avg * np_steps if np_steps and p_avg >= 0 else 0.0
    steps = np_steps if np_steps and p_avg >= 0 else 0
    return d.select(((F.coalesce("s", F.lit(0)) + old) / (F.col("k") + steps)).alias("avg_out"))


def transition(g: Graph, kind: str = "row") -> DataFrame:
    """(i, j, w): row- or column-stochastic transition matrix; dangling vertices have none."""
    if kind == "row":
        return g.edges.join(g.out_degrees(), F.col("src") == F.col("id")).select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / F.col("out_degree")).alias("w"))
    if kind == "col":
        return g.edges.join(g.in_degrees(), F.col("dst") == F.col("id")).select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / F.col("in_degree")).alias("w"))
    raise ValueError(f"unknown kind {kind!r}")


def symmetric_normalised(g: Graph) -> DataFrame:
    """(i, j, w): D^-1/2 (A + I) D^-1/2 with D the row sums of A + I (a loop counts twice on the diagonal)."""
    a = g.edges.withColumn("w", F.lit(1.0)).unionByName(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    a = a.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    d = a.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    x = a.join(d.select(F.col("id").alias("src"), F.col("d").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("d2")), "dst")
    return x.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("w") / F.sqrt(F.col("d1") * F.col("d2"))).alias("w"))


def forward_ball(g: Graph, start: DataFrame, radius: int = 2, p: float = 1.0, seed: int = 7) -> DataFrame:
    """(id, level) within ``radius`` of ``start(id)``; from level 2 on a child stays with probability p^(level-1)."""
    spark = g.edges.sparkSession
    folder = work_dir(spark, "ball")
    seen = saved(start.select(F.col("id").cast("long")).distinct().withColumn("level", F.lit(0)), f"{folder}/0")
    for t in range(1, radius + 1):
        front = seen.filter(F.col("level") == t - 1).select(F.col("id").alias("src"))
        new = g.edges.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if p < 1 and t >= 2:
            unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(t)), 11) / float(1 << 53)
            new = new.filter(unit <= p ** (t - 1))
        seen = saved(seen.unionByName(new.withColumn("level", F.lit(t))), f"{folder}/{t}")
    return seen
