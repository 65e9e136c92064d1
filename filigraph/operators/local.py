"""Cuts, volumes and the growth of a vertex set by its frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from . import ranking


def conductance(g: Graph, members: DataFrame) -> DataFrame:
    """(volume, cut, conductance): out-degrees in S, edges leaving it, cut / min(vol S, total - vol S); infinite without volume."""
    s = members.select(F.col("id").alias("src")).distinct().withColumn("a", F.lit(1))
    t = members.select(F.col("id").alias("dst")).distinct().withColumn("b", F.lit(1))
    e = g.edges.join(s, "src", "left").join(t, "dst", "left")
    x = e.agg(F.count("a").alias("volume"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("cut"), F.count(F.lit(1)).alias("total"))
    least = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    return x.select("volume", "cut", F.when(least > 0, F.col("cut") / least).otherwise(float("inf")).alias("conductance"))


def frontier(g: Graph, members: DataFrame) -> DataFrame:
    """(id, k_in, degree): children of S outside it, their edges with S in either direction, out-degree."""
    s = members.select("id").distinct()
    out = g.edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").join(s.withColumnRenamed("id", "dst"), "dst", "left_anti")
    back = g.edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").join(s.withColumnRenamed("id", "src"), "src", "left_anti")
    a = out.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("a"))
    b = back.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("b"))
    x = a.join(b, "id", "left").join(g.out_degrees(), "id")
    return x.select("id", (F.col("a") + F.coalesce("b", F.lit(0))).alias("k_in"), F.col("out_degree").alias("degree"))


def children_by_support(g: Graph, members: DataFrame, rho: float = 0.4, tau: int = 2) -> DataFrame:
    """Frontier children with k_in >= tau or k_in / degree >= rho."""
    ok = (F.col("k_in") >= tau) | ((F.col("degree") > 0) & (F.col("k_in") / F.col("degree") >= rho))
    return frontier(g, members).filter(ok)


def support_score(k_in, degree, penalty: float = 0.5):
    return k_in - penalty * (degree - k_in)


def modularity_gain(k_in, degree, volume, m):
    return (2 * k_in - degree * volume / m) / (2 * m)


def children_by_modularity(g: Graph, members: DataFrame, most: int | None = None) -> DataFrame:
    """Frontier by initial gain, added while the gain under the grown volume stays positive; a running sum replaces the loop."""
    from pyspark.sql import Window

    m = g.edges.count()
    vol = g.edges.join(members.select(F.col("id").alias("src")).distinct(), "src", "left_semi").count()
    x = frontier(g, members).withColumn("gain", modularity_gain(F.col("k_in"), F.col("degree"), F.lit(vol), F.lit(m))).filter("gain > 0")
    w = Window.orderBy(F.desc("gain"), "id")
    grown = F.lit(vol) + F.coalesce(F.sum("degree").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("now", modularity_gain(F.col("k_in"), F.col("degree"), grown, F.lit(m)))
    x = x.withColumn("bad", F.sum(F.when(F.col("now") <= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("bad = 0")
    return (x.orderBy(F.desc("gain"), "id").limit(most) if most else x).select("id", "k_in", "degree", "gain")


def children_by_conductance(g: Graph, members: DataFrame, most: int = 10) -> DataFrame:
    """Greedy: add the frontier child that lowers cut / vol(S) most, up to ``most`` times (one small query each)."""
    s, picked = members.select("id").distinct(), []
    for _ in range(most):
        r = conductance(g, s).first()
        now = r.cut / r.volume if r.volume else float("inf")
        out = g.edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi")
        into = out.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("to_s"))
        from_s = g.edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("from_s"))
        x = from_s.join(s, "id", "left_anti").join(into, "id", "left").join(g.out_degrees(), "id")
        cut = r.cut - F.col("from_s") + F.col("out_degree") - F.coalesce("to_s", F.lit(0))
        best = x.withColumn("c", cut / (r.volume + F.col("out_degree"))).filter(F.col("c") < now - 1e-12).orderBy("c", "id").first()
        if best is None:
            break
        picked.append((best.id, float(best.c)))
        s = s.unionByName(g.edges.sparkSession.createDataFrame([(best.id,)], "id long"))
    return g.edges.sparkSession.createDataFrame(picked, "id long, ratio double")


def children_by_ppr(g: Graph, members: DataFrame, most: int | None = None, least: float = 1e-4, **how) -> DataFrame:
    """Vertices outside S by personalised score over degree, at least ``least``."""
    p = ranking.push(g, members, **how)
    x = p.join(members.select("id"), "id", "left_anti").join(g.out_degrees(), "id").withColumn("ratio", F.col("p") / F.greatest("out_degree", F.lit(1))).filter(F.col("ratio") >= least)
    return (x.orderBy(F.desc("ratio"), "id").limit(most) if most else x).select("id", "ratio")
