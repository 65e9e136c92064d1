"""Algebraic multigrid over coordinate tables (i, j, a) and vectors (id, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import saved, work_dir


def laplacian(g: Graph, shift: float = 0.0) -> DataFrame:
    """D - A of the undirected projection, plus ``shift`` on the diagonal."""
    e = g.undirected().edges.filter("src <> dst")
    d = g.vertices.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left")
    return e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("a")).unionByName(d.select(F.col("id").alias("i"), F.col("id").alias("j"), (F.coalesce("d", F.lit(0)) + shift).alias("a")))


def times(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x, F.col("j") == F.col("id")).groupBy(F.col("i").alias("id")).agg(F.sum(F.col("a") * F.col("x")).alias("x"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, a) of a matrix product."""
    r = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("a").alias("b"))
    return a.join(r, F.col("j") == F.col("k")).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("a"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")


def jacobi(a: DataFrame, b: DataFrame, x: DataFrame, sweeps: int = 1, omega: float = 2 / 3) -> DataFrame:
    """Weighted Jacobi: x += omega (b - A x) / diag."""
    d = a.filter("i = j").select(F.col("i").alias("id"), F.col("a").alias("d"))
    for _ in range(sweeps):
        ax = times(a, x).withColumnRenamed("x", "ax")
        x = b.withColumnRenamed("x", "b").join(d, "id").join(x, "id").join(ax, "id", "left").select("id", (F.col("x") + omega * (F.col("b") - F.coalesce("ax", F.lit(0.0))) / F.col("d")).alias("x"))
    return x


def strong(a: DataFrame, theta: float = 0.08) -> DataFrame:
    """(i, j) with -a_ij >= theta * max_k(-a_ik), off the diagonal."""
    off = a.filter("i <> j")
    top = off.groupBy("i").agg(F.max(-F.col("a")).alias("top"))
    return off.join(top, "i").filter((F.col("top") > 0) & (-F.col("a") >= theta * F.col("top"))).select("i", "j")


def aggregates(s: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, agg): vertices join their neighbourhood's local maximum of (strong degree, -id); all others join themselves or a joined neighbour."""
    d = s.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    k = ids.select("id").join(d, "id", "left").select("id", F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("id")).alias("m")).alias("k"))
    near = s.join(k, F.col("j") == F.col("id")).groupBy("i").agg(F.max("k").alias("best"))
    roots = k.join(near, F.col("id") == F.col("i"), "left").filter("best is null or k > best").select("id")
    joined = s.join(roots.withColumnRenamed("id", "j"), "j", "left_semi").groupBy(F.col("i").alias("id")).agg(F.min("j").alias("agg"))
    first = roots.select("id", F.col("id").alias("agg")).unionByName(joined.join(roots, "id", "left_anti"))
    second = s.join(first.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.min("agg").alias("agg2"))
    return ids.select("id").join(first, "id", "left").join(second, "id", "left").select("id", F.coalesce("agg", "agg2", "id").alias("agg"))


def prolongator(a: DataFrame, agg: DataFrame, smoothed: bool = True, omega: float = 2 / 3) -> DataFrame:
    """Piecewise constant over aggregates, smoothed by one Jacobi step: P - omega D^-1 A P."""
    p = agg.select(F.col("id").alias("i"), F.col("agg").alias("j"), F.lit(1.0).alias("a"))
    if not smoothed:
        return p
    d = a.filter("i = j").select(F.col("i").alias("k"), F.col("a").alias("d"))
    ap = product(a, p).join(d, F.col("i") == F.col("k")).select("i", "j", (-omega * F.col("a") / F.col("d")).alias("a"))
    return p.unionByName(ap).groupBy("i", "j").agg(F.sum("a").alias("a")).filter("abs(a) > 1e-14")


def setup(a: DataFrame, max_levels: int = 6, min_coarse: int = 50, theta: float = 0.08, smoothed: bool = True) -> list[tuple[DataFrame, DataFrame | None]]:
    """Levels (A, P), fine to coarse; the last has no P."""
    folder = work_dir(a.sparkSession, "amg")
    a = saved(a, f"{folder}/a0")
    levels: list[tuple[DataFrame, DataFrame | None]] = []
    for k in range(max_levels - 1):
        ids = a.filter("i = j").select(F.col("i").alias("id"))
        n = ids.count()
        if n <= min_coarse:
            break
        agg = saved(aggregates(strong(a, theta), ids), f"{folder}/g{k}")
        if agg.select("agg").distinct().count() >= n:
            break
        p = saved(prolongator(a, agg, smoothed), f"{folder}/p{k}")
        levels.append((a, p))
        a = saved(product(product(transposed(p), a), p), f"{folder}/a{k + 1}")
    return [*levels, (a, None)]


def v_cycle(levels: list[tuple[DataFrame, DataFrame | None]], b: DataFrame, x: DataFrame, pre: int = 1, post: int = 1, coarse_sweeps: int = 12, at: int = 0) -> DataFrame:
    """One V-cycle for A x = b; each level's vectors are written to the shared folder."""
    a, p = levels[at]
    folder = work_dir(a.sparkSession, f"vcycle{at}")
    if p is None:
        for k in range(coarse_sweeps // 4):
            x = saved(jacobi(a, b, x, 4), f"{folder}/c{k}")
        return x
    x = saved(jacobi(a, b, x, pre), f"{folder}/pre")
    r = b.withColumnRenamed("x", "b").join(times(a, x), "id", "left").select("id", (F.col("b") - F.coalesce("x", F.lit(0.0))).alias("x"))
    coarse_b = saved(times(transposed(p), r), f"{folder}/rb")
    e = v_cycle(levels, coarse_b, coarse_b.select("id", F.lit(0.0).alias("x")), pre, post, coarse_sweeps, at + 1)
    up = times(p, e).withColumnRenamed("x", "e")
    x = saved(x.join(up, "id", "left").select("id", (F.col("x") + F.coalesce("e", F.lit(0.0))).alias("x")), f"{folder}/up")
    return saved(jacobi(a, b, x, post), f"{folder}/post")


def residual_norm(a: DataFrame, b: DataFrame, x: DataFrame) -> float:
    r = b.withColumnRenamed("x", "b").join(times(a, x), "id", "left").select((F.col("b") - F.coalesce("x", F.lit(0.0))).alias("r"))
    return float(r.agg(F.sqrt(F.sum(F.col("r") * F.col("r")))).first()[0] or 0.0)
