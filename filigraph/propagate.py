"""Feature propagation over graphs, heads on the propagated features, and vector neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .operators.basic import symmetric_normalised, transition
from .runtime import saved, work_dir


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(id, x): matrix(i, j, w) times x(id, x)."""
    return matrix.join(x, F.col("j") == F.col("id")).groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def appnp(g: Graph, start: DataFrame, k: int = 10, alpha: float = 0.15, symmetric: bool = True) -> DataFrame:
    """(id, x): x <- alpha start + (1 - alpha) A x, k times; ``start(id, x)``."""
    folder = work_dir(g.edges.sparkSession, "appnp")
    a = saved(symmetric_normalised(g) if symmetric else transition(g.reverse(), "col"), f"{folder}/a")
    base = saved(g.vertices.join(start.select("id", F.col("x").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("b")), f"{folder}/b")
    x = base.select("id", F.col("b").alias("x"))
    for i in range(k):
        x = base.join(spmv(a, x), "id", "left").select("id", (alpha * F.col("b") + (1 - alpha) * F.coalesce("x", F.lit(0.0))).alias("x"))
        if i % 4 == 3:
            x = saved(x, f"{folder}/{i}")
    return x


def generalised(g: Graph, start: DataFrame, weights: list[float]) -> DataFrame:
    """(id, x): sum over k of weights[k] A^k start."""
    folder = work_dir(g.edges.sparkSession, "gpr")
    a = saved(symmetric_normalised(g), f"{folder}/a")
    x = saved(g.vertices.join(start.select("id", F.col("x").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("x")), f"{folder}/0")
    out = x.select("id", (weights[0] * F.col("x")).alias("y"))
    for k, w in enumerate(weights[1:], 1):
        x = g.vertices.join(spmv(a, x), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))
        x = saved(x, f"{folder}/{k}")
        out = out.join(x, "id").select("id", (F.col("y") + w * F.col("x")).alias("y"))
    return out.withColumnRenamed("y", "x")


def directed_matrix(g: Graph, loops: bool = True) -> DataFrame:
    """(i, j, w): the transposed row-stochastic matrix, with loops unless told otherwise; for scores that follow edges."""
    e = g.edges
    if loops:
        e = e.unionByName(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return e.join(d, "src").select(F.col("dst").alias("i"), F.col("src").alias("j"), (1.0 / F.col("d")).alias("w"))


def central(g: Graph, d: int, k: int = 50, alpha: float = 0.15) -> DataFrame:
    """(id, x): the ``d`` vertices of largest score after ``k`` smoothings of the uniform vector."""
    n = max(1, g.vertices.count())
    return appnp(g, g.vertices.select("id", F.lit(1.0 / n).alias("x")), k, alpha).orderBy(F.desc("x"), "id").limit(d)


def nonlinear(g: Graph, start: DataFrame, k: int, mix: list[list[float]], alpha: float = 0.15) -> DataFrame:
    """(id, h): h <- relu((1 - alpha) (A h) W + alpha start), k times; ``start(id, h array<double>)``, W square and literal."""
    folder = work_dir(g.edges.sparkSession, "nonlinear")
    a = saved(symmetric_normalised(g), f"{folder}/a")
    base = saved(start.select("id", F.col("h").alias("b")), f"{folder}/b")
    size = len(mix)
    h = base.select("id", F.col("b").alias("h"))
    w = F.array(*[F.array(*map(F.lit, map(float, column))) for column in zip(*mix)])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    for i in range(k):
        near = a.join(h, F.col("j") == F.col("id")).groupBy("i").agg(F.array(*[F.sum(F.col("w") * F.get("h", F.lit(c))) for c in range(size)]).alias("s"))
        x = base.join(near, F.col("id") == F.col("i"), "left").withColumn("s", F.coalesce("s", F.array(*[F.lit(0.0)] * size)))
        mixed = F.transform(w, lambda col: dot(F.col("s"), col))
        h = saved(x.select("id", F.zip_with(mixed, "b", lambda m, b: F.greatest((1 - alpha) * m + alpha * b, F.lit(0.0))).alias("h")), f"{folder}/{i}")
    return h


def gated(g: Graph, seeds: DataFrame, gamma: list[float]) -> DataFrame:
    """(id, x): the product over hops k of 1 + gamma[k] (A^k seeds): a multiplicative gate from seed mass."""
    folder = work_dir(g.edges.sparkSession, "gate")
    a = saved(symmetric_normalised(g), f"{folder}/a")
    x = g.vertices.join(seeds.select("id", "x"), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))
    out = g.vertices.select("id", F.lit(1.0).alias("y"))
    for k, c in enumerate(gamma):
        if k:
            x = saved(g.vertices.join(spmv(a, x), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x")), f"{folder}/{k}")
        out = out.join(x, "id").select("id", (F.col("y") * (1 + c * F.col("x"))).alias("y"))
    return out.withColumnRenamed("y", "x")


def readout(h: DataFrame, groups: DataFrame, size: int, kind: str = "mean") -> DataFrame:
    """(graph, h): vectors ``h(id, h)`` pooled over ``groups(graph, id, w)``: mean, max, sum, or mean weighted by w (seed)."""
    x = groups.join(h, "id")
    v = lambda c: F.get("h", F.lit(c))
    pools = {"mean": lambda c: F.avg(v(c)), "max": lambda c: F.max(v(c)), "sum": lambda c: F.sum(v(c)), "seed": lambda c: F.sum(F.col("w") * v(c)) / F.sum("w")}
    if kind == "seed_multi":  # three pools of one vector in a row
        cells = [pools[p](c) for p in ("mean", "max", "seed") for c in range(size)]
    else:
        cells = [pools[kind](c) for c in range(size)]
    return x.groupBy("graph").agg(F.array(*cells).alias("h"))


def degree_features(g: Graph) -> DataFrame:
    """(id, log_in, log_out, in_share)."""
    d = g.in_degrees().join(g.out_degrees(), "id")
    total = F.col("in_degree") + F.col("out_degree")
    return d.select("id", F.log1p("in_degree").alias("log_in"), F.log1p("out_degree").alias("log_out"), F.when(total > 0, F.col("in_degree") / total).otherwise(0.0).alias("in_share"))


def propagated_features(g: Graph, features: DataFrame, columns: list[str], hops: int) -> DataFrame:
    """Adds to each column its means over 1..hops in-neighbourhoods (``name_k``)."""
    e = g.edges
    out = now = features.select("id", *columns)
    for k in range(1, hops + 1):
        now = e.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("v")).agg(*[F.avg(c).alias(c) for c in columns])
        now = features.select("id").join(now, F.col("id") == F.col("v"), "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
        out = out.join(now.select("id", *[F.col(c).alias(f"{c}_{k}") for c in columns]), "id")
    return out


def classify(train: DataFrame, test: DataFrame, columns: list[str], label: str = "label", max_iter: int = 50) -> DataFrame:
    """(id, prediction): a multinomial logistic head on feature columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_v")
    m = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=max_iter, regParam=0.01).fit(v.transform(train.withColumn(label, F.col(label).cast("double"))))
    return m.transform(v.transform(test)).select("id", F.col("prediction").cast("int").alias("prediction"))


def scores(predicted: DataFrame, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, n)."""
    c = predicted.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy(F.col(truth).alias("label")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("c")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col(guess).alias("label")).agg(F.sum("c").alias("np"))
    x = t.join(p, "label", "left").withColumn("np", F.coalesce("np", F.lit(0)))
    pr, rc = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.col("tp") / F.col("n")
    return x.select("label", pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"), "n")


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, dim, mean)."""
    return vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
