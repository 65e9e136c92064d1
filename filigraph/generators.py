"""Seeded random graphs; all draws are hashes of (seed, ids), so any plan gives the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph


def unit(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 7) -> Graph:
    """Directed G(n, p) without loops: geometric skips inside each row keep the cost at the number of edges."""
    v = _vertices(spark, n)
    if p <= 0:
        return Graph(v.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0), v)
    # number of draws per row: enough skips to pass the row's end with overwhelming probability
    k = int(n * p + 8 * (n * p) ** 0.5 + 16)
    skip = (F.floor(F.log(1 - unit(F.lit(seed), "id", "k")) / F.log(F.lit(1 - min(p, 1 - 1e-12)))) + 1).cast("long")
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = v.select("id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")).withColumn("dst", F.sum(skip).over(w))
    return Graph(e.filter((F.col("dst") <= n) & (F.col("dst") != F.col("id"))).select(F.col("id").alias("src"), "dst"), v)


def random_out(spark: SparkSession, n: int, k: int, seed: int = 7) -> Graph:
    """About k distinct out-edges for each vertex."""
    v = _vertices(spark, n)
    e = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")).withColumn("dst", (F.floor(unit(F.lit(seed), "src", "k") * n) + 1).cast("long"))
    return Graph.of(e.filter("src <> dst"), v)


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = 7) -> Graph:
    """Ring lattice of k neighbours, each edge rewired with probability beta; undirected."""
    v = _vertices(spark, n)
    e = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    ring = F.pmod(F.col("src") - 1 + F.col("j"), F.lit(n)) + 1
    other = F.floor(unit(F.lit(seed + 1), "src", "j") * n).cast("long") + 1
    e = e.withColumn("dst", F.when(unit(F.lit(seed), "src", "j") < beta, other).otherwise(ring))
    return Graph.of(e.filter("src <> dst"), v, directed=False)


def preferential(spark: SparkSession, n: int, m: int, seed: int = 7) -> Graph:
    """Scale-free: vertex t links to m earlier ones, drawn as the end of a random earlier link (the copying model)."""
    v = _vertices(spark, n)
    e = v.filter("id > 1").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(m))).alias("j"))
    # a link's end is resolved by following random earlier links a fixed number of times
    at = F.col("src")
    for hop in range(4):
        prev = F.floor(unit(F.lit(seed), at, "j", F.lit(hop)) * (at - 1)).cast("long") + 1
        at = F.when((at > 1) & ((F.lit(hop) == 0) | (unit(F.lit(seed + 1), at, "j", F.lit(hop)) < 0.5)), prev).otherwise(at)
    return Graph.of(e.select("src", at.alias("dst")).filter("src <> dst"), v, directed=False)


def blocks(spark: SparkSession, sizes: list[int], p_in: float, p_out: float, seed: int = 7) -> tuple[Graph, DataFrame]:
    """Stochastic block model for small n (n^2 draws), and the labels."""
    n = sum(sizes)
    label, at = F.lit(len(sizes)), n
    for i in range(len(sizes) - 1, 0, -1):
        at -= sizes[i]
        label = F.when(F.col("id") <= at, i).otherwise(label)
    v = _vertices(spark, n)
    lab = v.select("id", label.cast("long").alias("label"))
    pair = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("dst")).filter("src <> dst")
    x = pair.join(F.broadcast(lab.toDF("src", "a")), "src").join(F.broadcast(lab.toDF("dst", "b")), "dst")
    return Graph(x.filter(unit(F.lit(seed), "src", "dst") < F.when(F.col("a") == F.col("b"), p_in).otherwise(p_out)).select("src", "dst"), v), lab


def power_law(spark: SparkSession, k: float, n: int, low: int, high: int, seed: int = 7) -> DataFrame:
    """(id, value): n draws of x^-k on [low, high] by the continuous inverse law."""
    u = unit(F.lit(seed), "id")
    a, b = float(low) ** (1 - k), float(high + 1) ** (1 - k)
    x = F.pow(a + u * (b - a), 1 / (1 - k)) if k != 1 else F.exp(F.log(F.lit(float(low))) + u * F.log(F.lit((high + 1) / low)))
    return _vertices(spark, n).select("id", F.least(F.greatest(F.floor(x), F.lit(low)), F.lit(high)).cast("long").alias("value"))


def web_graph(spark: SparkSession, n: int, mean_out: int, seed: int = 7) -> Graph:
    """Out-links mean +- 2, 70 % of them to near ids (at most 100 away), the others anywhere."""
    v = _vertices(spark, n)
    k = mean_out - 2 + F.floor(unit(F.lit(seed), "id") * 5).cast("int")
    e = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).alias("j"))
    u = unit(F.lit(seed + 1), "src", "j")
    g = F.sqrt(-2 * F.log(1 - unit(F.lit(seed + 2), "src", "j"))) * F.abs(F.cos(6.283185307179586 * unit(F.lit(seed + 3), "src", "j")))
    step = F.least(F.lit(100), 1 + F.floor(5 * g)).cast("long") * F.when(unit(F.lit(seed + 4), "src", "j") < 0.5, -1).otherwise(1)
    far = F.floor(unit(F.lit(seed + 5), "src", "j") * n).cast("long") + 1
    e = e.withColumn("dst", F.when(u < 0.7, F.col("src") + step).otherwise(far))
    return Graph.of(e.filter(f"src <> dst and dst between 1 and {n}"), v)


def ring(spark: SparkSession, n: int) -> Graph:
    v = _vertices(spark, n)
    return Graph(v.select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst")), v)


def clique(spark: SparkSession, n: int) -> Graph:
    v = _vertices(spark, n)
    e = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("dst"))
    return Graph(e.filter("src <> dst"), v)


def modular_hubs(spark: SparkSession, n: int, k: int, p_in: float = 0.1, p_out: float = 0.01, hub_share: float = 0.05, p_hub: float = 0.5, seed: int = 7) -> tuple[Graph, DataFrame]:
    """k modules of a block model; each module's first ``hub_share`` of vertices link to all hubs with ``p_hub``. And the labels."""
    sizes = [n // k + (i < n % k) for i in range(k)]
    g, lab = blocks(spark, sizes, p_in, p_out, seed)
    from pyspark.sql import Window

    first = lab.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    hubs = first.filter(F.col("r") <= max(1, int(hub_share * (n // k)))).select("id", "label")
    every = hubs.agg(F.collect_list("id").alias("ids"))  # at most hub_share of the vertices
    pair = hubs.select(F.col("id").alias("src")).join(F.broadcast(every)).select("src", F.explode("ids").alias("dst")).filter("src <> dst")
    extra = pair.filter(unit(F.lit(seed + 1), "src", "dst") < p_hub)
    return Graph.of(g.edges.unionByName(extra), g.vertices), lab


def lfr(spark: SparkSession, n: int, tau_degree: float = 2.5, tau_size: float = 1.5, mixing: float = 0.1, mean_degree: int = 10, max_degree: int = 50, least: int = 20, most: int = 100, seed: int = 7) -> tuple[Graph, DataFrame]:
    """Power-law degrees and community sizes with a share ``mixing`` of links leaving the community; and the labels.

    Community sizes are drawn on the driver (one number a community); degrees, and the
    ends of links, are hashes, so edges are made where their source is: a link's end is a
    uniform member of the own community, or of all vertices.
    """
    import numpy as np

    r = np.random.default_rng(seed)
    starts, at = [1], 1
    while at <= n:
        u = r.random()
        a, b = float(least) ** (1 - tau_size), float(most) ** (1 - tau_size)
        at += int((a + u * (b - a)) ** (1 / (1 - tau_size)))
        starts.append(at)
    starts[-1] = n + 1
    if len(starts) > 2 and starts[-1] - starts[-2] < least:  # the last one is too small
        del starts[-2]
    rows = [(i, a, b - a) for i, (a, b) in enumerate(zip(starts, starts[1:]), 1)]
    sizes = spark.createDataFrame(rows, "label long, first long, size long")
    lab = sizes.select("label", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("id"), "first", "size")
    # degrees: power law from the least that gives the mean, cut at the maximum
    low = max(1.0, mean_degree * (tau_degree - 2) / (tau_degree - 1)) if tau_degree > 2 else 1.0
    a, b = low ** (1 - tau_degree), float(max_degree + 1) ** (1 - tau_degree)
    degree = F.greatest(F.lit(1), F.floor(F.pow(a + unit(F.lit(seed), "id") * (b - a), 1 / (1 - tau_degree)))).cast("int")
    e = lab.withColumn("j", F.explode(F.sequence(F.lit(1), degree)))
    inside = unit(F.lit(seed + 1), "id", "j") >= mixing
    own = F.col("first") + F.floor(unit(F.lit(seed + 2), "id", "j") * F.col("size")).cast("long")
    far = F.floor(unit(F.lit(seed + 3), "id", "j") * n).cast("long") + 1
    e = e.select(F.col("id").alias("src"), F.when(inside, own).otherwise(far).alias("dst")).filter("src <> dst")
    return Graph.of(e, _vertices(spark, n)), lab.select("id", "label")


def training_batch(spark: SparkSession, low: int = 500, high: int = 2000, size: int = 16, seed: int = 7) -> list[tuple[str, Graph]]:
    """Random, scale-free, block and web graphs by turns, of seeded sizes."""
    import numpy as np

    r = np.random.default_rng(seed)
    out = []
    for i in range(size):
        n = int(r.integers(low, high + 1))
        kind = ("random", "scale_free", "blocks", "web")[i % 4]
        if kind == "random":
            g = erdos_renyi(spark, n, 8.0 / n, seed + i)
        elif kind == "scale_free":
            g = preferential(spark, n, 4, seed + i)
        elif kind == "blocks":
            g = blocks(spark, [n // 4] * 4, 0.05, 0.005, seed + i)[0]
        else:
            g = web_graph(spark, n, 8, seed + i)
        out.append((kind, g))
    return out
