"""Aggregations and information measures of graphs and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


def entropy(df: DataFrame, column: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of a multiset: H = log2 N - sum(c log2 c) / N."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return c.agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias(name))


def degree_entropy(g: Graph, kind: str = "in_degree") -> DataFrame:
    """Entropy of the degree histogram normalised by the sum of degrees, not by the number of vertices."""
    d = (g.in_degrees() if kind == "in_degree" else g.out_degrees()).groupBy(F.col(kind).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    both = d.agg(F.sum(F.col("d") * F.col("c")).alias("s"), F.collect_list("c").alias("cs"))
    term = lambda c: -(c / F.col("s")) * F.log2(c / F.col("s"))
    return both.select(F.aggregate("cs", F.lit(0.0), lambda a, c: a + term(c.cast("double"))).alias("degree_entropy"))


def delta_stream(g: Graph) -> DataFrame:
    """(value): for each vertex its first neighbour + 1, its gaps, and 1 as a stop."""
    w = Window.partitionBy("src").orderBy("dst")
    gaps = g.edges.select(F.coalesce(F.col("dst") - F.lag("dst").over(w), F.col("dst") + 1).alias("value"))
    return gaps.unionByName(g.vertices.select(F.lit(1).cast("long").alias("value")))


def graph_entropy(g: Graph, unit: str = "bits_per_edge", encoding: str = "raw") -> DataFrame:
    """bits_per_vertex: H(in) + H(out); bits_per_edge: raw (destinations), delta (the delta stream), optimal (heuristic)."""
    if unit == "bits_per_vertex":
        a, b = degree_entropy(g, "in_degree"), degree_entropy(g, "out_degree").withColumnRenamed("degree_entropy", "o")
        return a.join(F.broadcast(b)).select((F.col("degree_entropy") + F.col("o")).alias("entropy"))
    if encoding == "raw":
        return entropy(g.edges, "dst")
    if encoding == "delta":
        return entropy(delta_stream(g), "value")
    x = entropy(delta_stream(g), "value").join(F.broadcast(g.vertices.agg(F.count(F.lit(1)).alias("n")))).join(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("m"))))
    h = F.col("entropy")
    less = F.lit(0.10) * F.log2(F.greatest(F.col("n"), F.lit(1))) / 10 + F.lit(0.05) * F.log2(F.greatest(F.col("m") / F.col("n"), F.lit(1.0)))
    return x.select(F.greatest(h - less, F.lit(0.1)).alias("entropy"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient, from value counts, so that no task ranks all rows: (2 sum i x_i)/(n sum x) - (n+1)/n."""
    c = df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    weighted = F.sum(F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    out = ranked.agg(weighted.alias("s"), F.sum(F.col("x") * F.col("c")).alias("t"), F.sum("c").alias("n"))
    g = 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")
    return out.select(F.when((F.col("n") > 0) & (F.col("t") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).otherwise(0.0).alias("gini"))


def modularity(g: Graph, labels: DataFrame) -> DataFrame:
    """Directed: sum of e_c - out_c * in_c; undirected: e_c - a_c^2. ``labels(id, label)``."""
    one = labels.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    two = labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    e = g.edges.join(one, "src").join(two, "dst")
    pairs = e.groupBy("ls", "ld").agg(F.count(F.lit(1)).alias("k"))
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("ls").alias("label"), F.col("k").alias("o"), F.lit(0).cast("long").alias("i"), F.when(F.col("ls") == F.col("ld"), F.col("k")).otherwise(0).alias("own")),
        F.struct(F.col("ld").alias("label"), F.lit(0).cast("long").alias("o"), F.col("k").alias("i"), F.lit(0).cast("long").alias("own")))).alias("x")).select("x.*")
    c = ends.groupBy("label").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("own").alias("own"))
    m = pairs.agg(F.sum("k").alias("m"))
    return c.join(F.broadcast(m)).agg(F.sum(F.col("own") / F.col("m") - (F.col("o") / F.col("m")) * (F.col("i") / F.col("m"))).alias("modularity"))


def cluster_density(g: Graph, labels: DataFrame) -> DataFrame:
    """(label, size, density): arcs inside over n(n-1), halved for undirected graphs' pairs; 0 for singletons."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    e = g.edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("label")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    inside = e.filter("label = ld and src <> dst").groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    pairs = F.col("size") * (F.col("size") - 1)
    return n.join(inside, "label", "left").select("label", "size", F.when(pairs > 0, F.coalesce("k", F.lit(0)) / pairs).otherwise(0.0).alias("density"))


def window_overlaps(g: Graph, window: int) -> DataFrame:
    """(id, ref, d, overlap): shared neighbours with predecessors at distance 1..window."""
    a = g.edges.select(F.col("src").alias("id"), "dst")
    b = g.edges.select(F.col("src").alias("ref"), "dst", F.floor(F.col("src") / window).alias("blk"))
    # an equi-join on neighbour and id block keeps a hub from pairing all its parents
    cells = a.withColumn("blk", F.explode(F.array(F.floor(F.col("id") / window), F.floor(F.col("id") / window) - 1)))
    x = cells.join(b, ["dst", "blk"]).filter((F.col("id") > F.col("ref")) & (F.col("id") - F.col("ref") <= window))
    return x.groupBy("id", "ref").agg(F.count(F.lit(1)).alias("overlap")).withColumn("d", F.col("id") - F.col("ref"))


def best_reference(g: Graph, window: int, nearest: bool = True) -> DataFrame:
    """(id, ref, d, overlap) of the predecessor of largest overlap; ties go to the nearest (or farthest)."""
    w = Window.partitionBy("id").orderBy(F.desc("overlap"), F.col("d") if nearest else F.desc("d"))
    return window_overlaps(g, window).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def gaps(g: Graph) -> DataFrame:
    """(src, dst, gap): gap to the former neighbour, null at the first."""
    w = Window.partitionBy("src").orderBy("dst")
    return g.edges.withColumn("gap", F.col("dst") - F.lag("dst").over(w))


def runs(g: Graph) -> DataFrame:
    """(src, start, length): maximal runs of consecutive neighbours."""
    w = Window.partitionBy("src").orderBy("dst")
    x = g.edges.withColumn("key", F.col("dst") - F.row_number().over(w))
    return x.groupBy("src", "key").agg(F.min("dst").alias("start"), F.count(F.lit(1)).alias("length")).drop("key")


def intervals(g: Graph, least: int = 4) -> DataFrame:
    return runs(g).filter(F.col("length") >= least)


def gap_runs(g: Graph, least: int = 3) -> DataFrame:
    """(src, gap, length): maximal runs of at least ``least`` equal gaps."""
    w, v = Window.partitionBy("src").orderBy("dst"), Window.partitionBy("src", "gap").orderBy("dst")
    x = gaps(g).filter("gap is not null").withColumn("key", F.row_number().over(w) - F.row_number().over(v))
    return x.groupBy("src", "gap", "key").agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("key")


def consecutive_metrics(g: Graph, window: int = 64) -> DataFrame:
    """Mean Jaccard and overlap with the vertex before; share and mean distance of best references."""
    d = g.out_degrees()
    prev = window_overlaps(g, 1).select("id", F.col("overlap").alias("o"))
    pairs = d.join(d.select((F.col("id") + 1).alias("id"), F.col("out_degree").alias("before")), "id").join(prev, "id", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    union = F.col("out_degree") + F.col("before") - F.col("o")
    a = pairs.agg(F.avg(F.when(union > 0, F.col("o") / union).otherwise(0.0)).alias("mean_jaccard"), F.avg("o").alias("mean_overlap"))
    best = best_reference(g, window).agg(F.count(F.lit(1)).alias("k"), F.avg("d").alias("mean_distance"))
    n = g.vertices.agg(F.count(F.lit(1)).alias("n"))
    return a.join(F.broadcast(best)).join(F.broadcast(n)).select("mean_jaccard", "mean_overlap", (F.col("k") / F.col("n")).alias("ref_share"), F.coalesce("mean_distance", F.lit(0.0)).alias("mean_distance"))


def gap_metrics(g: Graph) -> DataFrame:
    """Shares of gaps of 1, up to 4 and up to 16, their mean, and the entropy of gaps capped at 10000."""
    x = gaps(g).filter("gap is not null")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = x.agg(share(F.col("gap") == 1).alias("gap1"), share(F.col("gap") <= 4).alias("gap4"), share(F.col("gap") <= 16).alias("gap16"), F.avg("gap").alias("mean_gap"))
    return a.join(F.broadcast(entropy(x.withColumn("g", F.least("gap", F.lit(10_000))), "g", "gap_entropy")))


def _inverse_sigmoid(x: Column, middle: float, steep: float) -> Column:
    return 1.0 / (1.0 + F.exp(steep * (x - middle)))


def compressibility(g: Graph, window: int = 64) -> DataFrame:
    """The weighted five-part score over all vertices from the second on."""
    x = gaps(g).filter("gap is not null")
    h = entropy(x.withColumn("g", F.least("gap", F.lit(10_000))), "g", "h").join(F.broadcast(x.agg(F.avg(F.log2(F.col("gap") + 0.0)).alias("lg"))))
    best = best_reference(g, window)
    copied = best.agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("copied"))
    left = g.edges.join(best.select(F.col("id").alias("src"), "ref"), "src", "left")
    shared = g.edges.select(F.col("src").alias("ref"), "dst", F.lit(True).alias("hit"))
    residual = left.join(shared, ["ref", "dst"], "left").filter("hit is null").select("src", "dst")
    w = Window.partitionBy("src").orderBy("dst")
    r = residual.withColumn("gap", F.col("dst") - F.lag("dst").over(w)).agg(F.count(F.lit(1)).alias("residuals"), F.avg(F.when(F.col("gap").isNotNull(), F.when(F.col("gap") == 1, 1.0).otherwise(0.0))).alias("r1"))
    nm = g.vertices.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("m"))))
    t = h.join(F.broadcast(copied)).join(F.broadcast(r)).join(F.broadcast(nm))
    s5 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("residuals") / F.col("n")) / (F.col("m") / F.col("n"))))
    raw = 0.30 * _inverse_sigmoid(F.col("h"), 6, 0.6) + 0.20 * F.col("copied") / F.col("m") + 0.15 * _inverse_sigmoid(F.col("lg"), 5, 0.7) + 0.20 * F.coalesce("r1", F.lit(0.0)) + 0.15 * s5
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - 0.03) / 0.79 * 0.93 + 0.02))
    return t.select(F.when(F.col("m") > 0, score).otherwise(0.0).alias("compressibility"))


def ordering_metrics(g: Graph, window: int = 7, least: int = 4) -> DataFrame:
    """Mean log2(gap+1), successor distance, interval coverage, and best-reference (farthest wins) overlap, Jaccard, copy share."""
    x = gaps(g)
    a = x.agg(F.avg(F.log2(F.col("gap") + 1.0)).alias("log_gap"), F.avg(F.abs(F.col("dst") - F.col("src"))).alias("distance"), F.count(F.lit(1)).alias("m"))
    c = intervals(g, least).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("inside"))
    d = g.out_degrees()
    best = best_reference(g, window, nearest=False).join(d, "id").join(d.select(F.col("id").alias("ref"), F.col("out_degree").alias("dr")), "ref")
    b = best.agg(F.avg("overlap").alias("ref_overlap"), F.avg(F.col("overlap") / (F.col("out_degree") + F.col("dr") - F.col("overlap"))).alias("ref_jaccard"), F.sum("overlap").alias("copied"))
    t = a.join(F.broadcast(c)).join(F.broadcast(b))
    return t.select("log_gap", "distance", (F.col("inside") / F.col("m")).alias("interval_share"), "ref_overlap", "ref_jaccard", (F.coalesce("copied", F.lit(0)) / F.col("m")).alias("copy_share"))


def degree_autocorrelation(g: Graph) -> DataFrame:
    """(autocorrelation): of out-degrees of vertices whose ids follow one another; 0 without variation."""
    d = g.out_degrees()
    x = d.join(d.select((F.col("id") + 1).alias("id"), F.col("out_degree").alias("before")), "id")
    m = d.agg(F.avg("out_degree").alias("mean"), F.var_pop("out_degree").alias("var"), F.count(F.lit(1)).alias("n"))
    c = x.join(F.broadcast(m)).agg(F.sum((F.col("out_degree") - F.col("mean")) * (F.col("before") - F.col("mean"))).alias("c"))
    r = F.when((F.col("var") > 0) & (F.col("n") > 1), F.coalesce("c", F.lit(0.0)) / ((F.col("n") - 1) * F.col("var"))).otherwise(0.0)
    return c.join(F.broadcast(m)).select(r.alias("autocorrelation"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, first, second, difference) of two one-row tables of metrics."""
    names = [c for c in a.columns if c in b.columns]
    rows = lambda d, n: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(n)) for c in names])).alias("x")).select("x.*")
    return rows(a, "first").join(rows(b, "second"), "metric").withColumn("difference", F.col("second") - F.col("first"))


def dense_enough(g: Graph, labels: DataFrame, least: float) -> DataFrame:
    """(stop): whether every cluster reaches a density, so that coarsening may end."""
    return cluster_density(g, labels).agg(F.coalesce(F.min("density") >= least, F.lit(True)).alias("stop"))
