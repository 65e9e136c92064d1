"""Iterative ranking: PageRank, personalised and weighted variants, push, eigenvector centrality.

Each iteration is a join on the source and an aggregation by the target; scores
are written to the shared folder every ``cut`` iterations, which bounds the plan and
lets a job survive lost executors.  Edges carry their weight from the start, so
an iteration joins two tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import saved, work_dir


def _weights(g: Graph, weights: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): out-edges' shares; missing weights are 1, vertices without strength pass nothing on."""
    e = g.edges.withColumn("w", F.lit(1.0)) if weights is None else g.edges.join(weights.select("src", "dst", F.col("w").cast("double").alias("w")), ["src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    total = e.groupBy("src").agg(F.sum("w").alias("t")).filter("t > 0")
    return e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w"))


def power_iteration(g: Graph, restart: DataFrame, start: DataFrame, damping: float = 0.85, epsilon: float = 1e-6, max_iter: int = 100,
                    weights: DataFrame | None = None, dangling: str = "drop", cut: int = 4) -> DataFrame:
    """(id, score): x' = (1 - d) restart + d W'x until the largest change is at most ``epsilon``.

    ``restart(id, r)`` sums to 1; ``start(id, score)``.  ``dangling``: ``drop`` loses the mass
    of sinks, ``redistribute`` returns it by ``restart``.
    """
    spark = g.edges.sparkSession
    folder = work_dir(spark, "rank")
    w = saved(_weights(g, weights).repartition("src"), f"{folder}/w")
    base = saved(g.vertices.join(restart, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r")), f"{folder}/r")
    x = base.join(start, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    idle = g.vertices.join(w.select(F.col("src").alias("id")), "id", "left_anti") if dangling == "redistribute" else None
    for k in range(max_iter):
        old = x
        passed = w.join(old.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        x = base.join(passed, "id", "left")
        gain = (1 - damping) * F.col("r") + damping * F.coalesce("s", F.lit(0.0))
        if idle is not None:
            lost = old.join(idle, "id", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
            x = x.join(F.broadcast(lost))
            gain = gain + damping * F.col("lost") * F.col("r")
        x = x.select("id", gain.alias("score"))
        if epsilon <= 0 and k < max_iter - 1 and (k + 1) % cut:
            continue
        if epsilon <= 0 and k == max_iter - 1:
            break
        x = saved(x, f"{folder}/x{k}")
        if epsilon > 0:
            change = x.join(old.withColumnRenamed("score", "o"), "id").agg(F.max(F.abs(F.col("score") - F.col("o")))).first()[0]
            if change is None or change <= epsilon:
                break
    return x


def _uniform(g: Graph, name: str) -> DataFrame:
    n = max(1, g.vertices.count())
    return g.vertices.withColumn(name, F.lit(1.0 / n))


def pagerank(g: Graph, damping: float = 0.85, epsilon: float = 1e-6, max_iter: int = 100, dangling: str = "drop", start: DataFrame | None = None) -> DataFrame:
    return power_iteration(g, _uniform(g, "r"), start or _uniform(g, "score"), damping, epsilon, max_iter, dangling=dangling)


def personalised(g: Graph, seeds: DataFrame, damping: float = 0.85, epsilon: float = 1e-6, max_iter: int = 100, weights: DataFrame | None = None) -> DataFrame:
    """Restart only at ``seeds(id)``, equally; starts from the seeds."""
    s = seeds.select("id").distinct()
    n = max(1, s.count())
    return power_iteration(g, s.withColumn("r", F.lit(1.0 / n)), s.withColumn("score", F.lit(1.0 / n)), damping, epsilon, max_iter, weights)


def path_scores(g: Graph, s: int, t: int, damping: float = 0.85, epsilon: float = 1e-6, max_iter: int = 100, weights: DataFrame | None = None) -> DataFrame:
    """(id, forward, backward, product): scores from s along edges and from t against them."""
    one = lambda v: g.edges.sparkSession.createDataFrame([(v,)], "id long")
    back = None if weights is None else weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    a = personalised(g, one(s), damping, epsilon, max_iter, weights).withColumnRenamed("score", "forward")
    b = personalised(g.reverse(), one(t), damping, epsilon, max_iter, back).withColumnRenamed("score", "backward")
    return a.join(b, "id").withColumn("product", F.col("forward") * F.col("backward"))


def monte_carlo(g: Graph, cycles: int, damping: float = 0.85, seed: int = 7, max_steps: int = 60) -> DataFrame:
    """Visit shares of ``cycles`` walks from every vertex, each stopping with probability 1 - damping or at a sink."""
    spark = g.edges.sparkSession
    folder = work_dir(spark, "walks")
    lists = saved(g.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs")), f"{folder}/lists")
    unit = lambda *c: F.shiftrightunsigned(F.xxhash64(*c, F.lit(seed)), 11) / float(1 << 53)
    now = g.vertices.select("id", F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("walk"), F.col("id").alias("start"))
    visits = now.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    k = 0
    while k < max_steps:
        k += 1
        go = now.filter(unit("start", "walk", F.lit(2 * k)) < damping).join(lists, F.col("id") == F.col("src"))
        at = F.floor(unit("start", "walk", F.lit(2 * k + 1)) * F.size("nbrs")).cast("int")
        now = saved(go.select(F.get("nbrs", at).alias("id"), "walk", "start"), f"{folder}/{k}")
        if not now.limit(1).count():
            break
        visits = saved(visits.unionByName(now.groupBy("id").agg(F.count(F.lit(1)).alias("n"))).groupBy("id").agg(F.sum("n").alias("n")), f"{folder}/v{k}")
    total = visits.agg(F.sum("n").alias("t"))
    return visits.join(F.broadcast(total)).select("id", (F.col("n") / F.col("t")).alias("score"))


def push(g: Graph, seeds: DataFrame, alpha: float = 0.15, epsilon: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, p, r): approximate personalised scores; all vertices with r/deg >= epsilon push at once.

    On return every residual is below epsilon times the degree (sinks keep theirs).
    """
    spark = g.edges.sparkSession
    folder = work_dir(spark, "push")
    d = saved(g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")), f"{folder}/d")
    s = seeds.select("id").distinct()
    now = s.select("id", F.lit(0.0).alias("p"), F.lit(1.0 / max(1, s.count())).alias("r"))
    for k in range(max_rounds):
        x = saved(now.join(d, F.col("id") == F.col("src"), "left").select("id", "p", "r", "d", (F.col("d").isNotNull() & (F.col("r") / F.col("d") >= epsilon)).alias("go")), f"{folder}/{k}")
        if not x.filter("go").limit(1).count():
            return x.select("id", "p", "r")
        sent = x.filter("go").join(g.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(0.0).alias("p"), ((1 - alpha) * F.col("r") / F.col("d")).alias("r"))
        stay = x.select("id", F.when(F.col("go"), F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("go"), 0.0).otherwise(F.col("r")).alias("r"))
        now = stay.unionByName(sent).groupBy("id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return now


def eigenvector(g: Graph, iterations: int = 30) -> DataFrame:
    """Eigenvector centrality of the undirected projection, largest entry 1; empty below three vertices."""
    u = g.undirected().kept("eigen")
    spark = g.edges.sparkSession
    folder = work_dir(spark, "eigen")
    x = u.vertices.withColumn("score", F.lit(1.0))
    for k in range(iterations):
        y = u.edges.join(x, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("score").alias("s"))
        y = x.join(y, F.col("id") == F.col("dst"), "left").select("id", (F.coalesce("s", F.lit(0.0)) + F.col("score")).alias("score"))
        top = y.agg(F.max("score").alias("t"))
        x = y.join(F.broadcast(top)).select("id", F.when(F.col("t") > 0, F.col("score") / F.col("t")).otherwise(0.0).alias("score"))
        if k % 3 == 2:
            x = saved(x, f"{folder}/{k}")
    return x.join(F.broadcast(u.vertices.agg(F.count(F.lit(1)).alias("n")))).filter("n >= 3").select("id", "score")
