"""Levels, components, cores and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import saved, work_dir


def bfs_levels(g: Graph, start: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(id, level): hops from the nearest of ``start(id)``; unreached vertices are left out.

    One round a level: raises if ``max_levels`` do not reach all there is to reach.
    """
    spark = g.edges.sparkSession
    folder = work_dir(spark, "bfs")
    front = saved(start.select(F.col("id").cast("long")).distinct().withColumn("level", F.lit(0)), f"{folder}/0")
    schema, parts = front.schema, [f"{folder}/0"]
    for t in range(1, max_levels + 1):
        seen = spark.read.schema(schema).parquet(*parts)
        new = g.edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = saved(new.select("id", F.lit(t).alias("level")), f"{folder}/{t}")
        if not front.limit(1).count():
            return seen
        parts.append(f"{folder}/{t}")
    raise RuntimeError(f"{max_levels} levels do not reach every vertex")


def weak_components(g: Graph, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest vertex of each weakly connected component.

    Large-star and small-star rounds in turn: O(log^2 n) of them, each an
    aggregation and a join, whatever the diameter.
    """
    folder = work_dir(g.edges.sparkSession, "wcc")
    now = saved(g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct(), f"{folder}/0")
    mark = None
    for k in range(1, max_rounds):
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = saved(both.join(least, "v").filter("u > v").select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a < b").distinct(), f"{folder}/l{k}")
        low = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        small = large.join(low, F.col("b") == F.col("v")).select("m", F.col("a").alias("u")).unionByName(low.select("m", F.col("v").alias("u")))
        now = saved(small.select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a < b").distinct(), f"{folder}/{k}")
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == (r[0], r[1]):
            break
        mark = r[0], r[1]
    else:
        raise RuntimeError("components did not settle")
    return g.vertices.join(now.select(F.col("b").alias("id"), F.col("a").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def _within(e: DataFrame, v: DataFrame) -> DataFrame:
    """The edges among ``v(id)``."""
    return e.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _trimmed(e: DataFrame, v: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """What is left without vertices that lack an in- or an out-edge, as long as there are few rounds of them."""
    for k in range(4):
        ends = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id")
        rest = saved(v.join(ends, "id", "left_semi"), f"{folder}/v{k}")
        if rest.count() == v.count():
            break
        v, e = rest, saved(_within(e, rest), f"{folder}/e{k}")
    return e, v


def _contracted(e: DataFrame, v: DataFrame, folder: str):
    """Vertices of a single out-edge are merged into the first vertex on their way that has more, by pointer doubling.

    Returns the smaller graph, the components found on the way (rings of such
    vertices), and a function that gives the components of all vertices from those of
    the smaller graph's.  A merged vertex is in its target's component if and only if
    an edge of that component enters its way at or above it.
    """
    lone = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.min("dst").alias("p")).filter("k = 1").select(F.col("src").alias("v"), "p")
    up = saved(lone.withColumn("m", F.least("v", "p")), f"{folder}/p0")
    n = up.count()
    if not n:
        return None
    jumps, rounds = [up], n.bit_length() + 1
    for k in range(1, rounds + 1):
        last = jumps[-1]
        far = last.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("m").alias("mq"))
        up = saved(last.join(far, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.least("m", F.coalesce("mq", "m")).alias("m"), F.col("q").isNotNull().alias("moved")), f"{folder}/p{k}")
        jumps.append(up.drop("moved"))
        if not up.filter("moved").limit(1).count():
            break
    end = jumps[-1]
    ringed = end.join(end.select(F.col("v").alias("p")), "p", "left_semi")  # these never leave the single ones
    ring = saved(end.join(ringed.select(F.col("p").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("id"), F.col("m").alias("component")), f"{folder}/ring")
    root = saved(end.join(ringed.select("v"), "v", "left_anti").select("v", F.col("p").alias("root")), f"{folder}/root")
    single = end.select("v")
    left = saved(v.join(single.withColumnRenamed("v", "id"), "id", "left_anti"), f"{folder}/left")
    out = e.join(single.withColumnRenamed("v", "src"), "src", "left_anti")
    to = out.join(root.withColumnRenamed("v", "dst"), "dst", "left")
    to = to.join(ringed.select(F.col("v").alias("dst")), "dst", "left_anti")
    smaller = saved(to.select("src", F.coalesce("root", "dst").alias("dst")).filter("src <> dst").distinct(), f"{folder}/smaller")

    def undo(found: DataFrame | None) -> DataFrame:
        own = left.select("id", F.col("id").alias("component"))
        comp = own if found is None else left.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        comp = saved(comp, f"{folder}/own")
        c = comp.select(F.col("id").alias("src"), F.col("component").alias("cs"))
        entry = out.join(root.withColumnRenamed("v", "dst"), "dst").join(c, "src").join(c.select(F.col("src").alias("root"), F.col("cs").alias("cr")), "root").filter("cs = cr")
        marked = saved(entry.select(F.col("dst").alias("v")).distinct(), f"{folder}/m")
        for k, j in enumerate(jumps[:-1]):  # all on the way down from a marked one are marked as well
            marked = saved(marked.unionByName(j.join(marked, "v", "left_semi").select(F.col("p").alias("v")).join(root, "v", "left_semi")).distinct(), f"{folder}/m{k}")
        mine = marked.join(root, "v").join(comp.select(F.col("id").alias("root"), "component"), "root").select(F.col("v").alias("id"), "component")
        return saved(comp.unionByName(mine).unionByName(ring), f"{folder}/undone")

    return smaller, left, undo


def strong_components(g: Graph, max_rounds: int = 1000) -> DataFrame:
    """(id, component): smallest vertex of each strongly connected component.

    Vertices without in- or out-edges are trimmed, and chains and rings of vertices of
    one out-edge, then of one in-edge, are contracted by pointer doubling, so that long
    ones take logarithmically many rounds.  What is left takes forward-backward
    colouring: the smallest reaching id spreads forward to a fixed point, and from each
    colour's root the vertices of that colour are collected backward.  Raises if
    ``max_rounds`` do not suffice.
    """
    folder = work_dir(g.edges.sparkSession, "scc")
    e = saved(g.edges.filter("src <> dst"), f"{folder}/e")
    left = saved(g.vertices, f"{folder}/v")
    flip = lambda x: x.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    undos = []
    for turn in range(2):
        e, left = _trimmed(e, left, f"{folder}/trim{turn}")
        got = _contracted(e, left, f"{folder}/way{turn}")
        if got:
            e, left, undo = got
            undos.append(undo)
        e = flip(e)
    done: list[DataFrame] = []
    for k in range(max_rounds):
        e, left = _trimmed(e, left, f"{folder}/t{k}")
        if not e.limit(1).count():
            break
        colour = left.withColumn("c", F.col("id"))
        for j in range(max_rounds):
            near = e.join(colour, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
            new = saved(colour.join(near, F.col("id") == F.col("v"), "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), f"{folder}/c{k}_{j}")
            colour = new.select("id", "c")
            if not new.filter("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"colours did not settle in {max_rounds} rounds")
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = bfs_levels(Graph(saved(inside, f"{folder}/i{k}"), left), colour.filter("id = c").select("id"))
        found = saved(back.join(colour, "id").select("id", F.col("c").alias("component")), f"{folder}/f{k}")
        done.append(found)
        left = saved(left.join(found, "id", "left_anti"), f"{folder}/r{k}")
        e = saved(_within(e, left), f"{folder}/x{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    comp = None
    for d in done:
        comp = d if comp is None else comp.unionByName(d)
    alone = g.vertices.select("id", F.col("id").alias("component"))
    for undo in reversed(undos):
        comp = undo(comp)
    if comp is None:
        return alone
    first = comp.groupBy("component").agg(F.min("id").alias("least"))
    named = comp.join(first, "component").select("id", F.col("least").alias("component"))
    return named.unionByName(alone.join(named, "id", "left_anti"))


def core(g: Graph) -> tuple[Graph, DataFrame]:
    """The largest strongly connected component (ties: smallest label), renumbered, and the mapping."""
    scc = strong_components(g)
    top = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return g.induced_renumbered(scc.join(F.broadcast(top), "component", "left_semi").select("id"))


def k_cores(g: Graph) -> DataFrame:
    """(id, core): deepest k such that the vertex survives peeling by in + out degree below k.

    From the degrees on, each vertex takes the largest k of which it has as many ties to vertices of k or more,
    until nothing changes: that is its core.  A round reads blocks of ties and one number a vertex.
    """
    from .rounds import Rounds

    both = g.edges.unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def step(ids, sizes, ties, values, own, _):
        owner = np.repeat(np.arange(len(ids)), sizes)
        near = np.where(ties == owner + own.start, values.max(), values[ties])  # a loop stays as long as its vertex
        key = (owner << 32) | ((1 << 32) - 1 - near)
        key.sort()
        rank = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        high = ((1 << 32) - 1 - (key & ((1 << 32) - 1))) > rank
        return np.minimum(values[own], np.bincount(owner[high], minlength=len(ids)))

    core = Rounds(both, "cores").run(lambda ids, sizes, at: sizes, step, 1_000_000)
    return g.vertices.join(core, "id", "left").select("id", F.coalesce("value", F.lit(0)).cast("long").alias("core"))


def shortest_path(g: Graph, s: int, t: int, max_levels: int = 10_000) -> DataFrame:
    """(path): one fewest-hop path, the smallest predecessor at each step; no row where there is none.

    Raises if ``max_levels`` do not tell.
    """
    spark = g.edges.sparkSession
    folder = work_dir(spark, "path")
    none = spark.createDataFrame([], "path array<long>")
    front = saved(spark.createDataFrame([(s, None)], "id long, parent long"), f"{folder}/0")
    parts = [f"{folder}/0"]
    for k in range(1, max_levels + 1):
        if front.filter(F.col("id") == t).limit(1).count():
            break
        seen = spark.read.schema(front.schema).parquet(*parts)
        new = g.edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti")
        front = saved(new.select("id", "parent"), f"{folder}/{k}")
        if not front.limit(1).count():
            return none
        parts.append(f"{folder}/{k}")
    else:
        raise RuntimeError(f"{max_levels} levels do not reach the target")
    path = [t]
    for at in reversed(parts[1:]):  # one lookup a level, in that level's table
        path.append(spark.read.schema(front.schema).parquet(at).filter(F.col("id") == path[-1]).first().parent)
    return spark.createDataFrame([(path[::-1],)], "path array<long>")


def greedy_paths(g: Graph, scores: DataFrame, s: int, t: int, k: int = 1, max_steps: int = 10_000) -> DataFrame:
    """(rank, path, bottleneck): up to k paths from s to t, each step to the best-scored unused out-neighbour.

    Later paths avoid the inner vertices of former ones.  ``scores(id, product)``.
    Raises if a path does not end within ``max_steps``.
    """
    spark = g.edges.sparkSession
    used: set[int] = set()
    rows = []
    for rank in range(1, k + 1):
        path, low = [s], float("inf")
        while path[-1] != t and len(path) <= max_steps:
            skip = [*used, *path]
            best = g.edges.filter(F.col("src") == path[-1]).join(scores, F.col("dst") == F.col("id")).filter(~F.col("dst").isin(skip) & (F.col("product") > 0)).orderBy((F.col("dst") != t), F.desc("product"), "dst").select("dst", "product").first()
            if best is None:
                break
            path.append(best.dst)
            low = min(low, best["product"])
        if path[-1] != t:
            if len(path) > max_steps:
                raise RuntimeError(f"a path of over {max_steps} steps")
            break
        rows.append((rank, path, low))
        if not path[1:-1]:
            break
        used.update(path[1:-1])
    return spark.createDataFrame(rows, "rank int, path array<long>, bottleneck double")


def random_walks(g: Graph, start: DataFrame, steps: int, kind: str = "simple", jump: float = 0.0, seed: int = 7) -> DataFrame:
    """(walk, step, id) of one walk from each of ``start(id)``.

    ``simple``: a uniform out-neighbour; ``metropolis``: accepted with min(1, d(u)/d(v)), which
    visits undirected graphs uniformly; with probability ``jump``, or at a sink, back to
    the start.  All walks move at once; draws are hashes of (walk, step, seed).
    """
    folder = work_dir(g.edges.sparkSession, "rw")
    lists = saved(g.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs")), f"{folder}/lists")
    sizes = lists.select(F.col("src").alias("to"), F.size("nbrs").alias("dv"))
    unit = lambda k: F.shiftrightunsigned(F.xxhash64("walk", F.lit(k), F.lit(seed)), 11) / float(1 << 53)
    now = saved(start.select(F.col("id").cast("long").alias("walk"), F.col("id").cast("long").alias("id")), f"{folder}/0")
    out = now.withColumn("step", F.lit(0))
    for k in range(1, steps + 1):
        x = now.join(lists, F.col("id") == F.col("src"), "left")
        to = F.get("nbrs", F.floor(unit(3 * k) * F.size("nbrs")).cast("int"))
        x = x.withColumn("to", F.when(F.col("nbrs").isNull() | (unit(3 * k + 1) < jump), F.col("walk")).otherwise(to))
        if kind == "metropolis":
            x = x.join(sizes, "to", "left")
            x = x.withColumn("to", F.when(unit(3 * k + 2) <= F.size("nbrs") / F.coalesce("dv", F.lit(1)), F.col("to")).otherwise(F.col("id")))
        now = saved(x.select("walk", F.col("to").alias("id")), f"{folder}/{k}")
        out = out.unionByName(now.withColumn("step", F.lit(k)))
    return out.select("walk", "step", "id")


def giant_fraction(g: Graph) -> DataFrame:
    c = weak_components(g).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("giant_fraction"))


def ranked_components(components: DataFrame) -> DataFrame:
    """(component, n, rank) by size descending, smaller label first."""
    n = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "component")))


def scored_walks(g: Graph, start: DataFrame, scores: DataFrame, steps: int, seed: int = 7) -> DataFrame:
    """(walk, step, id): rejection-free walks whose next vertex is drawn in proportion to ``scores(id, s)`` of the neighbours.

    Without a positive score among them the draw is uniform; sinks return to the
    start.  The draw is one weighted hash minimum over the out-edges (exponential
    race), so no neighbour list is collected.
    """
    folder = work_dir(g.edges.sparkSession, "scored")
    e = saved(g.edges.join(scores.select(F.col("id").alias("dst"), "s"), "dst", "left").select("src", "dst", F.coalesce("s", F.lit(0.0)).alias("s")), f"{folder}/e")
    top = e.groupBy("src").agg(F.max("s").alias("top"))
    e = saved(e.join(top, "src").select("src", "dst", F.when(F.col("top") > 0, F.col("s")).otherwise(1.0).alias("s")).filter("s > 0"), f"{folder}/w")
    now = saved(start.select(F.col("id").cast("long").alias("walk"), F.col("id").cast("long").alias("id")), f"{folder}/0")
    out = now.withColumn("step", F.lit(0))
    for k in range(1, steps + 1):
        u = F.greatest(F.shiftrightunsigned(F.xxhash64("walk", "dst", F.lit(k), F.lit(seed)), 11) / float(1 << 53), F.lit(1e-300))
        race = now.join(e, F.col("id") == F.col("src")).withColumn("x", -F.log(u) / F.col("s"))
        step = race.groupBy("walk").agg(F.min_by("dst", F.struct("x", "dst")).alias("to"))
        now = saved(now.select("walk").join(step, "walk", "left").select("walk", F.coalesce("to", "walk").alias("id")), f"{folder}/{k}")
        out = out.unionByName(now.withColumn("step", F.lit(k)))
    return out.select("walk", "step", "id")


def drawn_place(weights: Column, u: Column) -> Column:
    """The place (from 0) of an array of weights that a uniform ``u`` falls on; -1 without a positive weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(a: Column, w: Column) -> Column:
        upto = a["sum"] + w
        here = (a["at"] < 0) & (w > 0) & (u * total < upto)
        return F.struct(upto.alias("sum"), F.when(here, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

    return F.when(total > 0, F.aggregate(weights, start, step)["at"]).otherwise(-1)


def clustering_walks(g: Graph, start: DataFrame, steps: int, seed: int = 7) -> DataFrame:
    """(walk, step, id): walks drawn towards clustered vertices, those without a coefficient counting as the largest one."""
    from .overlap import clustering_coefficients

    c = clustering_coefficients(g).select("id", F.col("coefficient").alias("c"))
    top = c.agg(F.max("c").alias("top"))
    return scored_walks(g, start, c.join(F.broadcast(top)).select("id", F.when(F.col("c") > 0, F.col("c")).otherwise(F.col("top")).alias("s")), steps, seed)


def walk_ball(g: Graph, start: int, size: int, jump: float = 0.15, seed: int = 7, rounds: int = 1000) -> DataFrame:
    """(id): ``size`` vertices gathered by walkers that move towards clustered vertices and jump back to the first one.

    A walker a vertex found so far; each round they all step, and what is new is kept in
    the order of a hash until the size is reached, or nothing is left to reach.
    """
    folder = work_dir(g.edges.sparkSession, "ball")
    ball = saved(g.edges.sparkSession.createDataFrame([(start, 0)], "id long, round int"), f"{folder}/0")
    still = 0
    for k in range(1, rounds + 1):
        n = ball.count()
        if n >= size or still > 20:
            return ball.select("id")
        at = ball.withColumn("walk", F.when(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + k)), 11) / float(1 << 53) < jump, F.lit(start)).otherwise(F.col("id")))
        race = at.join(g.edges, F.col("walk") == F.col("src")).select("id", "dst").withColumn("h", F.xxhash64("id", "dst", F.lit(seed * 31 + k)))
        to = race.groupBy("id").agg(F.min_by("dst", "h").alias("to")).select(F.col("to").alias("id")).distinct().join(ball, "id", "left_anti")
        new = to.orderBy(F.xxhash64("id", F.lit(seed + k)), "id").limit(size - n).withColumn("round", F.lit(k))
        before, ball = ball, saved(ball.unionByName(new), f"{folder}/{k}")
        still = still + 1 if ball.count() == n else 0
    raise RuntimeError(f"the ball did not grow to {size} vertices in {rounds} rounds")


def uniform_sample(g: Graph, n: int, seed: int = 7) -> DataFrame:
    """n vertices drawn uniformly with replacement (ids are numbered first)."""
    from ..graph import numbered

    ids = numbered(g.vertices, [F.col("id")], "k")
    total = g.vertices.count()
    draws = g.edges.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), (F.floor(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53) * total) + 1).cast("long").alias("k"))
    return draws.join(ids, "k").select("draw", "id")


def approximate_diameter(g: Graph) -> int:
    """Longest of three breadth-first sweeps of the undirected projection, each from the last one's farthest vertex."""
    u = g.undirected().kept("diameter")
    at = u.out_degrees().orderBy(F.desc("out_degree"), "id").select("id").first()
    if at is None:
        return 0
    longest, v = 0, at.id
    for _ in range(3):
        far = bfs_levels(u, g.edges.sparkSession.createDataFrame([(v,)], "id long")).orderBy(F.desc("level"), "id").first()
        longest, v = max(longest, far.level), far.id
    return longest
