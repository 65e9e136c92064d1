"""Communities, partitions and coarsening.

Label updates are synchronous; a hash colouring lets half of the vertices move in
each pass, which stops neighbours from swapping for ever.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cooccur import hashed, run_starts
from ..graph import Graph, numbered
from ..runtime import saved, work_dir
from . import traversal
from .rounds import Rounds


def label_propagation(g: Graph, passes: int = 10) -> DataFrame:
    """(id, label): the label most frequent among undirected neighbours, the smaller at ties."""
    return absolute_potts(g, 0.0, passes)


def absolute_potts(g: Graph, gamma: float, passes: int = 5, ties: Rounds | None = None) -> DataFrame:
    """(id, label) maximising k_l - gamma (size_l - k_l), the smaller label at ties.

    ``ties``: the blocks of the graph's ``undirected_ties``, where several runs share them.
    """

    def step(ids, sizes, ties, values, own, k):
        owner = np.repeat(np.arange(len(ids)), sizes)
        key = (owner << 32) | values[ties]
        key.sort()
        at = run_starts(key)
        owner, label, n = key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(np.append(at, len(key)))
        score = n - gamma * (np.bincount(values, minlength=len(values))[label] - n)
        first = run_starts(owner)
        best = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(owner)))))
        best = best[run_starts(owner[best])]  # labels ascend
        turn = (hashed(ids, np.full(len(ids), 42), 64) & 1) == k % 2
        return np.where(turn, label[best], values[own])

    x = (ties or undirected_ties(g)).run(lambda ids, sizes, at: at + np.arange(len(ids)), step, 2 * passes, lambda k, changed: k % 2 == 1 and not changed, False, True)
    return g.vertices.join(x, "id", "left").select("id", F.coalesce("value", "id").alias("label"))


def undirected_ties(g: Graph) -> Rounds:
    return Rounds(g.undirected().edges.filter("src <> dst"), "labels")


def coarse(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w): weights summed between labels, loops kept. ``edges(src, dst, w)``."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("ls").alias("src"), F.col("ld").alias("dst")).agg(F.sum("w").alias("w"))


def _moved(e: DataFrame, k: DataFrame, x: DataFrame, total: float, passes: int, folder: str, within: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Modularity moves of vertices by turns until nothing gains, and whether any moved.

    ``e(src, dst, w)``: both directions of each tie; ``k(id, out, in)``; ``x(id, label)``.
    The gain of a label is the ties to it less out * in' / total and in * out' / total, over the
    label's other members.  With ``within(id, area)`` only vertices that are alone move, and
    only inside their area (the refinement of a partition).
    """
    moved_any = False
    near_edges = e.filter("src <> dst")
    if within is not None:
        a, b = within.select(F.col("id").alias("src"), F.col("area").alias("sa")), within.select(F.col("id").alias("dst"), F.col("area").alias("da"))
        near_edges = saved(near_edges.join(a, "src").join(b, "dst").filter("sa = da").select("src", "dst", "w"), f"{folder}/within")
    for p in range(2 * passes):
        strength = x.join(k, "id").groupBy("label").agg(F.sum("out").alias("lo"), F.sum("in").alias("li"), F.count(F.lit(1)).alias("size"))
        near = near_edges.join(x, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.sum("w").alias("ties"))
        own = x.select(F.col("id").alias("src"), "label").join(near, ["src", "label"], "left").select("src", "label", F.coalesce("ties", F.lit(0.0)).alias("ties"))
        rest = near.join(x.select(F.col("id").alias("src"), "label"), ["src", "label"], "left_anti")
        cand = rest.unionByName(own).join(strength, "label").join(k.withColumnRenamed("id", "src"), "src").join(x.select(F.col("id").alias("src"), F.col("label").alias("now")), "src")
        stay = F.col("label") == F.col("now")
        lo, li = F.col("lo") - F.when(stay, F.col("out")).otherwise(0.0), F.col("li") - F.when(stay, F.col("in")).otherwise(0.0)
        cand = cand.withColumn("gain", F.round(F.col("ties") - (F.col("out") * li + F.col("in") * lo) / total, 9)).withColumn("stay", stay)
        free = F.lit(True) if within is None else F.max(F.when(F.col("stay"), F.col("size"))) == 1
        best = cand.groupBy("src", "now").agg(F.max_by("label", F.struct("gain", "stay", (-F.col("label")).alias("l"))).alias("to"), free.alias("free"))
        turn = (F.pmod(F.xxhash64("src", F.lit(p // 2)), F.lit(2)) == p % 2) & F.col("free")
        y = saved(best.select(F.col("src").alias("id"), F.when(turn, F.col("to")).otherwise(F.col("now")).alias("label"), (turn & (F.col("to") != F.col("now"))).alias("moved")), f"{folder}/y{p}")
        moved = bool(y.filter("moved").limit(1).count())
        moved_any |= moved
        x = y.select("id", "label")
        if p % 2 and not moved:
            break
    return x, moved_any


def louvain(g: Graph, levels: int = 10, passes: int = 10, refine: bool = False, directed: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """(id, label): synchronous modularity moves, then coarsening, level by level.

    A move needs a strict gain; vertices move by turns of a hash colouring.  Without
    ``directed`` the ties of both directions count alike; with it the modularity is
    Leicht and Newman's, whose null model keeps in- and out-strengths apart.  ``refine``
    (Leiden): before coarsening each community is taken apart and merged anew from
    single vertices inside it; the parts become the next level's vertices, which start
    in their community.  Labels are the communities' smallest members.
    ``weights(src, dst, w)``: weighted edges instead of the graph's.
    """
    spark = g.edges.sparkSession
    folder = work_dir(spark, "louvain")
    one = (weights if weights is not None else g.edges.withColumn("w", F.lit(1.0))).filter("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w"))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    arcs = saved((one if directed else one.unionByName(back)).groupBy("src", "dst").agg(F.sum("w").alias("w")), f"{folder}/a")
    member = saved(g.vertices.select("id", F.col("id").alias("label")), f"{folder}/m")
    community = None  # of the present level's vertices, where they are parts of communities
    for level in range(levels):
        total = arcs.agg(F.sum("w")).first()[0]
        if not total:
            break
        at = f"{folder}/l{level}"
        flip = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        ties = saved(arcs.unionByName(flip).groupBy("src", "dst").agg((F.sum("w") / (1.0 if directed else 2.0)).alias("w")), f"{at}/ties")
        out, into = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out")), arcs.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in"))
        k = out.join(into, "id", "full").select("id", F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("in", F.lit(0.0)).alias("in"))
        if not directed:  # each tie is there twice: half of the null model's two terms
            k = k.select("id", (F.col("out") / F.sqrt(F.lit(2.0))).alias("out"), (F.col("in") / F.sqrt(F.lit(2.0))).alias("in"))
        k = saved(k, f"{at}/k")
        start = k.select("id", F.col("id").alias("label"))
        if community is not None:
            start = k.select("id").join(community, "id").select("id", "label")
        x, moved = _moved(ties, k, saved(start, f"{at}/x"), total, passes, at)
        if not moved and level:
            break
        parts = x
        if refine:
            single = saved(k.select("id", F.col("id").alias("label")), f"{at}/single")
            parts, _ = _moved(ties, k, single, total, passes, f"{at}/refine", x.select("id", F.col("label").alias("area")))
            community = saved(parts.join(x.select("id", F.col("label").alias("c")), "id").groupBy(F.col("label").alias("id")).agg(F.min("c").alias("c")), f"{at}/community")
            names = community.groupBy("c").agg(F.min("id").alias("label"))
            community = saved(community.join(names, "c").select("id", "label"), f"{at}/named")
        member = saved(member.join(parts.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"{at}/m")
        arcs = saved(coarse(arcs, parts), f"{at}/a")
        if not moved:
            break
    if community is not None:
        member = member.join(community.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    names = member.groupBy("label").agg(F.min("id").alias("name"))
    return member.join(names, "label").select("id", F.col("name").alias("label"))


def leiden(g: Graph, levels: int = 10, passes: int = 10, directed: bool = False) -> DataFrame:
    """Louvain with refined levels, whose communities are connected: parts that fall apart are split at the end."""
    member = louvain(g, levels, passes, True, directed)
    return refined(g, member)


def refined(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, label): each community split into its connected components, named by their smallest members."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    inside = g.edges.join(a, "src").join(b, "dst").filter("ls = ld").select("src", "dst")
    return traversal.weak_components(Graph(inside, g.vertices)).select("id", F.col("component").alias("label"))


def partition_count(g: Graph, most: int = 8, least_share: float = 0.005, granularity: float = 0.01, per_part: int = 100_000, labels: DataFrame | None = None) -> DataFrame:
    """(parts): how many parts suit a graph.

    1 if a quick partition (two passes of one level) has fewer communities than
    ``granularity`` of the vertices, else log2(n / ``per_part``) rounded up, between 1 and both
    ``most`` and the number of communities that hold ``least_share`` of the vertices.
    """
    labels = labels if labels is not None else louvain(g, levels=1, passes=2)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    x = sizes.agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("n"))
    big = sizes.join(F.broadcast(x.select("n"))).agg(F.count_if(F.col("k") >= least_share * F.col("n")).alias("big"))
    want = F.greatest(F.lit(1), F.least(F.ceil(F.log2(F.col("n") / per_part)), F.lit(most), F.col("big")))
    return x.select("c", "n").join(F.broadcast(big)).select(F.when(F.col("c") < granularity * F.col("n"), F.lit(1)).otherwise(want).cast("int").alias("parts"))


def matching(g: Graph, rounds: int = 1000, seed: int = 7, weights: DataFrame | None = None) -> DataFrame:
    """(id, label): a maximal heavy-edge matching by mutual best choice; the unmatched keep their own id.

    Each vertex picks its heaviest tie (``weights(src, dst, w)``, else all alike), a
    hash deciding among equals; pairs that pick each other are matched, and the rest
    goes on until no tie is left.  Raises if ``rounds`` do not suffice.
    """
    folder = work_dir(g.edges.sparkSession, "matching")
    one = (weights if weights is not None else g.edges.withColumn("w", F.lit(1.0))).filter("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w"))
    e = saved(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), f"{folder}/e")
    done = None
    for k in range(rounds):
        best = F.struct("w", F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed + k)).alias("h"))
        pick = e.groupBy("src").agg(F.max_by("dst", best).alias("to"))
        both = pick.join(pick.select(F.col("to").alias("src"), F.col("src").alias("to")), ["src", "to"], "left_semi")
        new = saved(both.select(F.col("src").alias("id"), F.least("src", "to").alias("label")), f"{folder}/n{k}")
        if not new.limit(1).count():
            break
        done = new if done is None else done.unionByName(new)
        e = saved(e.join(new.withColumnRenamed("id", "src"), "src", "left_anti").join(new.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w"), f"{folder}/e{k}")
    else:
        raise RuntimeError(f"the matching did not end in {rounds} rounds")
    if done is None:
        return g.vertices.select("id", F.col("id").alias("label"))
    return g.vertices.join(done, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def bisection_partition(g: Graph, parts: int, passes: int = 6, seed: int = 7, levels: int = 8) -> DataFrame:
    """(id, label in 1..parts): communities laid out in order are cut into equal parts, then refined by balanced label moves."""
    folder = work_dir(g.edges.sparkSession, "parts")
    u = g.undirected().kept("parts")
    cap = 1.1 * u.vertices.count() / parts
    comp = traversal.weak_components(u)
    # consecutive ids of one neighbourhood start together: the order of (component, community, id)
    comm = louvain(g, levels, passes)

    order = numbered(comp.join(comm, "id"), [F.col("component"), F.col("label"), F.col("id")], "place")
    n = max(1, u.vertices.count())
    x = saved(order.select("id", (F.floor((F.col("place") - 1) * parts / n) + 1).cast("long").alias("label")), f"{folder}/0")
    for k in range(passes):
        size = x.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        near = u.edges.join(x, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count(F.lit(1)).alias("k"))
        own = near.join(x.withColumnRenamed("id", "src"), ["src", "label"], "left_semi").select("src", F.col("k").alias("own"))
        best = near.join(size, "label").filter(F.col("size") < cap).groupBy("src").agg(F.max_by("label", F.struct("k", (-F.col("label")).alias("l"))).alias("to"), F.max("k").alias("k"))
        room = size.select(F.col("label").alias("to"), (F.lit(cap) - F.col("size")).alias("room"))
        want = best.join(own, "src", "left").filter("k > coalesce(own, 0)").join(room, "to")
        ask = want.groupBy("to").agg(F.count(F.lit(1)).alias("asked"))
        unit = F.shiftrightunsigned(F.xxhash64("src", F.lit(seed + k)), 11) / float(1 << 53)
        go = want.join(ask, "to").filter(unit < F.col("room") / F.col("asked")).select(F.col("src").alias("id"), "to")
        x = saved(x.join(go, "id", "left").select("id", F.coalesce("to", "label").alias("label")), f"{folder}/{k + 1}")
    return x


def merge_small(g: Graph, labels: DataFrame, least: int) -> DataFrame:
    """Clusters below ``least`` members join the larger cluster they share most edges with (ties: smaller label)."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    e = coarse(g.undirected().edges.withColumn("w", F.lit(1.0)), labels).filter("src <> dst")
    small = size.filter(F.col("n") < least).select(F.col("label").alias("src"))
    big = size.filter(F.col("n") >= least).select(F.col("label").alias("dst"))
    to = e.join(small, "src").join(big, "dst").groupBy("src").agg(F.max_by("dst", F.struct("w", (-F.col("dst")).alias("d"))).alias("to"))
    return labels.join(to.withColumnRenamed("src", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
