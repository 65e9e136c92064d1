"""Path discovery between two vertices from bidirectional scores.

Scores (see ``ranking.path_scores``) concentrate between source and target; the
walks themselves are sequential and touch few vertices.  A query whose scores select
at most ``top`` vertices is one task over their subgraph; such queries run in
parallel.  Those that select more walk over the tables, one lookup of a vertex's
best-scored neighbours a step, so that no vertex is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import saved, work_dir

RESULT = "query long, rank int, path array<long>, low double"


def selected(g: Graph, scores: DataFrame, s: int, t: int, threshold: float = 0.0) -> tuple[Graph, DataFrame]:
    """Vertices scored above the threshold (0: the mean of the positive scores), with s and t, renumbered; and the mapping."""
    limit = threshold or scores.filter("product > 0").agg(F.avg("product")).first()[0] or 0.0
    own = scores.filter(F.col("product") > limit).select("id")
    ends = g.edges.sparkSession.createDataFrame([(s,), (t,)], "id long")
    return g.induced_renumbered(own.unionByName(ends))


def greedy(near: dict[int, list[int]], score: dict[int, float], s: int, t: int, most: int) -> list[int]:
    """The best-scored unvisited out-neighbour at each step, the smaller id at ties; empty at a dead end."""
    path, seen = [s], {s}
    while path[-1] != t:
        if len(path) > most:
            return []
        if t in near.get(path[-1], ()):
            nxt = t
        else:
            open_ = [v for v in near.get(path[-1], ()) if v not in seen and score.get(v, 0.0) > 0]
            if not open_:
                return []
            nxt = min(open_, key=lambda v: (-score[v], v))
        path.append(nxt)
        seen.add(nxt)
    return path


def decayed(near, score, s, t, k, most, decay=0.1):
    """Repeated greedy walks; the inner vertices of each path found lose score by ``decay``. At most 3k tries."""
    score, out = dict(score), []
    for _ in range(3 * k):
        p = greedy(near, score, s, t, most)
        if not p:
            break
        if p not in out:
            out.append(p)
            if len(out) == k:
                break
        if len(p) == 2:
            break
        for v in p[1:-1]:
            score[v] *= decay
    return out


def bottlenecks(near, score, s, t, k, most):
    """Repeated greedy walks; each path's edge of smallest end score is removed. At most 5k tries."""
    near, out = {a: list(b) for a, b in near.items()}, []
    for _ in range(5 * k):
        p = greedy(near, score, s, t, most)
        if not p:
            break
        if p not in out:
            out.append(p)
            if len(out) == k:
                break
        a, b = min(zip(p, p[1:]), key=lambda e: (min(score.get(e[0], 0.0), score.get(e[1], 0.0)), e))
        near[a].remove(b)
    return out


def branching(near, score, s, t, k, most, hub=0.5):
    """From the greedy path, branch at each vertex to its other children by score over degree^hub, then on greedily; simple paths only."""
    first = greedy(near, score, s, t, most)
    if not first:
        return []
    out = [first]
    for i, v in enumerate(first[:-1]):
        used = {p[i + 1] for p in out if p[: i + 1] == first[: i + 1] and len(p) > i + 1}
        kids = sorted((x for x in near.get(v, ()) if x not in used and x not in first[: i + 1] and score.get(x, 0.0) > 0), key=lambda x: (-score[x] / max(1, len(near.get(x, ()))) ** hub, x))
        for c in kids:
            rest = greedy(near, {x: y for x, y in score.items() if x not in first[: i + 1]}, c, t, most)
            p = [*first[: i + 1], *rest]
            if rest and len(set(p)) == len(p) and p not in out:
                out.append(p)
                break
        if len(out) >= k:
            break
    return out[:k]


class _Lookup:
    """``near`` and ``score`` of a walk, from the tables: of each vertex asked for, the best-scored neighbours that a walk can need."""

    def __init__(self, g: Graph, scores: DataFrame, t: int, most: int):
        self.g, self.scores, self.t, self.most = g, scores, t, most
        self.near: dict[int, list[int]] = {}
        self.score: dict[int, float] = {}

    def get(self, v: int, default=()) -> list[int]:
        if v not in self.near:
            out = self.g.edges.filter(F.col("src") == v).join(self.scores, F.col("dst") == F.col("id"), "left").select("dst", F.coalesce("product", F.lit(0.0)).alias("product"))
            rows = out.filter((F.col("product") > 0) | (F.col("dst") == self.t)).orderBy(F.col("dst") != self.t, F.desc("product"), "dst").limit(self.most).collect()
            self.near[v] = sorted(r.dst for r in rows)
            self.score.update((r.dst, r.product) for r in rows if r.dst not in self.score)
        return self.near[v]


class _Scores:
    """The scores a ``_Lookup`` has met; copies keep their own changes."""

    def __init__(self, lookup: _Lookup, own: dict[int, float] | None = None):
        self.lookup, self.own = lookup, dict(own or {})

    def get(self, v: int, default: float = 0.0) -> float:
        return self.own.get(v, self.lookup.score.get(v, default))

    def __getitem__(self, v: int) -> float:
        return self.get(v)

    def __setitem__(self, v: int, x: float) -> None:
        self.own[v] = x


def _walked(g: Graph, scores: DataFrame, s: int, t: int, method: str, k: int, most: int) -> list[list[int]]:
    """The paths of one query over the tables: the same walks, whose steps look vertices up."""
    look = _Lookup(g, scores, t, (k + 2) * most)
    first = scores.filter(F.col("id") == s).first()
    look.score[s] = first["product"] if first else 0.0
    if method == "decayed":
        score, out = _Scores(look), []
        for _ in range(3 * k):
            p = greedy(look, score, s, t, most)
            if not p:
                break
            if p not in out:
                out.append(p)
            if len(out) == k or len(p) == 2:
                break
            for v in p[1:-1]:
                score[v] *= 0.1
        return out
    out = []
    for _ in range(5 * k):
        p = greedy(look, _Scores(look), s, t, most)
        if not p:
            break
        if p not in out:
            out.append(p)
            if len(out) == k:
                break
        score = _Scores(look)
        a, b = min(zip(p, p[1:]), key=lambda e: (min(score[e[0]], score[e[1]]), e))
        look.near[a].remove(b)
    return out


def discover(g: Graph, scores: DataFrame, pairs: list[tuple[int, int]], method: str = "decayed", k: int = 10, most: int = 1000, top: int = 50_000) -> DataFrame:
    """(query, rank, path, low): up to k paths a query; ``scores(query, id, product)``, queries numbered as in ``pairs``.

    Queries of over ``top`` positive scores walk over the tables (``branching`` ones stay one task).
    """
    import pandas as pd

    spark = g.edges.sparkSession
    good = scores.filter("product > 0").select("query", "id", "product")
    sizes = {r["query"]: r["count"] for r in good.groupBy("query").count().collect()}  # one number a query
    large = [q for q in range(len(pairs)) if sizes.get(q, 0) > top and method != "branching"]
    ends = spark.createDataFrame([(q, v) for q, pair in enumerate(pairs) for v in set(pair)], "query long, id long")
    own = good.filter(~F.col("query").isin(large)) if large else good
    own = own.join(ends.filter(~F.col("query").isin(large)) if large else ends, ["query", "id"], "full").select("query", "id", F.coalesce("product", F.lit(0.0)).alias("product"))
    e = g.edges.join(own.select("query", F.col("id").alias("src"), F.col("product").alias("ps")), "src").join(own.select("query", F.col("id").alias("dst"), F.col("product").alias("pd")), ["query", "dst"])
    walk = {"decayed": decayed, "bottlenecks": bottlenecks, "branching": branching}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = int(pdf["query"].iloc[0])
        s, t = pairs[q]
        near: dict[int, list[int]] = {}
        score: dict[int, float] = {}
        for a, b, x, y in sorted(zip(pdf.src, pdf.dst, pdf.ps, pdf.pd)):
            near.setdefault(int(a), []).append(int(b))
            score[int(a)], score[int(b)] = x, y
        rows = [(q, i, p, float(min(score.get(v, 0.0) for v in p))) for i, p in enumerate(walk(near, score, s, t, k, most), 1)] if s != t else [(q, 1, [s], score.get(s, 0.0))]
        return pd.DataFrame(rows, columns=["query", "rank", "path", "low"])

    found = e.groupBy("query").applyInPandas(run, RESULT)
    rows = []
    for q in large:
        one = saved(good.filter(F.col("query") == q).select("id", "product"), f"{work_dir(spark, 'walk')}/{q}")
        score = {r.id: r["product"] for r in one.join(ends.filter(F.col("query") == q).select("id"), "id", "left_semi").collect()}
        s, t = pairs[q]
        for i, p in enumerate(_walked(g, one, s, t, method, k, most) if s != t else [[s]], 1):
            low = one.filter(F.col("id").isin(p)).agg(F.min("product"), F.count(F.lit(1))).first()
            rows.append((q, i, p, float(low[0]) if low[1] == len(set(p)) else 0.0 if s != t else score.get(s, 0.0)))
    return found.unionByName(spark.createDataFrame(rows, RESULT)) if rows else found
