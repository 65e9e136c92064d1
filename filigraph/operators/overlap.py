"""Neighbour-overlap queries, colinks, triangles and the coefficients built on them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import map_file, put_file, saved, ship, work_dir

#: (id, item) pairs in a block of rows, and in a block of targets.
ROW_BLOCK, TARGET_BLOCK = 1 << 21, 1 << 19


def _whole(df: DataFrame, *columns: str) -> bool:
    return all(dict(df.dtypes)[c] in ("bigint", "int", "smallint", "tinyint") for c in columns)


def _blocks(df: DataFrame, id_: str, item: str, size: int, least: int, by_item: bool) -> list[str]:
    """The (id, item) pairs in files, by ranges of ids that hold about ``size`` pairs each, at least ``least`` ranges where they are large enough.

    The files are in the order of ids.  Each has its ids, how many pairs each has, and the pairs in the order of items (``by_item``) or of ids.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.select(F.col(id_).cast("long").alias("id"), F.col(item).cast("long").alias("item")).filter("id is not null and item is not null")
    n = df.count()
    count = max(-(-n // size), min(least, n >> 13), 1)
    bounds = sorted({int(x) for x in df.approxQuantile("id", [k / count for k in range(1, count)], min(1e-3, 0.2 / count))}) if count > 1 else []
    folder = work_dir(spark, "blocks")

    def numbered(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch({"id": b["id"], "item": b["item"], "block": pa.array(np.searchsorted(bounds, b["id"].to_numpy(), "left").astype(np.int32))})

    def write(table):
        import pyarrow as pa

        ids, items = table["id"].to_numpy(), table["item"].to_numpy()
        own, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, items)) if by_item else np.lexsort((items, place))
        name = f"{folder}/{uuid.uuid4().hex}"
        parts = (np.array([len(own), len(ids)], np.int64), own.astype(np.int64), np.bincount(place, minlength=len(own)).astype(np.int64), items[order].astype(np.int64), place[order].astype(np.int32))
        put_file(name, b"".join(x.tobytes() for x in parts))
        return pa.table({"name": [name], "first": [int(own[0])]})

    files = df.mapInArrow(numbered, "id long, item long, block int").groupBy("block").applyInArrow(write, "name string, first long").collect()  # a row a block
    return [r.name for r in sorted(files, key=lambda r: r.first)]


def _block(name: str) -> tuple[np.ndarray, ...]:
    """(ids, sizes, items, places) of a file."""
    raw = np.asarray(map_file(name))
    n, m = (int(x) for x in raw[:16].view(np.int64))
    ids, sizes, items = (raw[16 + 8 * a : 16 + 8 * z].view(np.int64) for a, z in ((0, n), (n, 2 * n), (2 * n, 2 * n + m)))
    return ids, sizes, items, raw[16 + 8 * (2 * n + m) :].view(np.int32)


def _shared(rows: tuple, targets: tuple, most: int = 1 << 22):
    """(target place, row place, overlap) of a block of targets and one of rows, targets in order, by so many lookups at once."""
    ids, _, items, places = rows
    at = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    names, size = items[at], np.diff(np.append(at, len(items)))
    k = np.minimum(np.searchsorted(names, targets[2]), len(names) - 1)
    ok = np.flatnonzero(names[k] == targets[2])
    owner, begin, size = targets[3][ok].astype(np.int64), at[k[ok]], size[k[ok]]
    ends, a, n = np.cumsum(size), 0, len(ids)
    while a < len(ok):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        if z < len(ok):  # whole targets only; one alone has at most the block's pairs
            first = int(np.searchsorted(owner, owner[z]))
            z = first if first > a else int(np.searchsorted(owner, owner[a], "right"))
        m = size[a:z]
        to = np.arange(int(m.sum())) + np.repeat(begin[a:z] - (np.cumsum(m) - m), m)
        low = int(owner[a])
        key = np.repeat(owner[a:z] - low, m) * n + places[to]
        cells = (int(owner[z - 1]) - low + 1) * n
        if cells <= 8 * len(key):
            c = np.bincount(key, minlength=cells)
            key = np.flatnonzero(c)
            c = c[key]
        else:
            key.sort()
            s = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, c = key[s], np.diff(np.append(s, len(key)))
        yield key // n + low, key % n, c
        a = z


def _pairs(rows: DataFrame, targets: DataFrame, row: str, target: str, item: str, keep, schema: str) -> DataFrame:
    """``keep(target ids, row ids, overlaps, target sizes, row sizes)`` of each block of pairs, whose columns it returns.

    Every block of targets meets every block of rows in one task, which holds two blocks: no pair is shuffled.
    """
    spark = rows.sparkSession
    par = spark.sparkContext.defaultParallelism
    r = _blocks(rows, row, item, ROW_BLOCK, 1, True)
    t = _blocks(targets, target, item, TARGET_BLOCK, 3 * par, False)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b["id"].to_pylist():
                own, other = _block(t[k // len(r)]), _block(r[k % len(r)])
                for x, y, c in _shared(other, own):
                    out = pa.record_batch(keep(own[0][x], other[0][y], c, own[1][x], other[1][y]))
                    for at in range(0, out.num_rows, 1 << 16):
                        yield out.slice(at, 1 << 16)

    n = len(r) * len(t)
    return spark.range(0, n, 1, max(1, min(n, 2000))).mapInArrow(run, schema)


def overlaps(rows: DataFrame, targets: DataFrame, row: str = "row_id", target: str = "target_id", item: str = "item") -> DataFrame:
    """(target, row, overlap) of sets given as distinct (id, item) pairs, for pairs that share an item.

    Blocks of whole targets are counted against blocks of rows.  Ids and items that are no integers are joined; items
    held by many rows are then split by a hash of the row, and their targets copied to
    each part, so that no task takes all of a popular item's pairs.
    """
    if _whole(rows, row, item) and _whole(targets, target, item):
        out = _pairs(rows, targets, row, target, item, lambda t, r, c, *_: {target: t, row: r, "overlap": c}, f"`{target}` long, `{row}` long, overlap long")
        return out.select(F.col(target).cast(dict(targets.dtypes)[target]).alias(target), F.col(row).cast(dict(rows.dtypes)[row]).alias(row), "overlap")
    a, b = targets.select(target, item), rows.select(row, item)
    parts = b.groupBy(item).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 10_000)).cast("int").alias("_n"))
    many = F.broadcast(parts.filter("_n > 1").orderBy(F.desc("_n")).limit(10_000))  # of the rest none has over 10,000 rows, or all are alike
    n = F.coalesce("_n", F.lit(1))
    a = a.join(many, item, "left").withColumn("_p", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    b = b.join(many, item, "left").withColumn("_p", F.pmod(F.xxhash64(row), n).cast("int")).drop("_n")
    return a.join(b, [item, "_p"]).groupBy(target, row).agg(F.count(F.lit(1)).alias("overlap"))


def topk_overlaps(rows: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k rows of largest overlap with each target; ties go to the smaller row.  Of each block of rows only k are passed on."""
    if _whole(rows, "row_id", "item") and _whole(targets, "target_id", "item"):

        def best(t, r, c, *_):
            order = np.lexsort((r, -c, t))
            t, r, c = t[order], r[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            ok = np.arange(len(t)) - np.repeat(at, np.diff(np.append(at, len(t)))) < k
            return {"target_id": t[ok], "row_id": r[ok], "overlap": c[ok]}

        x = _pairs(rows, targets, "row_id", "target_id", "item", best, "target_id long, row_id long, overlap long")
    else:
        x = overlaps(rows, targets)
    w = Window.partitionBy("target_id").orderBy(F.desc("overlap"), "row_id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_overlap(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The row of largest overlap with each target; (0, 0) for targets that share nothing."""
    best = topk_overlaps(rows, targets, 1).select("target_id", "row_id", "overlap")
    out = targets.select("target_id").distinct().join(best, "target_id", "left")
    return out.select("target_id", F.coalesce("row_id", F.lit(0)).alias("row_id"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def jaccards(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, row, overlap, jaccard)."""
    if _whole(rows, "row_id", "item") and _whole(targets, "target_id", "item"):
        share = lambda t, r, c, dt, dr: {"target_id": t, "row_id": r, "overlap": c, "jaccard": c / (dt + dr - c)}
        return _pairs(rows, targets, "row_id", "target_id", "item", share, "target_id long, row_id long, overlap long, jaccard double")
    dr = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("dr"))
    dt = targets.groupBy("target_id").agg(F.count(F.lit(1)).alias("dt"))
    x = overlaps(rows, targets).join(dr, "row_id").join(dt, "target_id")
    return x.select("target_id", "row_id", "overlap", (F.col("overlap") / (F.col("dr") + F.col("dt") - F.col("overlap"))).alias("jaccard"))


def colinks(g: Graph) -> DataFrame:
    """(a, b), a < b, linked both ways."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.edges.filter("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def participation(g: Graph, members: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(id, name): in how many of the tuples a vertex is, zeros included."""
    n = members.select(F.explode(F.array(*columns)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias(name))
    return g.vertices.join(n, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def max_motifs(g: Graph) -> DataFrame:
    """(id, parents, children, mutual, mn2, mn3): most colinks p+c-i and triangles p*c-i a vertex could be in."""
    d = g.in_degrees().withColumnRenamed("in_degree", "parents").join(g.out_degrees().withColumnRenamed("out_degree", "children"), "id")
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = g.edges.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("mutual"))
    d = d.join(both, "id", "left").withColumn("mutual", F.coalesce("mutual", F.lit(0)).cast("long"))
    return d.select("id", "parents", "children", "mutual", (F.col("parents") + F.col("children") - F.col("mutual")).alias("mn2"), (F.col("parents") * F.col("children") - F.col("mutual")).alias("mn3"))


def triangles(g: Graph) -> DataFrame:
    """(a, b, c): directed 3-cycles a->b->c->a, each once, led by the vertex of lowest (mn3, id).

    Wedges are built at the vertex that could be in fewest triangles, which keeps hubs
    from fanning out: their number is at most the sum of in times out over those.
    """
    rank = max_motifs(g).select("id", F.struct("mn3", "id").alias("r"))
    r = lambda c: rank.select(F.col("id").alias(c), F.col("r").alias(f"r_{c}"))
    e = g.edges.filter("src <> dst")
    ranked = e.join(r("src"), "src").join(r("dst"), "dst")
    ab = ranked.filter("r_src < r_dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ca = ranked.filter("r_dst < r_src").select(F.col("dst").alias("a"), F.col("src").alias("c"))
    bc = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return ab.join(ca, "a").filter("b <> c").join(bc, ["b", "c"], "left_semi").select("a", "b", "c")


def clustering_coefficients(g: Graph, density: float | None = None) -> DataFrame:
    """(id, n_triangles, coefficient): triangles over p*c-i, 0 without any possible; optionally density-corrected."""
    t = participation(g, triangles(g), ["a", "b", "c"], "n_triangles")
    x = t.join(max_motifs(g).select("id", "mn3"), "id")
    if density is None:
        c = F.when(F.col("mn3") > 0, F.col("n_triangles") / F.col("mn3")).otherwise(0.0)
    else:
        c = F.when(F.col("mn3") > 0, (F.col("n_triangles") - density * F.col("mn3")) / (F.col("mn3") * (1 - density))).otherwise(0.0)
    return x.select("id", "n_triangles", c.alias("coefficient"))


def colink_coefficients(g: Graph) -> DataFrame:
    """(id, n_colinks, coefficient): colinks over p+c-i; 0 on isolated vertices."""
    c = participation(g, colinks(g), ["a", "b"], "n_colinks").join(max_motifs(g).select("id", "mn2"), "id")
    return c.select("id", "n_colinks", F.when(F.col("mn2") > 0, F.col("n_colinks") / F.col("mn2")).otherwise(0.0).alias("coefficient"))


def average_clustering(g: Graph) -> DataFrame:
    """Mean over vertices of undirected degree >= 2 of directed links among neighbours over d(d-1).

    Ties point from the vertex of fewer ties to that of more, which bounds the wedges at hubs.  Blocks of
    vertices are held against blocks of ties, two in a task; what they count is summed by vertex.
    """
    spark = g.edges.sparkSession
    e = g.edges.filter("src <> dst")
    u = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    d = u.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    d = saved(d, work_dir(spark, "ties"))
    deg = lambda c: d.select(F.col("v").alias(c), F.col("d").alias(f"d_{c}"))
    out = u.join(deg("src"), "src").join(deg("dst"), "dst").filter("struct(d_src, src) < struct(d_dst, dst)")
    files = _blocks(out.select(F.col("src").alias("id"), (F.col("dst") * 2 + F.col("m") - 1).alias("item")), "id", "item", ROW_BLOCK, spark.sparkContext.defaultParallelism, False)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b["id"].to_pylist():
                v, n = _linked(_block(files[k // len(files)]), _block(files[k % len(files)]))
                for at in range(0, len(v), 1 << 16):
                    yield pa.record_batch({"v": v[at : at + (1 << 16)], "k": n[at : at + (1 << 16)]})

    n = len(files) ** 2
    k = spark.range(0, n, 1, max(1, min(n, 2000))).mapInArrow(run, "v long, k long").groupBy("v").agg(F.sum("k").alias("k"))
    x = d.filter("d >= 2").join(k, "v", "left").agg(F.avg(F.coalesce("k", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("c"))
    return x.select(F.coalesce("c", F.lit(0.0)).alias("avg_clustering"))


def _linked(lists: tuple, ties: tuple, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, links) of the triangles a -> b, a -> c, b -> c with a in the one block and b in the other: links opposite to each."""
    tails, sizes, items, _ = ties
    ends = np.cumsum(lists[1])
    heads = items >> 1
    names = np.unique(heads)
    key = np.repeat(np.arange(len(tails)), sizes) * len(names) + np.searchsorted(names, heads)
    order = np.argsort(key)
    key, double = key[order], items[order] & 1
    starts = ends - lists[1]
    b_all, b_double = lists[2] >> 1, lists[2] & 1
    at = np.minimum(np.searchsorted(tails, b_all), len(tails) - 1)
    own = np.flatnonzero(tails[at] == b_all)  # the pairs (a, b) whose b has its ties in the block
    a_of = lists[3][own].astype(np.int64)
    total, found, counts, x = np.cumsum(lists[1][a_of]), [], [], 0
    while x < len(own):
        z = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + most, "right")))
        m = lists[1][a_of[x:z]]
        ab = np.repeat(own[x:z], m)
        ac = np.arange(int(m.sum())) + np.repeat(starts[a_of[x:z]] - (np.cumsum(m) - m), m)
        c = np.minimum(np.searchsorted(names, b_all[ac]), len(names) - 1)
        want = at[ab] * len(names) + c
        to = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = np.flatnonzero((key[to] == want) & (names[c] == b_all[ac]))
        ab, ac, to = ab[ok], ac[ok], to[ok]
        v = np.concatenate([lists[0][lists[3][ab]], b_all[ab], b_all[ac]])
        n = np.concatenate([double[to], b_double[ac], b_double[ab]]) + 1
        found.append(v)
        counts.append(n)
        if sum(map(len, found)) > most or z == len(own):
            v, place = np.unique(np.concatenate(found), return_inverse=True)
            found, counts = [v], [np.bincount(place, np.concatenate(counts), len(v)).astype(np.int64)]
        x = z
    return (found[0], counts[0]) if found else (np.zeros(0, np.int64),) * 2


def set_operation(a: DataFrame, b: DataFrame, kind: str, one: str, two: str) -> DataFrame:
    """(id, size) of a set operation on the neighbour lists of paired ids: kind is union, intersect or except."""
    op = {"union": F.array_union, "intersect": F.array_intersect, "except": F.array_except}[kind]
    return a.select("id", F.size(op(F.col(one), F.col(two))).cast("long").alias("size")) if b is None else a.join(b, "id").select("id", F.size(op(F.col(one), F.col(two))).cast("long").alias("size"))


def as_reference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, positions, additions) of lists ``a(id, nbrs)`` given reference lists ``b(id, nbrs)``.

    Positions (from 0) of the reference's members that are copied, and what the list holds besides.
    """
    x = a.join(b.select("id", F.col("nbrs").alias("ref")), "id")
    at = F.filter(F.transform("ref", lambda v, i: F.when(F.array_contains("nbrs", v), i)), lambda i: i.isNotNull())
    return x.select("id", at.alias("positions"), F.array_except("nbrs", "ref").alias("additions"))


def with_candidate(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The (row_id, item) index with one more row of the distinct ``items(item)``, numbered after the last."""
    last = rows.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("last"))
    return rows.select("row_id", "item").unionByName(items.select("item").distinct().join(F.broadcast(last)).select((F.col("last") + 1).alias("row_id"), "item"))
