"""Cost models of adjacency codecs, and a chunked random-access container.

Costs are column expressions over gaps, intervals and references.  The container
codes chunks of ``k`` consecutive vertices on their own, so that coding and
decoding run in parallel and a lookup reads one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..graph import Graph
from . import info


def gap_values(g: Graph) -> DataFrame:
    """(src, value): first neighbour (ids from 1) and then gaps; all >= 1."""
    w = Window.partitionBy("src").orderBy("dst")
    return g.edges.select("src", F.coalesce(F.col("dst") - F.lag("dst").over(w), F.col("dst")).alias("value"))


def bits_per_edge(g: Graph, code: str, **p) -> DataFrame:
    """Bits of the gap codes of all lists and of the degrees + 1, over the edges; ids start at 1."""
    low = 0 if code in ("golomb", "rice", "fed") else 1
    v = gap_values(g).agg(F.sum(codes.length(F.col("value") - (1 - low), code, **p)).alias("gaps"), F.count(F.lit(1)).alias("m"))
    d = g.out_degrees().agg(F.sum(codes.length(F.col("out_degree") + low, code, **p)).alias("degrees"))
    return v.join(F.broadcast(d)).select(F.lit(code).alias("code"), ((F.col("gaps") + F.col("degrees")) / F.col("m")).alias("bits_per_edge"))


def interval_costs(g: Graph, least: int = 4) -> DataFrame:
    """(src, n_intervals, covered, interval_bits, residual_bits): runs coded by gamma, the rest as gaps."""
    r = info.runs(g)
    w = Window.partitionBy("src").orderBy("start")
    iv = r.filter(F.col("length") >= least).withColumn("before", F.lag(F.col("start") + F.col("length")).over(w))
    gap = F.coalesce(F.col("start") - F.col("before"), F.col("start"))
    a = iv.groupBy("src").agg(F.count(F.lit(1)).alias("n_intervals"), F.sum("length").alias("covered"), F.sum(codes.gamma(gap + 1) + codes.gamma(F.col("length") - least + 1)).alias("interval_bits"))
    single = r.filter(F.col("length") < least).select("src", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("dst"))
    b = gap_values(Graph(single, g.vertices)).groupBy("src").agg(F.sum(codes.gamma(F.col("value"))).alias("residual_bits"))
    x = g.edges.select("src").distinct().join(a, "src", "left").join(b, "src", "left")
    return x.select("src", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_intervals", "covered", "interval_bits", "residual_bits")])


def copy_costs(g: Graph, window: int = 7) -> DataFrame:
    """(src, ref, copied, blocks, copy_bits, residual_bits, plain_bits) for the nearest best reference.

    The copy list is coded as alternating block lengths over the reference's list, by
    gamma; the rest as gaps.
    """
    best = info.best_reference(g, window).select(F.col("id").alias("src"), "ref")
    refs = best.join(g.edges.select(F.col("src").alias("ref"), "dst"), "ref")
    own = g.edges.withColumn("hit", F.lit(1))
    marks = refs.join(own, ["src", "dst"], "left").select("src", "ref", "dst", F.coalesce("hit", F.lit(0)).alias("hit"))
    w = Window.partitionBy("src").orderBy("dst")
    marks = marks.withColumn("new", F.when(F.col("hit") == F.lag("hit").over(w), 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    blocks = marks.groupBy("src", "ref", "block", "hit").agg(F.count(F.lit(1)).alias("size"))
    first = (F.col("block") == 1) & (F.col("hit") == 0)
    c = blocks.groupBy("src", "ref").agg(F.sum(F.when(F.col("hit") == 1, F.col("size")).otherwise(0)).alias("copied"), F.count(F.lit(1)).alias("blocks"), (F.sum(codes.gamma(F.col("size") + 1)) + F.max(F.when(first, 1).otherwise(0))).alias("copy_bits"))
    rest = g.edges.join(marks.filter("hit = 1").select("src", "dst"), ["src", "dst"], "left_anti")
    r = gap_values(Graph(rest, g.vertices)).groupBy("src").agg(F.sum(codes.gamma(F.col("value"))).alias("residual_bits"))
    p = gap_values(g).groupBy("src").agg(F.sum(codes.gamma(F.col("value"))).alias("plain_bits"))
    x = c.join(r, "src", "left").join(p, "src")
    return x.select("src", "ref", F.col("copied").cast("long").alias("copied"), "blocks", F.col("copy_bits").cast("long").alias("copy_bits"), F.coalesce("residual_bits", F.lit(0)).cast("long").alias("residual_bits"), F.col("plain_bits").cast("long").alias("plain_bits"))


def actions(g: Graph, window: int = 7, least: int = 4) -> DataFrame:
    """(src, action, bits): the cheapest of plain gaps, intervals, and copying from a reference; plain wins ties, then intervals."""
    p = gap_values(g).groupBy("src").agg(F.sum(codes.gamma(F.col("value"))).cast("long").alias("plain"))
    i = interval_costs(g, least).select("src", (F.col("interval_bits") + F.col("residual_bits")).alias("interval"))
    c = copy_costs(g, window).select("src", (codes.gamma(F.col("src") - F.col("ref")) + F.col("copy_bits") + F.col("residual_bits")).alias("copy"))
    x = p.join(i, "src").join(c, "src", "left")
    best = F.least("plain", "interval", F.coalesce("copy", "plain"))
    return x.select("src", F.when(F.col("plain") == best, "plain").when(F.col("interval") == best, "interval").otherwise("copy").alias("action"), best.cast("long").alias("bits"))


def huffman_bits(g: Graph) -> DataFrame:
    """(total_bits): a Huffman code over destinations by in-degree; needs the degree histogram only.

    Symbols of equal weight are merged in bulk, so the driver sees as many numbers as
    there are distinct in-degrees.
    """
    import heapq

    h = [(int(r.d), int(r.c)) for r in g.in_degrees().filter("in_degree > 0").groupBy(F.col("in_degree").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()]
    heap, total = [], 0
    counts: dict[int, int] = {}
    for d, c in h:
        counts[d] = counts.get(d, 0) + c
        heap.append(d)
    heapq.heapify(heap)
    while heap:
        d = heapq.heappop(heap)
        c = counts.pop(d)
        if c > 1:
            total += 2 * d * (c // 2)
            if 2 * d not in counts:
                heapq.heappush(heap, 2 * d)
            counts[2 * d] = counts.get(2 * d, 0) + c // 2
        if c % 2:
            if not heap:
                break
            e = heap[0]
            total += d + e
            counts[e] -= 1
            if not counts[e]:
                heapq.heappop(heap)
                del counts[e]
            if d + e not in counts:
                heapq.heappush(heap, d + e)
            counts[d + e] = counts.get(d + e, 0) + 1
    return g.edges.sparkSession.createDataFrame([(total,)], "total_bits long")


def stop_costs(g: Graph, code: str = "gamma") -> DataFrame:
    """(id, bits): lists as stop-coded gaps, the first relative to the vertex; an empty list takes one bit."""
    w = Window.partitionBy("src").orderBy("dst")
    first = codes.zigzag(F.col("dst") - F.col("src")) + 1
    v = g.edges.select("src", F.coalesce(F.col("dst") - F.lag("dst").over(w), first).alias("value"))
    bits = v.groupBy(F.col("src").alias("id")).agg((F.sum(codes.length(F.col("value"), code)) + F.count(F.lit(1)) + 1).alias("bits"))
    return g.vertices.join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(1)).cast("long").alias("bits"))


def elias_fano_sizes(g: Graph) -> DataFrame:
    """(src, bits): each list as an Elias-Fano sequence."""
    x = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("top"))
    return x.select("src", codes.elias_fano(F.col("n"), F.col("top")).cast("long").alias("bits"))


def block_costs(bits: DataFrame, code: str = "gamma") -> DataFrame:
    """(id, bits): copy lists ``bits(id, pos, hit)`` as alternating block lengths, a copied one first, the last left out."""
    w = Window.partitionBy("id").orderBy("pos")
    x = bits.withColumn("new", F.when(F.col("hit") == F.lag("hit").over(w), 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    b = x.groupBy("id", "block", "hit").agg(F.count(F.lit(1)).alias("size"))
    lead = F.when((F.col("block") == 1) & ~F.col("hit"), 1).otherwise(0)
    last = F.max("block").over(Window.partitionBy("id"))
    y = b.withColumn("last", last).withColumn("lead", lead).withColumn("n", F.col("last") + F.max("lead").over(Window.partitionBy("id")))
    one = F.when(F.col("block") < F.col("last"), codes.length(F.col("size") + F.when((F.col("block") == 1) & F.col("hit"), 1).otherwise(0), code)).otherwise(0)
    return y.groupBy("id").agg((F.sum(one) + F.max("lead") + codes.length(F.max("n"), code)).alias("bits"))


# container -----------------------------------------------------------------


def encode_lists(lists: list[tuple[int, list[int]]], code: str, window: int) -> bytes:
    """Lists of ascending ids of consecutive vertices; each is plain or refers to one of ``window`` lists before it in the chunk."""
    w = codes.Bits()
    past: list[list[int]] = []
    for _, nbrs in lists:
        best: tuple[int, codes.Bits] | None = None
        for r in range(0, min(window, len(past)) + 1):
            b = codes.Bits()
            codes.write(b, r + 1, "gamma")
            rest = nbrs
            if r:
                own, ref = set(nbrs), past[-r]
                hits = [x in own for x in ref]
                sizes, now = [], True
                for h in hits:
                    if h == now and sizes:
                        sizes[-1] += 1
                    else:
                        if h != now or not sizes:
                            if not sizes and not h:
                                sizes.append(0)
                            sizes.append(1)
                            now = h
                codes.write(b, len(sizes) + 1, "gamma")
                for s in sizes:
                    codes.write(b, s + 1, "gamma")
                got = {x for x, h in zip(ref, hits) if h}
                if not got:
                    continue
                rest = [x for x in nbrs if x not in got]
            codes.write(b, len(rest) + 1, "gamma")
            last = -1
            for x in rest:
                codes.write(b, x - last, code)
                last = x
            if best is None or len(b) < best[0]:
                best = len(b), b
        w.extend(best[1])
        past.append(nbrs)
    return w.bytes()


def decode_lists(data: bytes, first: int, n: int, code: str) -> list[tuple[int, list[int]]]:
    r = codes.Bits(data)
    out: list[tuple[int, list[int]]] = []
    for i in range(n):
        ref = codes.read(r, "gamma") - 1
        copied: list[int] = []
        if ref:
            k = codes.read(r, "gamma") - 1
            at, take = 0, True
            for _ in range(k):
                s = codes.read(r, "gamma") - 1
                if take:
                    copied += out[-ref][1][at : at + s]
                at += s
                take = not take
        last, rest = -1, []
        for _ in range(codes.read(r, "gamma") - 1):
            last += codes.read(r, code)
            rest.append(last)
        out.append((first + i, sorted([*copied, *rest])))
    return out


def encoded_chunks(g: Graph, size: int = 256, code: str = "zeta", window: int = 7) -> DataFrame:
    """(chunk, first, n, m, data): chunks of consecutive dense ids from 0; ids missing in between are empty lists."""
    import pandas as pd

    lists = g.neighbour_lists().withColumn("chunk", F.floor(F.col("id") / size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf.chunk.iloc[0]) * size
        own = {int(i): sorted(map(int, n)) for i, n in zip(pdf.id, pdf.nbrs)}
        n = max(own) - first + 1
        rows = [(first + i, own.get(first + i, [])) for i in range(n)]
        return pd.DataFrame({"chunk": [int(pdf.chunk.iloc[0])], "first": [first], "n": [n], "m": [sum(len(x) for _, x in rows)], "data": [encode_lists(rows, code, window)]})

    return lists.groupBy("chunk").applyInPandas(run, "chunk long, first long, n long, m long, data binary")


def decoded_lists(chunks: DataFrame, code: str = "zeta") -> DataFrame:
    """(id, nbrs) of all chunks given; filter on ``chunk`` first to look up single vertices."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [x for f, n, d in zip(pdf["first"], pdf["n"], pdf["data"]) for x in decode_lists(d, int(f), int(n), code)]
            yield pd.DataFrame({"id": [i for i, _ in rows], "nbrs": [x for _, x in rows]})

    return chunks.select("first", "n", "data").mapInPandas(run, "id long, nbrs array<long>")


def neighbours(chunks: DataFrame, v: int, size: int = 256, code: str = "zeta") -> DataFrame:
    """Random access: only the chunk of ``v`` is read and decoded."""
    return decoded_lists(chunks.filter(F.col("chunk") == v // size), code).filter(F.col("id") == v)
