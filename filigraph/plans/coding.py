"""Registered queries of the list coder, its costs, and the text kernels; each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import generators, propagate, text
from ..functions import codes
from ..graph import Graph
from ..operators import basic, codec, coder, community, info, overlap, traversal
from .queries import _CS, _DEG, _FIBL, _TOK, _US, _VOC, _WIN, _one_based, _vocab, cs, query, r6, table, us

_US1 = _US.replace("u AS src, v AS dst", "u + 1 AS src, v + 1 AS dst")
_G = "(2 * length(bin({})) - 1)"
_PLAIN = "pl AS (SELECT src, sum(2 * length(bin(v)) - 1) AS plain_bits FROM (SELECT src, coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst) AS v FROM us) GROUP BY src)"
_IV = (
    "ru AS (SELECT src, min(dst) AS start, count(*) AS length FROM (SELECT src, dst, dst - row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM us) GROUP BY src, k), "
    "iv AS (SELECT src, length, coalesce(start - lag(start + length) OVER (PARTITION BY src ORDER BY start), start) AS gap FROM ru WHERE length >= 4), "
    f"ia AS (SELECT src, count(*) AS n_intervals, sum(length) AS covered, sum({_G.format('(gap + 1)')} + {_G.format('(length - 3)')}) AS interval_bits FROM iv GROUP BY src), "
    "si AS (SELECT src, unnest(range(start, start + length)) AS dst FROM ru WHERE length < 4), "
    "ib AS (SELECT src, sum(2 * length(bin(v)) - 1) AS residual_bits FROM (SELECT src, coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst) AS v FROM si) GROUP BY src), "
    "ic AS (SELECT src, coalesce(n_intervals, 0)::BIGINT AS n_intervals, coalesce(covered, 0)::BIGINT AS covered, coalesce(interval_bits, 0)::BIGINT AS interval_bits, coalesce(residual_bits, 0)::BIGINT AS residual_bits FROM (SELECT DISTINCT src FROM us) LEFT JOIN ia USING (src) LEFT JOIN ib USING (src))"
)
_CP = (
    "wo AS (SELECT a.src AS id, b.src AS ref, a.src - b.src AS d, count(*) AS overlap FROM us a JOIN us b ON a.dst = b.dst WHERE a.src - b.src BETWEEN 1 AND 7 GROUP BY ALL), "
    "best AS (SELECT id, ref FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, d) AS k FROM wo) WHERE k = 1), "
    "mk AS (SELECT b.id AS src, b.ref, r.dst, (o.dst IS NOT NULL)::INT AS hit FROM best b JOIN us r ON r.src = b.ref LEFT JOIN us o ON o.src = b.id AND o.dst = r.dst), "
    "mb AS (SELECT src, ref, hit, block, count(*) AS size FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - row_number() OVER (PARTITION BY src, hit ORDER BY dst) AS block FROM mk) GROUP BY ALL), "
    "mf AS (SELECT src, arg_min(hit, dst) AS h FROM mk GROUP BY src), "
    f"mc AS (SELECT src, ref, sum(CASE WHEN hit = 1 THEN size ELSE 0 END)::BIGINT AS copied, count(*) AS blocks, (sum({_G.format('(size + 1)')}) + max(1 - h))::BIGINT AS copy_bits FROM mb JOIN mf USING (src) GROUP BY src, ref), "
    "rs AS (SELECT src, dst FROM us EXCEPT SELECT src, dst FROM mk WHERE hit = 1), "
    "rb AS (SELECT src, sum(2 * length(bin(v)) - 1) AS residual_bits FROM (SELECT src, coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst) AS v FROM rs) GROUP BY src), "
    "cc AS (SELECT src, ref, copied, blocks, copy_bits, coalesce(residual_bits, 0)::BIGINT AS residual_bits, plain_bits::BIGINT AS plain_bits FROM mc LEFT JOIN rb USING (src) JOIN pl USING (src))"
)


@query("interval_costs", f"WITH {_US1}, {_IV} SELECT * FROM ic")
def interval_costs(spark, d):
    return codec.interval_costs(_one_based(us(spark, d)).kept())


@query("copy_costs", f"WITH {_US1}, {_PLAIN}, {_CP} SELECT * FROM cc")
def copy_costs(spark, d):
    return codec.copy_costs(_one_based(us(spark, d)).kept())


@query("action_choice", f"""WITH {_US1}, {_PLAIN}, {_IV}, {_CP}, x AS (SELECT pl.src, pl.plain_bits::BIGINT AS plain, ic.interval_bits + ic.residual_bits AS interval_, {_G.format('(cc.src - cc.ref)')} + cc.copy_bits + cc.residual_bits AS copy_
 FROM pl JOIN ic USING (src) LEFT JOIN cc ON cc.src = pl.src), y AS (SELECT *, least(plain, interval_, coalesce(copy_, plain)) AS b FROM x)
 SELECT src, CASE WHEN plain = b THEN 'plain' WHEN interval_ = b THEN 'interval' ELSE 'copy' END AS action, b::BIGINT AS bits FROM y""")
def action_choice(spark, d):
    return codec.actions(_one_based(us(spark, d)).kept())


@query("stop_costs", f"WITH {_US}, v AS (SELECT src, coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), CASE WHEN dst >= src THEN 2 * (dst - src) ELSE 2 * (src - dst) - 1 END + 1) AS v FROM us), "
                     "b AS (SELECT src AS id, sum(2 * length(bin(v)) - 1) + count(*) + 1 AS bits FROM v GROUP BY src) SELECT id, coalesce(bits, 1)::BIGINT AS bits FROM vs LEFT JOIN b USING (id)")
def stop_costs(spark, d):
    return codec.stop_costs(us(spark, d))


@query("elias_fano_sizes", f"WITH {_US}, x AS (SELECT src, count(*) AS n, max(dst) AS top FROM us GROUP BY src), y AS (SELECT *, CASE WHEN n > 1 THEN greatest(length(bin(greatest((top + 1) // n, 1))) - 1, 0) ELSE 0 END AS low FROM x) "
                           f"SELECT src, ({_G.format('(n + 1)')} + {_G.format('(low + 1)')} + n * low + n + (top >> low::INT))::BIGINT AS bits FROM y")
def elias_fano_sizes(spark, d):
    return codec.elias_fano_sizes(us(spark, d))


@query("small_count_lengths", f"WITH {_US}, {_DEG} SELECT od AS v, (CASE WHEN od < 3 THEN 2 ELSE 2 + {_FIBL.format('od')} END)::BIGINT AS bits FROM (SELECT DISTINCT od FROM od)")
def small_count_lengths(spark, d):
    return us(spark, d).out_degrees().select(F.col("out_degree").alias("v")).distinct().select("v", codes.small_count(F.col("v")).cast("long").alias("bits"))


@query("list_coder_round_trip", f"WITH {_US} SELECT src, dst FROM us")
def list_coder_round_trip(spark, d):
    """All links, coded with every mode and encoding of the list coder and decoded."""
    return coder.decoded(coder.encoded(us(spark, d)))


@query("list_coder_lookup", f"WITH {_US} SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS nbrs FROM vs LEFT JOIN us ON src = id WHERE id % 20 = 0 GROUP BY id")
def list_coder_lookup(spark, d):
    """Random access: the query set is every vertex divisible by 20; its chunks are read, and of those the records needed."""
    g = us(spark, d).kept()
    got = coder.neighbours(coder.encoded(g), g.vertices.filter("id % 20 = 0"))
    return got.select("id", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))


@query("list_coder_budget")
def list_coder_budget(spark, d):
    return coder.budget(us(spark, d))


@query("web_graph_bits")
def web_graph_bits(spark, d):
    """(m, bits_per_edge): a seeded web graph of 10,000 vertices and 12 links each, by the list coder; smaller is better."""
    g = generators.web_graph(spark, 10_000, 12).kept()
    g = Graph(g.edges.select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst")), g.vertices.select((F.col("id") - 1).alias("id")))
    x = coder.encoded(g, coder.Options(window=64, chunk=512)).agg(F.sum("m").alias("m"), F.sum(F.length("data")).alias("b"))
    return x.select("m", F.round(8 * F.col("b") / F.col("m"), 3).alias("bits_per_edge"))


@query("entropy_coder_round_trip", f"WITH {_US} SELECT src, dst FROM us")
def entropy_coder_round_trip(spark, d):
    return coder.entropy_decoded(coder.entropy_coded(us(spark, d)))


@query("huffman_words", f"WITH {_US}, {_DEG} SELECT src, count(*) AS n FROM us GROUP BY src")
def huffman_words(spark, d):
    """Lists as Huffman code words, read back: how many targets each vertex's bits hold."""
    from ..functions import entropy

    g = us(spark, d).kept()
    weights = {int(r.id): int(r.in_degree) for r in g.in_degrees().filter("in_degree > 0").collect()}
    tree = entropy.huffman_tree(weights)

    def back(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for bits in pdf["bits"]:
                t, n = tree, 0
                for b in bits:
                    t = t[int(b)]
                    if not isinstance(t, tuple):
                        t, n = tree, n + 1
                out.append(n)
            yield pd.DataFrame({"src": pdf["src"], "n": out})

    return coder.huffman_coded(g).mapInPandas(back, "src long, n long")


@query("degree_autocorrelation", f"WITH {_US}, {_DEG}, m AS (SELECT avg(od) AS mean, var_pop(od) AS v, count(*) AS n FROM od), c AS (SELECT sum((a.od - mean) * (b.od - mean)) AS c FROM od a JOIN od b ON b.id = a.id - 1, m) SELECT round(CASE WHEN v > 0 AND n > 1 THEN coalesce(c, 0) / ((n - 1) * v) ELSE 0 END, 6) AS autocorrelation FROM c, m")
def degree_autocorrelation(spark, d):
    return info.degree_autocorrelation(us(spark, d).kept()).select(r6("autocorrelation"))


@query("compressibility", f"""WITH {_US}, {_DEG}, g AS (SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM us), x AS (SELECT gap FROM g WHERE gap IS NOT NULL),
 c AS (SELECT count(*) AS c FROM x GROUP BY least(gap, 10000)), h AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c), lg AS (SELECT avg(log2(gap)) AS lg FROM x),
 wo AS (SELECT a.src AS id, b.src AS ref, a.src - b.src AS d, count(*) AS overlap FROM us a JOIN us b ON a.dst = b.dst WHERE a.src - b.src BETWEEN 1 AND 16 GROUP BY ALL),
 best AS (SELECT id, ref, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, d) AS k FROM wo) WHERE k = 1), cp AS (SELECT coalesce(sum(overlap), 0) AS copied FROM best),
 res AS (SELECT e.src, e.dst FROM us e LEFT JOIN best ON best.id = e.src LEFT JOIN us r ON r.src = best.ref AND r.dst = e.dst WHERE r.src IS NULL),
 rg AS (SELECT dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM res), rr AS (SELECT count(*) AS residuals, avg((gap = 1)::INT) AS r1 FROM rg), nm AS (SELECT (SELECT count(*) FROM vs) AS n, (SELECT count(*) FROM us) AS m),
 f AS (SELECT 0.30e0 / (1 + exp(0.6 * (h - 6))) + 0.20e0 * copied / m + 0.15e0 / (1 + exp(0.7 * (lg - 5))) + 0.20e0 * coalesce(r1, 0) + 0.15e0 * greatest(0, least(1, 1 - (residuals / n) / (m / n))) AS raw FROM h, lg, cp, rr, nm)
 SELECT round(greatest(0, least(1, (raw - 0.03e0) / 0.79e0 * 0.93e0 + 0.02e0)), 6) AS compressibility FROM f""")
def compressibility(spark, d):
    return info.compressibility(us(spark, d).kept(), 16).select(r6("compressibility"))


# ranking, components, paths -----------------------------------------------------


def _push(rounds: int) -> str:
    steps = ["x0 AS MATERIALIZED (SELECT min(id) AS id, 0.0e0 AS p, 1.0e0 AS r FROM vs)"]
    for k in range(1, rounds + 1):
        go = f"g{k} AS MATERIALIZED (SELECT x.*, od.od AS d, od.od > 0 AND r / od.od >= 1e-5 AS go FROM x{k - 1} x JOIN od USING (id))"
        new = f"x{k} AS MATERIALIZED (SELECT id, sum(p) AS p, sum(r) AS r FROM (SELECT id, CASE WHEN go THEN p + 0.15e0 * r ELSE p END AS p, CASE WHEN go THEN 0.0e0 ELSE r END AS r FROM g{k} UNION ALL SELECT dst, 0.0e0, 0.85e0 * r / d FROM g{k} JOIN us ON src = id WHERE go) GROUP BY id)"
        steps += [go, new]
    return f"WITH {_US}, {_DEG}, {', '.join(steps)} SELECT id, round(p, 6) AS p FROM x{rounds}"


@query("push_ppr", _push(45))
def push_ppr(spark, d):
    from ..operators import ranking

    g = us(spark, d).kept()
    return ranking.push(g, g.vertices.agg(F.min("id").alias("id")), epsilon=1e-5).select("id", r6("p"))


def _eigen(rounds: int) -> str:
    steps = ["un AS (SELECT src, dst FROM us UNION SELECT dst, src FROM us), x0 AS (SELECT id, 1.0e0 AS score FROM vs)"]
    for k in range(1, rounds + 1):
        steps.append(f"y{k} AS MATERIALIZED (SELECT id, score + coalesce(s, 0) AS y FROM x{k - 1} LEFT JOIN (SELECT dst AS id, sum(score) AS s FROM un JOIN x{k - 1} x ON un.src = x.id GROUP BY dst) USING (id)), x{k} AS MATERIALIZED (SELECT id, y / (SELECT max(y) FROM y{k}) AS score FROM y{k})")
    return f"WITH {_US}, {', '.join(steps)} SELECT id, round(score, 6) AS score FROM x{rounds}"


@query("eigenvector_centrality", _eigen(12))
def eigenvector_centrality(spark, d):
    from ..operators import ranking

    return ranking.eigenvector(us(spark, d), 12).select("id", r6("score"))


_AN = "a AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0e0 AS w FROM us UNION ALL SELECT id, id, 1.0e0 FROM vs) GROUP BY ALL), rs AS (SELECT src AS id, sum(w) AS d FROM a GROUP BY src), an AS (SELECT src AS i, dst AS j, w / sqrt(x.d * y.d) AS w FROM a JOIN rs x ON src = x.id JOIN rs y ON dst = y.id), x0 AS (SELECT id, (id % 3)::DOUBLE AS x FROM vs)"
_HOP = "x{k} AS (SELECT vs.id, coalesce(s, 0) AS x FROM vs LEFT JOIN (SELECT i AS id, sum(w * x) AS s FROM an JOIN x{b} ON j = id GROUP BY i) USING (id))"


@query("generalised_pagerank", f"WITH {_US}, {_AN}, {_HOP.format(k=1, b=0)}, {_HOP.format(k=2, b=1)} SELECT id, round(0.5e0 * x0.x + 0.3e0 * x1.x + 0.2e0 * x2.x, 6) AS x FROM x0 JOIN x1 USING (id) JOIN x2 USING (id)")
def generalised_pagerank(spark, d):
    g = us(spark, d).kept()
    return propagate.generalised(g, g.vertices.select("id", (F.col("id") % 3).cast("double").alias("x")), [0.5, 0.3, 0.2]).select("id", r6("x"))


@query("seed_gate", f"WITH {_US}, {_AN}, {_HOP.format(k=1, b=0)} SELECT id, round((1 + 0.5e0 * x0.x) * (1 + 0.25e0 * x1.x), 6) AS x FROM x0 JOIN x1 USING (id)")
def seed_gate(spark, d):
    g = us(spark, d).kept()
    return propagate.gated(g, g.vertices.select("id", (F.col("id") % 3).cast("double").alias("x")), [0.5, 0.25]).select("id", r6("x"))


@query("nonlinear_propagation", f"""WITH {_US}, {_AN}, b AS (SELECT id, (id % 3)::DOUBLE AS p, (id % 5)::DOUBLE - 2 AS q FROM vs),
 s AS (SELECT i AS id, sum(w * p) AS p, sum(w * q) AS q FROM an JOIN b ON j = b.id GROUP BY i)
 SELECT b.id, round(greatest(0.85e0 * (coalesce(s.p, 0) * 0.5e0 + coalesce(s.q, 0) * -0.25e0) + 0.15e0 * b.p, 0), 6) AS p, round(greatest(0.85e0 * (coalesce(s.p, 0) * 0.1e0 + coalesce(s.q, 0) * 1.0e0) + 0.15e0 * b.q, 0), 6) AS q FROM b LEFT JOIN s USING (id)""")
def nonlinear_propagation(spark, d):
    g = us(spark, d).kept()
    start = g.vertices.select("id", F.array((F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double") - 2).alias("h"))
    h = propagate.nonlinear(g, start, 1, [[0.5, 0.1], [-0.25, 1.0]])
    return h.select("id", F.round(F.get("h", F.lit(0)), 6).alias("p"), F.round(F.get("h", F.lit(1)), 6).alias("q"))


@query("pooled_vectors", "SELECT label AS graph, round(avg(embedding[1]::DOUBLE), 6) AS mean0, round(max(embedding[1]::DOUBLE), 6) AS max0, round(sum((1 + vec_id % 3) * embedding[1]::DOUBLE) / sum(1 + vec_id % 3), 6) AS seed0 FROM embeddings GROUP BY label")
def pooled_vectors(spark, d):
    """Mean, maximum and seed-weighted pools of vectors by group."""
    e = table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    h = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    groups = e.select(F.col("label").alias("graph"), F.col("vec_id").alias("id"), (1.0 + F.col("vec_id") % 3).alias("w"))
    p = propagate.readout(h, groups, size, "seed_multi")
    return p.select("graph", *[F.round(F.get("h", F.lit(k * size)), 6).alias(n) for k, n in enumerate(("mean0", "max0", "seed0"))])


@query("directed_ppr_matrix", f"WITH {_US}, e AS (SELECT src, dst FROM us UNION SELECT id, id FROM vs) SELECT dst AS i, src AS j, round(1.0e0 / count(*) OVER (PARTITION BY src), 6) AS w FROM e")
def directed_ppr_matrix(spark, d):
    return propagate.directed_matrix(us(spark, d)).select("i", "j", r6("w"))


_SCC = "r AS (SELECT id AS a, id AS b FROM vs UNION SELECT a, dst FROM r JOIN us ON src = b), cm AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query("core_stats", f"WITH RECURSIVE {_US}, {_SCC}, t AS (SELECT component FROM cm GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), k AS (SELECT id FROM cm JOIN t USING (component)), x AS (SELECT (SELECT count(*) FROM k) AS n, (SELECT count(*) FROM us WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) AS m) SELECT n::BIGINT AS n, m::BIGINT AS m, round(CASE WHEN n > 1 THEN m / (n * (n - 1)) ELSE 0 END, 6) AS density FROM x")
def core_stats(spark, d):
    return basic.basic_stats(traversal.core(us(spark, d).kept())[0]).select("n", "m", r6("density"))


@query("weak_components_orders", "WITH RECURSIVE us AS (SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst FROM orders), un AS (SELECT src, dst FROM us UNION SELECT dst, src FROM us), vs AS (SELECT DISTINCT src AS id FROM un), r AS (SELECT id AS a, id AS b FROM vs UNION SELECT a, dst FROM r JOIN un ON src = b) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def weak_components_orders(spark, d):
    """Customers and their orders: a graph of as many components as customers with orders."""
    o = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
    return traversal.weak_components(Graph.of(o).kept())


@query("shortest_path", f"WITH RECURSIVE {_US}, b AS (SELECT min(id) AS id, 0 AS level FROM vs UNION SELECT dst, level + 1 FROM b JOIN us ON src = b.id WHERE level < 12), lv AS (SELECT id, min(level) AS level FROM b GROUP BY id), "
                        "pa AS (SELECT dst AS id, min(src) AS parent FROM us JOIN lv a ON a.id = src JOIN lv c ON c.id = dst WHERE c.level = a.level + 1 GROUP BY dst), "
                        "p AS (SELECT max(id) AS id, max(id)::VARCHAR AS path FROM vs UNION ALL SELECT parent, parent::VARCHAR || ',' || path FROM p JOIN pa USING (id)) SELECT path FROM p WHERE id = (SELECT min(id) FROM vs)")
def shortest_path(spark, d):
    g = us(spark, d).kept()
    a, b = g.vertices.agg(F.min("id"), F.max("id")).first()
    return traversal.shortest_path(g, a, b).select(F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("colink_participation", f"WITH {_US}, c AS (SELECT a.src AS a, a.dst AS b FROM us a JOIN us b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), p AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM c UNION ALL SELECT b FROM c) GROUP BY id) SELECT id, coalesce(k, 0)::BIGINT AS n_colinks FROM vs LEFT JOIN p USING (id)")
def colink_participation(spark, d):
    g = us(spark, d).kept()
    return overlap.participation(g, overlap.colinks(g), ["a", "b"], "n_colinks")


@query("reference_additions", f"WITH {_US}, p AS (SELECT a.id, (SELECT count(*) FROM us x JOIN us y ON x.dst = y.dst WHERE x.src = a.id AND y.src = a.id - 1) AS copied, (SELECT count(*) FROM us WHERE src = a.id) AS n FROM vs a WHERE a.id - 1 IN (SELECT id FROM vs)) SELECT id, copied::INT AS n_copied, (n - copied)::INT AS n_added FROM p")
def reference_additions(spark, d):
    """Each list as copied places of the list of the vertex before it, and additions."""
    a = us(spark, d).kept().neighbour_lists()
    x = overlap.as_reference(a, a.select((F.col("id") + 1).alias("id"), "nbrs"))
    return x.select("id", F.size("positions").alias("n_copied"), F.size("additions").alias("n_added"))


@query("partition_count")
def partition_count(spark, d):
    return community.partition_count(us(spark, d).kept())


@query("communities_directed")
def communities_directed(spark, d):
    return community.louvain(us(spark, d).kept(), passes=4, directed=True)


@query("clustering_walks")
def clustering_walks(spark, d):
    g = us(spark, d).kept()
    return traversal.clustering_walks(g, g.vertices, 3)


# text ------------------------------------------------------------------------------

_RI = "ri AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, token_id ORDER BY i) AS nx FROM (SELECT doc_id, token_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM ti))"
_AH = "ah AS (SELECT a.doc_id, a.token_id AS u, b.token_id AS v, b.i - a.i AS k FROM ri a JOIN ri b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + 5 AND (a.nx IS NULL OR b.i < a.nx))"


@query("collocations", f"WITH {_TOK}, {_VOC}, {_RI}, {_AH} SELECT doc_id, u, v, count(*) AS n, sum(k - 1)::BIGINT AS d FROM ah GROUP BY ALL")
def collocations(spark, d):
    return text.collocations(*_vocab(spark, d), 5)


@query("collocation_weights", f"WITH {_TOK}, {_VOC}, {_RI}, {_AH}, f AS (SELECT doc_id, u, v, sum(exp(-k::DOUBLE)) AS f FROM ah GROUP BY ALL), t AS (SELECT doc_id, sum(f) AS t FROM f GROUP BY doc_id) SELECT u, v, round(sum(-ln(f / t)), 6) AS w FROM f JOIN t USING (doc_id) GROUP BY u, v")
def collocation_weights(spark, d):
    return text.collocation_weights(*_vocab(spark, d), 5).select("u", "v", r6("w"))


@query("token_locality", f"WITH {_TOK}, {_VOC}, m AS (SELECT DISTINCT a.doc_id, a.token_id AS u, b.token_id AS v FROM ti a JOIN ti b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND a.token_id < b.token_id), c AS (SELECT u, v, count(*) AS close FROM m GROUP BY u, v), h AS (SELECT DISTINCT doc_id, token_id FROM ti) "
                         "SELECT u, v, count(*) AS both, any_value(close) AS close FROM c JOIN h a ON a.token_id = u JOIN h b ON b.token_id = v AND b.doc_id = a.doc_id GROUP BY u, v")
def token_locality(spark, d):
    return text.locality(*_vocab(spark, d), 5)


@query("locality_surprise")
def locality_surprise(spark, d):
    return text.locality_surprise(*_vocab(spark, d), 10).select("u", "v", r6("w"))


_KERNEL = f"WITH {_TOK}, {_VOC}, {_WIN}, pr AS (SELECT u, v, count(*)::DOUBLE AS w FROM (SELECT u, unnest(items) AS v FROM (SELECT items, unnest(items) AS u FROM wi)) WHERE u < v GROUP BY ALL)"


@query("top_per_token", f"{_KERNEL}, b AS (SELECT u, v, w FROM pr UNION ALL SELECT v, u, w FROM pr), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM b) WHERE r <= 10) SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM t GROUP BY 1, 2")
def top_per_token(spark, d):
    return text.heaviest_windows(*_vocab(spark, d), 5, 10)


@query("domain_graph", f"{_KERNEL}, n AS (SELECT count(*) AS n FROM vc), k AS (SELECT floor(0.0005e0 * n * (n - 1) / 2 + 0.5)::BIGINT AS k FROM n), l AS (SELECT w AS lim FROM (SELECT w, row_number() OVER (ORDER BY w DESC) AS r FROM pr), k WHERE r = least(k, (SELECT count(*) FROM pr))) SELECT u, v, w FROM pr, l WHERE w >= lim")
def domain_graph(spark, d):
    from ..runtime import saved, work_dir

    t, v = _vocab(spark, d)
    return text.domain_graph(saved(text.window_counts(t, v, 5), work_dir(spark, "kernel")), v.count(), 0.0005, weighted=True)


@query("stems", f"WITH {_TOK} SELECT DISTINCT token FROM tk")
def stems(spark, d):
    """The distinct tokens, of which the stems are taken and counted to be of three letters at least or unchanged."""
    t = text.distinct_tokens(table(spark, d, "documents")).withColumn("stem", text.stem(F.col("token")))
    return t.filter((F.length("stem") >= 3) | (F.col("stem") == F.col("token"))).select("token")
