from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filigraph import generators, metabolic, propagate, text
from filigraph.functions import codes
from filigraph.graph import Graph, numbered, successions
from filigraph.operators import basic, codec, community, info, local, ordering, overlap, ranking, traversal


@pytest.fixture(scope="module")
def two_cliques(spark):
    e = [(a, b) for c in (range(1, 7), range(7, 13)) for a in c for b in c if a != b]
    e += [(3, 8), (8, 3), (5, 10), (10, 5)]
    return Graph.of(spark.createDataFrame(e, "src long, dst long")).kept()


@pytest.fixture(scope="module")
def odd(spark):
    """A cycle 1-2-3, a loop on 4, a tail 3-5-6, a duplicate edge and an isolated 7."""
    e = [(1, 2), (2, 3), (3, 1), (4, 4), (3, 5), (5, 6), (5, 6), (None, 3)]
    return Graph.of(spark.createDataFrame(e, "src long, dst long"), spark.range(1, 8)).kept()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_statistics(odd):
    assert rows(odd.out_degrees()) == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 0), (7, 0)]
    assert rows(basic.sinks(odd)) == [(6,), (7,)]
    assert rows(basic.sources(odd)) == [(7,)]
    n, m, density = basic.basic_stats(odd).first()
    assert (n, m) == (7, 6) and abs(density - 6 / 42) < 1e-12


def test_induced_renumbered(odd):
    g, mapping = odd.induced_renumbered(odd.vertices.filter("id in (3, 5, 6)"))
    assert rows(g.edges) == [(1, 2), (2, 3)]
    assert rows(mapping) == [(3, 1), (5, 2), (6, 3)]


def test_components(odd):
    assert rows(traversal.weak_components(odd)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 1), (7, 7)]
    assert rows(traversal.strong_components(odd)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_paths(odd, spark):
    assert traversal.shortest_path(odd, 1, 6).first().path == [1, 2, 3, 5, 6]
    assert traversal.shortest_path(odd, 6, 1).count() == 0
    assert rows(traversal.bfs_levels(odd, spark.createDataFrame([(1,)], "id long"))) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]


def test_triangles_and_colinks(odd, two_cliques):
    assert rows(overlap.triangles(odd)) == [(1, 2, 3)] or overlap.triangles(odd).count() == 1
    assert overlap.colinks(two_cliques).count() == 32
    assert overlap.colinks(odd).count() == 0


def test_two_cliques_communities(two_cliques):
    for labels in (community.louvain(two_cliques, levels=2, passes=4), community.leiden(two_cliques, levels=2, passes=4)):
        by = defaultdict(set)
        for r in labels.collect():
            by[r.label].add(r.id)
        assert sorted(map(sorted, by.values())) == [[*range(1, 7)], [*range(7, 13)]]


def test_partition(two_cliques):
    parts = {r.label for r in community.bisection_partition(two_cliques, 2, passes=1, levels=1).collect()}
    assert parts == {1, 2}


def test_pagerank_is_the_matrix_iteration(two_cliques):
    import numpy as np

    n = 12
    a = np.zeros((n, n))
    for s, d in rows(two_cliques.edges):
        a[s - 1, d - 1] = 1
    p = a / a.sum(1, keepdims=True)
    x = np.full(n, 1 / n)
    for _ in range(6):
        x = 0.15 / n + 0.85 * p.T @ x
    got = [r[1] for r in rows(ranking.pagerank(two_cliques, epsilon=0, max_iter=6))]
    assert np.abs(x - got).max() < 1e-12


def test_push_keeps_its_guarantee(two_cliques, spark):
    seed = spark.createDataFrame([(1,)], "id long")
    p = ranking.push(two_cliques, seed, epsilon=1e-2).join(two_cliques.out_degrees(), "id")
    assert p.filter(F.col("r") >= 1e-2 * F.col("out_degree")).count() == 0
    assert abs(p.agg(F.sum("p") + F.sum("r")).first()[0] - 1) < 1e-9


def test_k_cores(spark):
    e = [(a, b) for a in range(1, 6) for b in range(1, 6) if a != b] + [(5, 6), (6, 5), (6, 7), (7, 6)]
    g = Graph.of(spark.createDataFrame(e, "src long, dst long")).kept()
    assert max(r.core for r in traversal.k_cores(g).collect()) == 8


def test_appnp_tends_to_its_closed_form(two_cliques):
    import numpy as np

    m = {(r.i, r.j): r.w for r in basic.symmetric_normalised(two_cliques).collect()}
    a = np.array([[m.get((i, j), 0.0) for j in range(1, 13)] for i in range(1, 13)])
    v = np.array([i % 3 for i in range(1, 13)], float)
    want = np.linalg.solve(np.eye(12) - 0.4 * a, 0.6 * v)
    got = propagate.appnp(two_cliques, two_cliques.vertices.select("id", (F.col("id") % 3).cast("double").alias("x")), 12, alpha=0.6)
    assert np.abs(want - [r[1] for r in rows(got)]).max() < 1e-4


def test_orderings_are_permutations(odd):
    n = odd.vertices.count()
    for m in (ordering.by_score(odd), ordering.lexicographic(odd), ordering.web_lexicographic(odd), ordering.minhash(odd, 4), ordering.breadth_first(odd, symmetric=True, reverse=True, by_degree=True),
              ordering.recursive_bisection(odd, 1, 1), ordering.random_order(odd)):
        got = m.collect()
        assert sorted(r.new_id for r in got) == [*range(1, n + 1)] and sorted(r.old_id for r in got) == [*range(1, 8)]


def test_greedy_within_clusters(two_cliques):
    labels = two_cliques.vertices.select("id", F.when(F.col("id") <= 6, 1).otherwise(2).cast("long").alias("label"))
    got = {r.old_id: r.new_id for r in ordering.greedy_within(two_cliques, labels).collect()}
    assert {got[i] for i in range(1, 7)} == {*range(1, 7)}


@pytest.mark.parametrize("v, gamma, delta, z2, z3", [(1, "1", "1", "10", "100"), (2, "010", "0100", "110", "1010"), (3, "011", "0101", "111", "1011"), (4, "00100", "01100", "01000", "1100"), (5, "00101", "01101", "01001", "1101"), (8, "0001000", "00100000", "011000", "0100000")])
def test_code_words(v, gamma, delta, z2, z3):
    def word(code, **p):
        w = codes.Bits()
        codes.write(w, v, code, **p)
        return "".join(map(str, w.bits))

    assert (word("gamma"), word("delta"), word("zeta", k=2), word("zeta", k=3)) == (gamma, delta, z2, z3)


def test_code_lengths_are_those_of_the_words(spark):
    values = [*range(1, 140), 1000, 4095, 4096, 10**6, 2**31, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    kinds = [("gamma", {}), ("delta", {}), ("fibonacci", {}), ("zeta", {"k": 2}), ("zeta", {"k": 3}), ("golomb", {"b": 64}), ("rice", {"k": 3}), ("fed", {})]
    got = df.select("v", *[codes.length(F.col("v"), c, **p).alias(f"c{i}") for i, (c, p) in enumerate(kinds)]).collect()
    for r in got:
        for i, (c, p) in enumerate(kinds):
            if c in ("golomb", "rice") and r.v > 10**5:
                continue
            w = codes.Bits()
            codes.write(w, r.v, c, **p)
            assert len(w.bits) == r[f"c{i}"], (r.v, c)
            assert codes.read(w, c, **p) == r.v
    assert df.select(codes.gamma(F.lit(0))).first()[0] is None
    with pytest.raises(ValueError):
        codes.write(codes.Bits(), 0, "gamma")


@pytest.mark.parametrize("code", ["gamma", "delta", "zeta", "fibonacci"])
def test_container_round_trip(two_cliques, code):
    chunks = codec.encoded_chunks(two_cliques, size=4, code=code)
    back = {r.id: r.nbrs for r in codec.decoded_lists(chunks, code).collect()}
    for r in two_cliques.neighbour_lists().collect():
        assert back[r.id] == r.nbrs
    assert codec.neighbours(chunks, 8, 4, code).first().nbrs == [3, 7, 9, 10, 11, 12]


def test_huffman_size(spark):
    import heapq

    g = generators.random_out(spark, 60, 5).kept()
    h = [r.in_degree for r in g.in_degrees().collect() if r.in_degree]
    heapq.heapify(h)
    total = 0
    while len(h) > 1:
        s = heapq.heappop(h) + heapq.heappop(h)
        total += s
        heapq.heappush(h, s)
    assert codec.huffman_bits(g).first()[0] == total


def test_local_growth(two_cliques):
    s = two_cliques.vertices.filter("id <= 6")
    r = local.conductance(two_cliques, s).first()
    assert (r.volume, r.cut) == (32, 2) and abs(r.conductance - 2 / 32) < 1e-12
    assert {x.id for x in local.children_by_support(two_cliques, s).collect()} == {8, 10}
    assert {x.id for x in local.children_by_modularity(two_cliques, s).collect()} == {8, 10}


def test_information(two_cliques, spark):
    assert abs(info.entropy(spark.createDataFrame([(x,) for x in "aabb"], "x string"), "x").first()[0] - 1) < 1e-12
    assert abs(info.gini(spark.createDataFrame([(1.0,)] * 5, "x double"), "x").first()[0]) < 1e-12
    labels = two_cliques.vertices.select("id", (F.col("id") > 6).cast("long").alias("label"))
    assert abs(info.modularity(two_cliques, labels).first()[0] - (60 / 64 - 0.5)) < 1e-12
    assert info.window_overlaps(two_cliques, 7).filter("d < 1 or d > 7").count() == 0


def test_overlap_rows(spark):
    data = {1: [2, 5, 9], 2: [5, 7], 3: [4, 5, 9, 10], 4: [2, 5, 8], 5: [2, 5, 6, 9]}
    r = spark.createDataFrame([(i, x) for i, xs in data.items() for x in xs], "row_id long, item long")
    t = spark.createDataFrame([(0, x) for x in (2, 5, 9)], "target_id long, item long")
    assert [x[2] for x in rows(overlap.overlaps(r, t))] == [3, 1, 2, 2, 3]
    assert [x.row_id for x in overlap.topk_overlaps(r, t, 2).orderBy("rank").collect()] == [1, 5]


def test_numbered_and_successions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = numbered(df, [F.col("x")], "k").collect()
    assert all(r.k == r.x + 1 for r in got)
    e = spark.sql("select * from values (1, timestamp'2024-01-01 01:00', 5), (2, timestamp'2024-01-01 02:00', 6), (3, timestamp'2024-01-03 00:00', 5), (4, timestamp'2024-01-03 00:00', 5) t(event_id, ts, user_id)")
    assert rows(successions(e)) == [(5, 6), (6, 5)]


def test_empty_graph(spark):
    g = Graph.of(spark.createDataFrame([], "src long, dst long"), spark.range(0)).kept()
    assert g.out_degrees().count() == 0 and overlap.triangles(g).count() == 0 and traversal.weak_components(g).count() == 0


def test_text(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran!"), (2, None), (3, "")], "doc_id long, text string")
    t = text.tokens(docs)
    assert t.count() == 6
    v = text.vocabulary(t)
    assert v.filter("token_id = 1").first().token == "the"
    assert text.windows(t, v, 3).count() == 6
    assert text.hyperedges(docs, v).count() == 6
    w = text.tfidf(t, v, docs)
    assert abs(w.agg(F.sum("w")).first()[0] - 1) < 1e-9


def test_reactions(spark):
    s = spark.createDataFrame([("r1", "a_c", -1.0, -10.0, 10.0), ("r1", "b_c", 1.0, -10.0, 10.0), ("r2", "b_c", -1.0, 0.0, 5.0), ("in", "a_c", 1.0, 0.0, 8.0)], "rxn string, met string, coeff double, lb double, ub double")
    assert rows(metabolic.reaction_graph(s)) == [("a_c", "b_c"), ("b_c", "a_c")]
    f = {r.rxn: (r.flux, r.status) for r in metabolic.flux_balance(s, "r2").collect()}
    assert f["r2"][1] == "optimal" and abs(f["r2"][0] - 5) < 1e-6 and abs(f["r1"][0] - 5) < 1e-6
    p = metabolic.lightest_paths(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "src string, dst string, w double"), "a")
    assert {r.id: (r.cost, r.path) for r in p.collect()}["c"] == (2.0, ["a", "b", "c"])


def test_generators(spark):
    assert generators.ring(spark, 5).edges.count() == 5
    assert generators.clique(spark, 5).edges.count() == 20
    a = rows(generators.watts_strogatz(spark, 50, 4, 0.2).edges)
    assert a == rows(generators.watts_strogatz(spark, 50, 4, 0.2).edges) and 150 < len(a) <= 200
    assert 250 < generators.erdos_renyi(spark, 100, 0.04).edges.count() < 550
    low, high = generators.power_law(spark, 2.0, 500, 1, 100).agg(F.min("value"), F.max("value")).first()
    assert low == 1 and high <= 100


def test_path_kernels():
    from filigraph.operators import paths

    near = {1: [2, 3], 2: [4], 3: [4], 4: [5]}
    score = {1: 1.0, 2: 0.5, 3: 0.4, 4: 0.9, 5: 1.0}
    assert paths.greedy(near, score, 1, 5, 10) == [1, 2, 4, 5]
    for walk in (paths.decayed, paths.bottlenecks, paths.branching):
        assert walk(near, score, 1, 5, 5, 10)[:2] == [[1, 2, 4, 5], [1, 3, 4, 5]], walk
    assert paths.greedy(near, score, 5, 1, 10) == []


def test_path_queries(odd):
    from filigraph.operators import paths

    s = ranking.path_scores(odd, 1, 6, epsilon=0, max_iter=8).select(F.lit(0).cast("long").alias("query"), "id", "product")
    assert [r.path for r in paths.discover(odd, s, [(1, 6)]).collect()] == [[1, 2, 3, 5, 6]]


def test_walks_follow_edges(two_cliques):
    e = {tuple(r) for r in two_cliques.edges.collect()}
    deg = two_cliques.out_degrees().select("id", F.col("out_degree").cast("double").alias("s"))
    for w in (traversal.random_walks(two_cliques, two_cliques.vertices, 3), traversal.scored_walks(two_cliques, two_cliques.vertices, deg, 3)):
        at = {(r.walk, r.step): r.id for r in w.collect()}
        assert all((at[k], at[k[0], k[1] + 1]) in e for k in at if k[1] < 3)
    assert traversal.uniform_sample(two_cliques, 50).count() == 50
    assert traversal.approximate_diameter(two_cliques) == 3


def test_large_path_queries_walk_over_the_tables(spark):
    import random

    r = random.Random(4)
    e = {(r.randrange(30), r.randrange(30)) for _ in range(140)}
    g = Graph.of(spark.createDataFrame(list(e), "src long, dst long"), spark.range(30)).kept()
    from filigraph.operators import paths

    scores = spark.createDataFrame([(0, v, r.random() * (v % 4 > 0)) for v in range(30)], "query long, id long, product double").filter("id <> 29")
    for method in ("decayed", "bottlenecks"):
        a, b = (rows(paths.discover(g, scores, [(0, 29)], method, k=4, top=top).withColumn("low", F.round("low", 9))) for top in (1000, 3))
        assert a and [x[:3] for x in a] == [x[:3] for x in b]
