"""List, bitmap, permutation and entropy codecs round trip; the list coder decodes and looks up."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filigraph.functions import entropy, lists
from filigraph.functions.codes import Bits
from filigraph.graph import Graph
from filigraph.operators import coder, codec, community, overlap, traversal


def back(write, read, given, how=()):
    w = Bits()
    write(w, *given)
    return read(Bits(w.bytes()), *how)


@pytest.fixture
def r():
    return random.Random(5)


@pytest.mark.parametrize("code", ["gamma", "delta", "fibonacci", "zeta"])
def test_lists(r, code):
    for _ in range(60):
        xs, near = sorted(r.sample(range(80), r.randint(0, 40))), r.randint(0, 90)
        for f, g in ((lists.write_gaps, lists.read_gaps), (lists.write_stop, lists.read_stop), (lists.write_runs, lists.read_runs)):
            assert back(f, g, (xs, code, near), (code, near)) == xs == back(f, g, (xs, code), (code,))
        for sides in (False, True):
            for least in (2, 5):
                assert back(lists.write_intervals, lists.read_intervals, (xs, code, least, near, sides), (code, least, near, sides)) == xs
        bits = [r.random() < 0.6 for _ in range(r.randint(0, 30))]
        for f, g in (*lists._COPIES, (lists.write_copy, lists.read_copy)):
            assert back(f, g, (bits, code), (len(bits), code)) == bits
        cmds = lists.commands(xs)
        assert back(lists.write_commands, lists.read_commands, (cmds, code), (code,)) == cmds and lists.replayed(cmds) == xs


def test_references_in_commands():
    cmds = [("reference", 2, [0, 2]), ("block", [7, 9]), ("gap", 3), ("stop",)]
    assert back(lists.write_commands, lists.read_commands, (cmds, "gamma"), ("gamma",)) == cmds
    assert lists.replayed(cmds, lambda d: [4, 5, 6] if d == 2 else []) == [2, 4, 6, 7, 9]


def test_vectors_permutations_and_ranks(r):
    for _ in range(60):
        xs, ref = sorted(r.sample(range(80), r.randint(0, 40))), sorted(r.sample(range(80), 30))
        assert back(lists.write_elias_fano, lists.read_elias_fano, (xs,)) == xs
        copied, rest = lists.split_reference(xs, ref)
        assert lists.join_reference(ref, copied, rest) == xs
        own = [x for x, c in zip(ref, copied) if c]
        ranks = lists.rank_gaps(rest, own)
        assert lists.unrank_gaps(ranks, own) == rest and all(a <= b for a, b in zip(ranks, rest))
        p = list(range(len(xs)))
        r.shuffle(p)
        assert all(back(lists.write_permutation, lists.read_permutation, (p, h), (h,)) == p for h in ("raw", "lehmer"))
        v = [r.choice([0, 0, 0, 1, 5, 100]) for _ in range(20)]
        assert back(lists.write_sparse, lists.read_sparse, (v,)) == v == back(lists.write_vector, lists.read_vector, (v,))
    assert [back(lists.write_small, lists.read_small, (k,)) for k in range(9)] == list(range(9))
    assert [lists.cost(lists.write_small, k) for k in range(4)] == [2, 2, 2, 6]
    links = {(0, 2), (1, 3)}
    assert back(lists.write_triangle, lists.read_triangle, (links, 5), (5,)) == links
    assert back(lists.write_pairs, lists.read_pairs, ([[1, 4], [], [0]],), (3,)) == [[1, 4], [], [0]]


def test_entropy_coders(r):
    for _ in range(20):
        s = [r.randint(0, 9) ** 2 for _ in range(60)]
        tree = entropy.huffman_tree(Counter(s))
        assert back(entropy.write_tree, entropy.read_tree, (tree,)) == tree
        words = entropy.huffman_codes(tree)
        w = Bits()
        entropy.write_huffman(w, s, words)
        assert entropy.read_huffman(Bits(w.bytes()), tree, 60) == s
        numbers = [r.choice([r.randint(0, 40), r.randint(0, 1 << 60)]) for _ in range(200)]
        e = entropy.NumberEncoder()
        for x in numbers:
            e.put(x)
        d = entropy.NumberDecoder(e.finish())
        assert [d.take() for _ in numbers] == numbers
        bits = [r.random() < 0.1 for _ in range(400)]
        b = entropy.BitEncoder()
        for x in bits:
            b.put(x)
        data = b.finish()
        d = entropy.BitDecoder(data)
        assert [d.take() for _ in bits] == bits and len(data) < 400 / 8 * 0.8
    assert entropy.huffman_codes(entropy.huffman_tree({7: 3})) == {7: ""} and entropy.huffman_tree({}) is None


def test_headers_are_a_prefix_code():
    words = sorted(coder.HEADERS.values())
    assert sum(2.0 ** -len(w) for w in words) == 1 and not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_list_coder(r):
    rows = []
    for v in range(150):
        if rows and r.random() < 0.6:
            xs = {x for x in r.choice(rows[-10:]) if r.random() < 0.8} | set(r.sample(range(300), r.randint(0, 5)))
        else:
            s = r.randint(0, 290)
            xs = set(range(s, s + r.randint(0, 9))) | set(r.sample(range(300), r.randint(0, 8)))
        rows.append(sorted(xs))
    data, at, chosen = coder.encode(500, rows)
    assert coder.decode(data, 500, 150) == rows and all(coder.lookup(data, at, 500, 500 + k) == xs for k, xs in enumerate(rows))
    assert sum(sum(b.values()) for _, b in chosen) <= 8 * len(data) and {m[0] for m, _ in chosen} > {0, 1}
    plain = sum(lists.cost(lists.write_gaps, xs, "zeta") for xs in rows)
    assert 8 * len(data) < plain
    two = [[*range(0, 40, 3)], [*range(1, 60, 4)], sorted({*range(0, 40, 3), *range(1, 60, 4)})]
    data, at, chosen = coder.encode(0, two)
    assert chosen[2][0][0] == 2 and coder.lookup(data, at, 0, 2) == two[2]


def test_coded_graphs(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (700, 3), (700, 4), (701, 3), (701, 4), (701, 900)], "src long, dst long")
    g = Graph.of(e).kept()
    want = sorted(map(tuple, g.edges.collect()))
    chunks = coder.encoded(g)
    assert sorted(map(tuple, coder.decoded(chunks).collect())) == want
    got = {r.id: r.nbrs for r in coder.neighbours(chunks, spark.createDataFrame([(0,), (701,), (5,), (900,)], "id long")).collect()}
    assert got == {0: [1, 2], 701: [3, 4, 900], 5: [], 900: []}
    assert sorted(map(tuple, coder.entropy_decoded(coder.entropy_coded(g)).collect())) == want
    assert coder.budget(g).agg(F.sum("records")).first()[0] == 5 + 190 + 133  # 0-4, 512-701, 768-900
    assert coder.encoded(Graph(g.edges.limit(0), g.vertices.limit(0))).count() == 0


def test_block_costs_are_exact(spark, r):
    lines = [[r.random() < 0.6 for _ in range(r.randint(1, 20))] for _ in range(40)]
    df = spark.createDataFrame([(i, k, b) for i, x in enumerate(lines) for k, b in enumerate(x)], "id long, pos long, hit boolean")
    got = {x.id: x.bits for x in codec.block_costs(df).collect()}
    assert got == {i: lists.cost(lists.write_blocks, x, "gamma") for i, x in enumerate(lines)}


def test_long_rings_and_chains(spark):
    ring = [(i, i % 1500 + 1) for i in range(1, 1501)]
    more = [(2000, 1), (1500, 3000), (3000, 3001), (3001, 3000), *((k, k + 1) for k in range(4000, 4300)), (4300, 4000), (4100, 4000)]
    g = Graph.of(spark.createDataFrame(ring + more, "src long, dst long")).kept()
    got = {r.id: r.component for r in traversal.strong_components(g).collect()}
    assert all(got[i] == 1 for i in range(1, 1501)) and got[2000] == 2000 and got[3000] == got[3001] == 3000
    assert all(got[k] == 4000 for k in range(4000, 4301))


def test_strong_components_against_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        n = 40
        e = {(r.randrange(n), r.randrange(n)) for _ in range(52)}
        reach = [[i == j or (i, j) in e for j in range(n)] for i in range(n)]
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    reach[i][j] = reach[i][j] or (reach[i][k] and reach[k][j])
        g = Graph.of(spark.createDataFrame(list(e), "src long, dst long"), spark.range(n)).kept()
        got = {x.id: x.component for x in traversal.strong_components(g).collect()}
        assert got == {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}


def test_limits_are_loud(spark):
    g = Graph.of(spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")).kept()
    with pytest.raises(RuntimeError):
        traversal.bfs_levels(g, spark.createDataFrame([(0,)], "id long"), max_levels=4)
    with pytest.raises(RuntimeError):
        traversal.shortest_path(g, 0, 12, max_levels=4)


def test_hub_wedges_are_linear(spark):
    n = 300
    e = [(i, 0) for i in range(1, n + 1)] + [(0, n + i) for i in range(1, n + 1)] + [(n + i, i) for i in range(1, n + 1)]
    g = Graph.of(spark.createDataFrame(e, "src long, dst long")).kept()
    assert overlap.triangles(g).count() == n
    # wedges are built at the leaves, of one edge in and one out each
    rank = {r.id: (r.mn3, r.id) for r in overlap.max_motifs(g).collect()}
    ins, outs = Counter(b for a, b in e if rank[b] < rank[a]), Counter(a for a, b in e if rank[a] < rank[b])
    assert sum(ins[v] * outs[v] for v in rank) <= 3 * n


def test_matching_is_maximal_and_heavy(spark):
    e = [(1, 2, 1.0), (2, 3, 5.0), (3, 4, 1.0), (4, 5, 1.0), (6, 7, 1.0)]
    w = spark.createDataFrame(e, "src long, dst long, w double")
    got = {r.id: r.label for r in community.matching(Graph.of(w), weights=w).collect()}
    assert got[2] == got[3] == 2 and got[6] == got[7] == 6 and got[4] == got[5] == 4 and got[1] == 1


def test_directed_and_refined_communities(spark):
    cliques = [(a, b) for c in (range(1, 7), range(7, 13)) for a in c for b in c if a != b] + [(3, 8), (10, 5)]
    g = Graph.of(spark.createDataFrame(cliques, "src long, dst long")).kept()
    for labels in (community.louvain(g, directed=True), community.leiden(g)):
        assert {r.id: r.label for r in labels.collect()} == {i: 1 if i < 7 else 7 for i in range(1, 13)}
    assert community.partition_count(g).first().parts == 1
    split = community.refined(g, g.vertices.withColumn("label", F.lit(1)))
    assert split.select("label").distinct().count() == 1


def test_orders_of_communities_and_walks(spark):
    from filigraph.operators import ordering

    cliques = [(a, b) for c in (range(1, 9), range(9, 14)) for a in c for b in c if a != b] + [(3, 10), (10, 3)]
    g = Graph.of(spark.createDataFrame(cliques, "src long, dst long"), spark.range(1, 15)).kept()
    labels = g.vertices.withColumn("label", F.expr("case when id < 9 then 1 when id < 14 then 9 else 14 end"))
    for inside, how in (("bisection", {"least": 8, "passes": 2}), ("greedy", {})):
        m = {r.old_id: r.new_id for r in ordering.within_communities(g, labels, inside, **how).collect()}
        assert sorted(m.values()) == list(range(1, 15)) and {m[i] for i in range(1, 9)} == set(range(1, 9)) and m[14] == 14
    e = {tuple(r) for r in g.edges.collect()}
    at = {(r.walk, r.step): r.id for r in traversal.clustering_walks(g, g.vertices, 3).collect()}
    assert all((at[w, k - 1], v) in e or (v == w and w == 14) for (w, k), v in at.items() if k)
    ball = {r.id for r in traversal.walk_ball(g, 1, 6).collect()}
    assert len(ball) == 6 and 1 in ball and ball <= set(range(1, 14))
    df = spark.createDataFrame([([0.0, 1.0, 3.0], 0.1), ([0.0, 1.0, 3.0], 0.3), ([0.0], 0.5), ([], 0.5)], "w array<double>, u double")
    assert [r.p for r in df.select(traversal.drawn_place(F.col("w"), F.col("u")).alias("p")).collect()] == [1, 2, -1, -1]
