import json

from pyspark.sql import functions as F

from filigraph import metabolic
from filigraph.sources import tables
from filigraph.streaming import ingest


def test_edge_list(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("src,dst\n30,10\n# note\n\n10,20\n30,10\nx\n")
    g, ids = tables.edge_list(spark, str(p), header=True)
    assert sorted((int(r.raw), r.id) for r in ids.collect()) == [(10, 2), (20, 3), (30, 1)]
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (2, 3)]


def test_pajek(spark, tmp_path):
    p = tmp_path / "g.net"
    p.write_text('% c\n*Vertices 3\n1 "A"\n2 "B"\n3 "C"\n*Arcs\n1 2 1\n3 3\n')
    g, labels = tables.pajek(spark, str(p))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (3, 3)]
    assert [r.label for r in labels.orderBy("id").collect()] == ["a", "b", "c"]


def test_corpora(spark, tmp_path):
    d = tmp_path / "blogs"
    d.mkdir()
    (d / "7.male.25.Arts.Leo.xml").write_text("<Blog><post>\n one two </post><post>three</post></Blog>")
    got = tables.blog_corpus(spark, str(d)).collect()
    assert [(r.blogger_id, r.age, r.post, r.text.strip()) for r in got] == [("7", 25, 0, "one two"), ("7", 25, 1, "three")]
    a, b = tmp_path / "i.txt", tmp_path / "t.txt"
    a.write_text("d1\ttrain\tx\nd2\ttest\ty\n")
    b.write_text("hello\nworld\n")
    got = tables.split_corpus(spark, str(a), str(b)).orderBy("doc_id").collect()
    assert [(r.split, r.label_id, r.text) for r in got] == [("train", 1, "hello"), ("test", 2, "world")]


def test_models_and_vectors(spark, tmp_path):
    m = {"metabolites": [{"id": "a_c", "formula": "CO2"}], "reactions": [{"id": "r", "lower_bound": 0, "upper_bound": 1, "metabolites": {"a_c": -1, "b_c": 1}}]}
    p = tmp_path / "m.json"
    p.write_text(json.dumps(m))
    assert metabolic.stoichiometry(tables.metabolic_models(spark, str(p))).count() == 2
    v = tmp_path / "v.txt"
    v.write_text("a 1 2\nb 1\n")
    assert [r.word for r in tables.word_vectors(spark, str(v), 2).collect()] == ["a"]
    t = tmp_path / "s.tsv"
    t.write_text("s\tp\tscore\na\tb\t0.5\na\tc\tx\n")
    assert tables.transition_scores(spark, str(t)).count() == 1


def test_graph_files(spark, tmp_path):
    from filigraph.generators import clique

    g = clique(spark, 4)
    tables.write_graph(g, str(tmp_path / "g"))
    assert tables.read_graph(spark, str(tmp_path / "g")).edges.count() == 12
    tables.write_edge_csv(g.edges, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 12


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select 1L as event_id, timestamp'2024-01-01 00:10' as ts, 5L as user_id, 'a' as event_type, 2.0D as value, '' as props").write.parquet(str(src))
    s = ingest.windowed_counts(ingest.event_stream(spark, str(src)))
    ingest.run_once(s, "seen", str(tmp_path / "cp"))
    assert [(r.n, r.total) for r in spark.table("seen").collect()] == [(1, 2.0)]
    batch = ingest.windowed_counts(spark.read.parquet(str(src)))
    assert batch.select(F.sum("n")).first()[0] == 1


def test_chunk_codes():
    import random

    from filigraph.sources import container

    r = random.Random(3)
    lists = [(300 + i, sorted(r.sample(range(2000), r.choice([0, 0, 1, 3, 9, 40])))) for i in range(60)]
    lists[5] = (305, lists[4][1])
    for code in container.CODES:
        data = container.packed(lists, code, 7)
        assert container.unpacked(data, 300, 60, code) == lists, code
        assert lists[17] in container.unpacked(data, 300, 60, code, 317), code
        if code in ("plain", "coder"):
            assert container.unpacked(data, 300, 60, code, 317) == [lists[17]] and container.unpacked(data, 300, 60, code, 400) == []
    empty = [(0, []), (1, [])]
    assert all(container.unpacked(container.packed(empty, c, 7), 0, 2, c) == empty for c in container.CODES)


def test_containers_of_every_kind(spark, tmp_path):
    from filigraph import generators
    from filigraph.sources import container

    g = generators.web_graph(spark, 150, 6).kept()
    want = {r.id: r.nbrs for r in g.neighbour_lists().collect()}
    for code in ("plain", "coder", "entropy", "huffman"):
        path = str(tmp_path / code)
        container.write(g, path, code, chunk=64, files=2)
        got = {r.id: r.nbrs for r in container.read(spark, path).collect() if r.id}
        assert got == want, code
        assert [r.nbrs for r in container.read(spark, path).filter("id = 77").collect()] == [want[77]]


def test_tuples_and_states(spark, tmp_path):
    import numpy as np

    (tmp_path / "t.bin").write_bytes(np.array([[1, 2], [2, 3], [1, 2]], ">u4").tobytes())
    assert sorted(map(tuple, tables.tuples(spark, str(tmp_path / "t.bin"), 2).collect())) == [(1, 2), (1, 2), (2, 3)]
    p = str(tmp_path / "state.npz")
    for epoch in (1, 2):
        tables.save_state(p, epoch, 0.5, 1.25, w=np.arange(3))
    s = tables.load_state(p)
    assert (s["epoch"], s["accuracy"], s["loss"], s["w"].tolist()) == (2, 0.5, 1.25, [0, 1, 2])
    tables.write_metabolic(spark.createDataFrame([(1, "x_c", "a, b")], "id long, bigg_id string, name string"), spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m_metabolites"), header=True).first().name == "a; b"


def test_conditions_and_sampled_fluxes(spark):
    rows = [("EX_glc__D_e", "g", -1.0, -5.0, 0.0), ("up", "g", -1.0, 0.0, 100.0), ("up", "p", 1.0, 0.0, 100.0), ("out", "p", -1.0, 0.0, 100.0), ("alt", "g", -1.0, 0.0, 1.0), ("alt", "p", 1.0, 0.0, 1.0)]
    s = spark.createDataFrame(rows, "rxn string, met string, coeff double, lb double, ub double")
    c = metabolic.with_condition(s, "aerobic_glucose")
    assert {r.rxn: r.lb for r in c.collect()}["EX_glc__D_e"] == -10.0
    best = {r.rxn: r.flux for r in metabolic.flux_balance(c, "out").collect()}
    assert abs(best["out"] - 10) < 1e-6
    mean = {r.rxn: r.flux for r in metabolic.flux_sampled(c, "out", 6).collect()}
    assert 9.5 - 1e-6 <= mean["out"] <= 10 + 1e-6 and abs(mean["up"] + mean["alt"] - mean["out"]) < 1e-6


def test_container_files(spark, tmp_path):
    from filigraph.generators import watts_strogatz
    from filigraph.sources import container

    g = watts_strogatz(spark, 100, 6, 0.1).kept()
    path = str(tmp_path / "c")
    container.write(g, path, chunk=16, files=3)
    want = {r.id: r.nbrs for r in g.neighbour_lists().collect()}
    got = {r.id: r.nbrs for r in container.read(spark, path).collect()}
    assert {i: x for i, x in got.items() if i in want} == want and all(not x for i, x in got.items() if i not in want)
    assert [r.nbrs for r in container.read(spark, path).filter("id = 40").collect()] == [want[40]]
