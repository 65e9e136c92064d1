import numpy as np
from pyspark.sql import functions as F

from filigraph import generators, simulation
from filigraph.operators import multigrid


def test_layers():
    s = simulation.topology("modular_cells", 60, 1)
    x = simulation.layers(s, 60, 1)
    assert x["C"] <= s and x["E"] <= s and x["T"] <= x["C"] and x["O"] <= s | x["C"]
    assert s == simulation.topology("modular_cells", 60, 1)
    for k in ("federated_hubs", "mesh", "scale_free"):
        e = simulation.topology(k, 40, 2)
        assert e and all((b, a) in e for a, b in e)


def test_sweep_is_deterministic_and_classified(spark):
    sims = simulation.sweep(spark, 6, n=30, steps=8)
    a, b = (sorted(map(tuple, simulation.run(sims).collect())) for _ in range(2))
    assert a == b and len(a) == 6 * 9
    snaps = simulation.run(sims)
    c = simulation.classes(snaps).collect()
    assert len(c) == 6 and {r["class"] for r in c} <= {"extinction", "dormant", "coexistence", "unclassified"}
    assert simulation.time_to_attractor(snaps).count() == 6


def test_trajectory_classes(spark):
    rows = [(i, t, 5 if i != 2 else 0, v) for i, v in ((0, 0.0), (1, 0.2), (2, 0.6), (3, 0.7)) for t in range(20)]
    df = spark.createDataFrame(rows, "sim_id long, t int, n_committed int, phi double")
    assert {r.sim_id: r["class"] for r in simulation.classes(df).collect()} == {0: "extinction", 1: "dormant", 2: "extinction", 3: "coexistence"}


def test_population_and_exposures(spark):
    roles = ["contributor"] * 2 + ["user"] + ["outsider"] * 6 + ["sympathizer"]
    agents = spark.createDataFrame([(0, i, r) for i, r in enumerate(roles)], "sim_id long, id long, role string")
    assert abs(simulation.population(agents).first().committed_share - 0.3) < 1e-12
    edges = spark.createDataFrame([(0, "S", 0, 5), (0, "S", 1, 5), (0, "C", 9, 5)], "sim_id long, layer string, src long, dst long")
    assert [tuple(r) for r in simulation.exposures(agents, edges).collect()] == [(0, 5, "S", 2)]


def test_multigrid_converges(spark):
    g = generators.ring(spark, 80).kept()
    a = multigrid.laplacian(g, 0.1)
    levels = multigrid.setup(a, max_levels=2, min_coarse=10)
    assert len(levels) == 2
    b = g.vertices.select("id", F.when(F.col("id") == 1, 1.0).otherwise(0.0).alias("x"))
    x = g.vertices.select("id", F.lit(0.0).alias("x"))
    r0 = multigrid.residual_norm(levels[0][0], b, x)
    x = multigrid.v_cycle(levels, b, x)
    assert multigrid.residual_norm(levels[0][0], b, x) < 0.5 * r0


def test_hosts_and_order_parameters(spark):
    for host in ("random", "degree", "betweenness", "legibility", "localized", "infiltration_first", "attrition", "adaptive", "none"):
        w = simulation.World("modular_cells", 40, 3, committed=0.3, host=host, budget=3)
        for _ in range(6):
            w.step()
        x = w.order()
        assert all(0 <= v <= 1 for v in x.values()) and 0 <= w.outages() <= simulation.FUNCTIONS
    w = simulation.World("mesh", 12, 1)
    w.role[:] = simulation.RANK["user"]
    w.before["S"] = [[u for u in (v - 1, v + 1) if 0 <= u < 12] for v in range(12)]
    assert int(np.argmax(w._betweenness())) in (5, 6) and w.depth() == 2
    assert simulation.hierarchy(np.ones(5)) == 0 and simulation.hierarchy(np.array([0, 0, 0, 1])) == 0.75
    out = simulation.ablation(spark, ("random", "degree"), samples=2, n=20, steps=4).collect()
    assert {r.host for r in out} == {"random", "degree"} and all(r.runs == 2 for r in out)


def test_generators_with_communities(spark):
    g, lab = generators.lfr(spark, 400, mixing=0.2)
    a = g.edges.join(lab.toDF("src", "a"), "src").join(lab.toDF("dst", "b"), "dst")
    share = a.filter("a = b").count() / a.count()
    assert lab.count() == 400 and 0.6 < share < 0.95
    sizes = [r["count"] for r in lab.groupBy("label").count().collect()]
    assert min(sizes) >= 20
    h, _ = generators.modular_hubs(spark, 60, 3)
    assert h.vertices.count() == 60 and h.edges.filter("src = dst").count() == 0
    assert [k for k, _ in generators.training_batch(spark, 20, 40, 4)] == ["random", "scale_free", "blocks", "web"]
