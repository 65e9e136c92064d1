"""The registered graph queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import generators, metabolic, propagate, text
from ..functions import codes
from ..graph import Graph, successions
from ..operators import basic, codec, community, info, ordering, overlap, ranking, traversal
from ..runtime import saved, ship, work_dir
from ..sources import tables
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def us(spark: SparkSession, d: str) -> Graph:
    """Users who follow one another in the event stream."""
    return Graph.of(successions(table(spark, d, "events")))


def cs(spark: SparkSession, d: str) -> Graph:
    """Customers (even ids) to the suppliers (odd ids) of their orders."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    e = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return Graph.of(e)


def nt(spark: SparkSession, d: str) -> Graph:
    """Nations of customers to nations of their suppliers."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    pairs = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey")
    e = pairs.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph.of(e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")), table(spark, d, "nation").select("n_nationkey"))


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


_US = "us AS (SELECT DISTINCT u AS src, v AS dst FROM (SELECT user_id AS u, lead(user_id) OVER (ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL AND u <> v), vs AS (SELECT src AS id FROM us UNION SELECT dst FROM us)"
_CS = "us AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), vs AS (SELECT src AS id FROM us UNION SELECT dst FROM us)"
_NT = "us AS (SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), vs AS (SELECT n_nationkey::BIGINT AS id FROM nation)"
_DEG = "od AS (SELECT id, coalesce(k, 0)::BIGINT AS od FROM vs LEFT JOIN (SELECT src AS id, count(*) AS k FROM us GROUP BY src) USING (id)), idg AS (SELECT id, coalesce(k, 0)::BIGINT AS ind FROM vs LEFT JOIN (SELECT dst AS id, count(*) AS k FROM us GROUP BY dst) USING (id))"


# degrees, projections ------------------------------------------------------


@query("degree_out", f"WITH {_CS}, {_DEG} SELECT id, od AS out_degree FROM od")
def degree_out(spark, d):
    return cs(spark, d).out_degrees()


@query("degree_in", f"WITH {_CS}, {_DEG} SELECT id, ind AS in_degree FROM idg")
def degree_in(spark, d):
    return cs(spark, d).in_degrees()


@query("degree_in_out", f"WITH {_CS}, {_DEG} SELECT id, ind AS in_degree, od AS out_degree FROM idg JOIN od USING (id)")
def degree_in_out(spark, d):
    g = cs(spark, d)
    return g.in_degrees().join(g.out_degrees(), "id")


@query("top_suppliers", f"WITH {_CS}, {_DEG} SELECT id, ind AS in_degree FROM idg ORDER BY ind DESC, id LIMIT 20")
def top_suppliers(spark, d):
    """The suppliers of most customers: a top-k report."""
    return cs(spark, d).in_degrees().orderBy(F.desc("in_degree"), "id").limit(20)


_STATS = "SELECT n::BIGINT AS n, m::BIGINT AS m, round(m / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM vs), (SELECT count(*) AS m FROM us)"


@query("basic_stats_users", f"WITH {_US} {_STATS}")
def basic_stats_users(spark, d):
    return basic.basic_stats(us(spark, d)).select("n", "m", r6("density"))


@query("basic_stats_nations", f"WITH {_NT} {_STATS}")
def basic_stats_nations(spark, d):
    return basic.basic_stats(nt(spark, d)).select("n", "m", r6("density"))


@query("out_degree_stats", f"WITH {_US}, {_DEG} SELECT round(avg(od), 6) AS avg_out, max(od) AS max_out, count(*) FILTER (od = 0) AS n_sinks FROM od")
def out_degree_stats(spark, d):
    return basic.out_degree_stats(us(spark, d)).select(r6("avg_out"), "max_out", "n_sinks")


@query("sinks", f"WITH {_CS} SELECT id FROM vs WHERE id NOT IN (SELECT src FROM us)")
def sinks(spark, d):
    return basic.sinks(cs(spark, d))


@query("sources", f"WITH {_CS} SELECT id FROM vs WHERE id NOT IN (SELECT dst FROM us)")
def sources(spark, d):
    return basic.sources(cs(spark, d))


@query("reverse_graph", f"WITH {_US} SELECT dst AS src, src AS dst FROM us")
def reverse_graph(spark, d):
    return us(spark, d).reverse().edges


@query("neighbour_lists", f"WITH {_US} SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS nbrs FROM vs LEFT JOIN us ON src = id GROUP BY id")
def neighbour_lists(spark, d):
    return us(spark, d).neighbour_lists().select("id", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))


@query("induced_subgraph", f"WITH {_US}, k AS (SELECT id, row_number() OVER (ORDER BY id) AS nid FROM vs WHERE id % 3 = 0) SELECT a.nid AS src, b.nid AS dst FROM us JOIN k a ON src = a.id JOIN k b ON dst = b.id")
def induced_subgraph(spark, d):
    g = us(spark, d)
    return g.induced_renumbered(g.vertices.filter("id % 3 = 0"))[0].edges


_BALL = "b0 AS (SELECT min(id) AS id FROM vs), b1 AS (SELECT DISTINCT dst AS id FROM us WHERE src IN (SELECT id FROM b0) AND dst NOT IN (SELECT id FROM b0)), b2 AS (SELECT DISTINCT dst AS id FROM us WHERE src IN (SELECT id FROM b1) AND dst NOT IN (SELECT id FROM b0 UNION SELECT id FROM b1))"


@query("forward_ball", f"WITH {_US}, {_BALL} SELECT id, 0 AS level FROM b0 UNION ALL SELECT id, 1 FROM b1 UNION ALL SELECT id, 2 FROM b2")
def forward_ball(spark, d):
    g = us(spark, d).kept()
    return basic.forward_ball(g, g.vertices.agg(F.min("id").alias("id")), 2)


@query("transition_row", f"WITH {_NT}, {_DEG} SELECT src AS i, dst AS j, round(1.0e0 / od, 6) AS w FROM us JOIN od ON src = id")
def transition_row(spark, d):
    return basic.transition(nt(spark, d), "row").select("i", "j", r6("w"))


@query("transition_col", f"WITH {_NT}, {_DEG} SELECT src AS i, dst AS j, round(1.0e0 / ind, 6) AS w FROM us JOIN idg ON dst = id")
def transition_col(spark, d):
    return basic.transition(nt(spark, d), "col").select("i", "j", r6("w"))


@query("sym_normalised", f"WITH {_NT}, a AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0e0 AS w FROM us UNION ALL SELECT id, id, 1.0e0 FROM vs) GROUP BY ALL), r AS (SELECT src AS id, sum(w) AS d FROM a GROUP BY src) SELECT src AS i, dst AS j, round(w / sqrt(x.d * y.d), 6) AS w FROM a JOIN r x ON src = x.id JOIN r y ON dst = y.id")
def sym_normalised(spark, d):
    return basic.symmetric_normalised(nt(spark, d)).select("i", "j", r6("w"))


# overlap, cycles -----------------------------------------------------------


def _rows(g: Graph, modulus: int) -> tuple[DataFrame, DataFrame]:
    """All rows, and the query set: the rows whose id is divisible by ``modulus``."""
    rows = g.edges.select(F.col("src").alias("row_id"), F.col("dst").alias("item"))
    return rows, rows.filter(F.col("row_id") % modulus == 0).withColumnRenamed("row_id", "target_id")


_OV = "ov AS (SELECT a.src AS target_id, b.src AS row_id, count(*) AS overlap FROM us a JOIN us b ON a.dst = b.dst WHERE a.src % 40 = 0 GROUP BY ALL)"


@query("overlap_topk", f"WITH {_CS}, {_OV} SELECT target_id, row_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY overlap DESC, row_id) AS k FROM ov) WHERE k <= 5")
def overlap_topk(spark, d):
    """Each query set against all rows: the five rows of largest overlap."""
    rows, targets = _rows(cs(spark, d).kept(), 40)
    return overlap.topk_overlaps(rows, targets, 5).select("target_id", "row_id", "overlap")


@query("overlap_best", f"WITH {_CS}, {_OV} SELECT target_id, row_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY overlap DESC, row_id) AS k FROM ov) WHERE k = 1")
def overlap_best(spark, d):
    rows, targets = _rows(cs(spark, d).kept(), 40)
    return overlap.best_overlap(rows, targets)


@query("overlap_jaccard", f"WITH {_CS}, {_OV.replace(' WHERE a.src % 40 = 0', '')}, n AS (SELECT src, count(*) AS n FROM us GROUP BY src) SELECT target_id, row_id, overlap, round(overlap / (a.n + b.n - overlap), 6) AS jaccard FROM ov JOIN n a ON a.src = target_id JOIN n b ON b.src = row_id")
def overlap_jaccard(spark, d):
    """All rows against all rows: the result is quadratic in the customers of one supplier."""
    rows, targets = _rows(cs(spark, d).kept(), 1)
    return overlap.jaccards(rows, targets).select("target_id", "row_id", "overlap", r6("jaccard"))


_CO = "co AS (SELECT a.src AS a, a.dst AS b FROM us a JOIN us b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"
_MN = "mu AS (SELECT a.src AS id, count(*) AS k FROM us a JOIN us b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), mn AS (SELECT id, ind AS parents, od AS children, coalesce(k, 0)::BIGINT AS mutual, (ind + od - coalesce(k, 0))::BIGINT AS mn2, (ind * od - coalesce(k, 0))::BIGINT AS mn3 FROM idg JOIN od USING (id) LEFT JOIN mu USING (id))"
_TR = "tr AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM us x JOIN us y ON x.dst = y.src JOIN us z ON y.dst = z.src AND z.dst = x.src JOIN mn ma ON ma.id = x.src JOIN mn mb ON mb.id = x.dst JOIN mn mc ON mc.id = y.dst WHERE (ma.mn3, ma.id) < (mb.mn3, mb.id) AND (ma.mn3, ma.id) < (mc.mn3, mc.id))"


@query("colinks", f"WITH {_US}, {_CO} SELECT a, b FROM co")
def colinks(spark, d):
    return overlap.colinks(us(spark, d))


@query("max_motifs", f"WITH {_US}, {_DEG}, {_MN} SELECT * FROM mn")
def max_motifs(spark, d):
    return overlap.max_motifs(us(spark, d))


@query("colink_coefficients", f"WITH {_US}, {_DEG}, {_MN}, {_CO}, p AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM co UNION ALL SELECT b FROM co) GROUP BY id) SELECT id, coalesce(k, 0)::BIGINT AS n_colinks, round(CASE WHEN mn2 > 0 THEN coalesce(k, 0) / mn2 ELSE 0 END, 6) AS coefficient FROM mn LEFT JOIN p USING (id)")
def colink_coefficients(spark, d):
    return overlap.colink_coefficients(us(spark, d).kept()).select("id", "n_colinks", r6("coefficient"))


@query("triangles", f"WITH {_US}, {_DEG}, {_MN}, {_TR} SELECT a, b, c FROM tr")
def triangles(spark, d):
    return overlap.triangles(us(spark, d).kept())


@query("clustering_coefficients", f"WITH {_US}, {_DEG}, {_MN}, {_TR}, p AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr) GROUP BY id) SELECT id, coalesce(k, 0)::BIGINT AS n_triangles, round(CASE WHEN mn3 > 0 THEN coalesce(k, 0) / mn3 ELSE 0 END, 6) AS coefficient FROM mn LEFT JOIN p USING (id)")
def clustering_coefficients(spark, d):
    return overlap.clustering_coefficients(us(spark, d).kept()).select("id", "n_triangles", r6("coefficient"))


@query("average_clustering", f"WITH {_US}, un AS (SELECT src, dst FROM us UNION SELECT dst, src FROM us), dg AS (SELECT src AS v, count(*) AS d FROM un GROUP BY src HAVING count(*) >= 2), k AS (SELECT a.src AS v, count(*) AS k FROM un a JOIN us e ON e.src = a.dst JOIN un b ON b.src = a.src AND b.dst = e.dst GROUP BY a.src) SELECT round(avg(coalesce(k, 0) / (d * (d - 1))), 6) AS avg_clustering FROM dg LEFT JOIN k USING (v)")
def average_clustering(spark, d):
    return overlap.average_clustering(us(spark, d).kept()).select(r6("avg_clustering"))


for _name, _op, _cond in (("union", "UNION", ""), ("intersect", "INTERSECT", ""), ("except", "EXCEPT", "")):

    @query(f"set_{_name}", f"WITH {_US} SELECT id, (SELECT count(*) FROM (SELECT dst FROM us WHERE src = id {_op} SELECT src FROM us WHERE dst = id))::BIGINT AS size FROM vs")
    def _set(spark, d, kind=_name):
        g = us(spark, d)
        a = g.neighbour_lists().withColumnRenamed("nbrs", "x")
        b = g.reverse().neighbour_lists().withColumnRenamed("nbrs", "y")
        return overlap.set_operation(a, b, kind, "x", "y")


# information measures ------------------------------------------------------


@query("entropy_dst", f"WITH {_US}, c AS (SELECT count(*) AS c FROM us GROUP BY dst) SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c")
def entropy_dst(spark, d):
    return info.graph_entropy(us(spark, d), "bits_per_edge", "raw").select(r6("entropy"))


def _degree_entropy(col: str, table_: str) -> str:
    return f"WITH {_US}, {_DEG}, h AS (SELECT {col} AS d, count(*) AS c FROM {table_} GROUP BY 1), s AS (SELECT sum(d * c) AS s FROM h) SELECT round(-sum(c / s * log2(c / s)), 6) AS degree_entropy FROM h, s"


@query("entropy_in_degree", _degree_entropy("ind", "idg"))
def entropy_in_degree(spark, d):
    return info.degree_entropy(us(spark, d), "in_degree").select(r6("degree_entropy"))


@query("entropy_out_degree", _degree_entropy("od", "od"))
def entropy_out_degree(spark, d):
    return info.degree_entropy(us(spark, d), "out_degree").select(r6("degree_entropy"))


_GAP = "g AS (SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM us)"


@query("entropy_delta", f"WITH {_US}, {_GAP}, v AS (SELECT coalesce(gap, dst + 1) AS v FROM g UNION ALL SELECT 1 FROM vs), c AS (SELECT count(*) AS c FROM v GROUP BY v) SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c")
def entropy_delta(spark, d):
    return info.graph_entropy(us(spark, d), "bits_per_edge", "delta").select(r6("entropy"))


@query("modularity_by_region", f"WITH {_NT}, l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS label FROM nation), e AS (SELECT a.label AS a, b.label AS b FROM us JOIN l a ON src = a.id JOIN l b ON dst = b.id), m AS (SELECT count(*) AS m FROM e), c AS (SELECT label, (SELECT count(*) FROM e WHERE a = label AND b = label) AS own, (SELECT count(*) FROM e WHERE a = label) AS o, (SELECT count(*) FROM e WHERE b = label) AS i FROM (SELECT DISTINCT label FROM l)) SELECT round(sum(own / m - (o / m) * (i / m)), 6) AS modularity FROM c, m")
def modularity_by_region(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("label"))
    return info.modularity(nt(spark, d), labels).select(r6("modularity"))


@query("density_by_region", f"WITH {_NT}, l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label FROM nation), n AS (SELECT label, count(*) AS size FROM l GROUP BY label), k AS (SELECT a.label, count(*) AS k FROM us JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.label = b.label AND src <> dst GROUP BY a.label) SELECT label, size, round(coalesce(k, 0) / (size * (size - 1)), 6) AS density FROM n LEFT JOIN k USING (label)")
def density_by_region(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))
    return info.cluster_density(nt(spark, d), labels).select("label", "size", r6("density"))


@query("gini_degree", f"WITH {_CS}, {_DEG}, r AS (SELECT ind AS x, row_number() OVER (ORDER BY ind) AS i FROM idg) SELECT round(greatest(0, least(1, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*))), 6) AS gini FROM r")
def gini_degree(spark, d):
    return info.gini(cs(spark, d).in_degrees(), "in_degree").select(r6("gini"))


@query("gaps", f"WITH {_US}, {_GAP} SELECT src, dst, gap FROM g")
def gaps(spark, d):
    return info.gaps(us(spark, d))


_RUN = "ru AS (SELECT src, min(dst) AS start, count(*) AS length FROM (SELECT src, dst, dst - row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM us) GROUP BY src, k)"


@query("runs", f"WITH {_US}, {_RUN} SELECT src, start, length FROM ru")
def runs(spark, d):
    return info.runs(us(spark, d))


@query("intervals", f"WITH {_US}, {_RUN} SELECT src, start, length FROM ru WHERE length >= 4")
def intervals(spark, d):
    return info.intervals(us(spark, d))


@query("gap_runs", f"WITH {_US}, {_GAP}, x AS (SELECT src, gap, row_number() OVER (PARTITION BY src ORDER BY dst) - row_number() OVER (PARTITION BY src, gap ORDER BY dst) AS k FROM g WHERE gap IS NOT NULL) SELECT src, gap, count(*) AS length FROM x GROUP BY src, gap, k HAVING count(*) >= 3")
def gap_runs(spark, d):
    return info.gap_runs(us(spark, d))


_REF = "wo AS (SELECT a.src AS id, b.src AS ref, a.src - b.src AS d, count(*) AS overlap FROM us a JOIN us b ON a.dst = b.dst WHERE a.src - b.src BETWEEN 1 AND {w} GROUP BY ALL), best AS (SELECT id, ref, d, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, d{far}) AS k FROM wo) WHERE k = 1)"


@query("best_reference", f"WITH {_US}, {_REF.format(w=7, far='')} SELECT id, ref, d, overlap FROM best")
def best_reference(spark, d):
    return info.best_reference(us(spark, d), 7).select("id", "ref", "d", "overlap")


@query("gap_metrics", f"WITH {_US}, {_GAP}, x AS (SELECT gap FROM g WHERE gap IS NOT NULL), c AS (SELECT count(*) AS c FROM x GROUP BY least(gap, 10000)) SELECT round(avg((gap = 1)::INT), 6) AS gap1, round(avg((gap <= 4)::INT), 6) AS gap4, round(avg((gap <= 16)::INT), 6) AS gap16, round(avg(gap), 6) AS mean_gap, (SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) FROM c) AS gap_entropy FROM x")
def gap_metrics(spark, d):
    return info.gap_metrics(us(spark, d)).select(*[r6(c) for c in ("gap1", "gap4", "gap16", "mean_gap", "gap_entropy")])


@query("consecutive_metrics", f"WITH {_US}, {_DEG}, {_REF.format(w=16, far='')}, p AS (SELECT a.od AS x, b.od AS y, coalesce(overlap, 0) AS o FROM od a JOIN od b ON b.id = a.id - 1 LEFT JOIN (SELECT id, overlap FROM wo WHERE d = 1) w ON w.id = a.id) SELECT round(avg(CASE WHEN x + y - o > 0 THEN o / (x + y - o) ELSE 0 END), 6) AS mean_jaccard, round(avg(o), 6) AS mean_overlap, round((SELECT count(*) FROM best) / (SELECT count(*) FROM vs), 6) AS ref_share, round((SELECT avg(d) FROM best), 6) AS mean_distance FROM p")
def consecutive_metrics(spark, d):
    return info.consecutive_metrics(us(spark, d).kept(), 16).select(*[r6(c) for c in ("mean_jaccard", "mean_overlap", "ref_share", "mean_distance")])


@query("ordering_metrics", f"WITH {_US}, {_DEG}, {_GAP}, {_RUN}, {_REF.format(w=7, far=' DESC')}, b AS (SELECT best.overlap, best.overlap / (x.od + y.od - best.overlap) AS j FROM best JOIN od x ON x.id = best.id JOIN od y ON y.id = ref) SELECT round(avg(log2(gap + 1.0e0)), 6) AS log_gap, round(avg(abs(dst - src)), 6) AS distance, round((SELECT coalesce(sum(length), 0) FROM ru WHERE length >= 4) / count(*), 6) AS interval_share, (SELECT round(avg(overlap), 6) FROM b) AS ref_overlap, (SELECT round(avg(j), 6) FROM b) AS ref_jaccard, round((SELECT sum(overlap) FROM b) / count(*), 6) AS copy_share FROM g")
def ordering_metrics(spark, d):
    return info.ordering_metrics(us(spark, d).kept()).select(*[r6(c) for c in ("log_gap", "distance", "interval_share", "ref_overlap", "ref_jaccard", "copy_share")])


# ranking -------------------------------------------------------------------


def _unrolled(restart: str, start: str, weights: str, k: int, out: str) -> str:
    steps = [f"x0 AS ({start})"]
    for i in range(1, k + 1):
        steps.append(f"x{i} AS (SELECT r.id, 0.15e0 * r.r + 0.85e0 * coalesce(s, 0) AS score FROM r LEFT JOIN (SELECT dst AS id, sum(w * score) AS s FROM w JOIN x{i - 1} ON src = id GROUP BY dst) p USING (id))")
    return f"r AS ({restart}), w AS ({weights}), {', '.join(steps)} SELECT id, round(score, 6) AS {out} FROM x{k}"


_UNI = "SELECT id, 1.0e0 / (SELECT count(*) FROM vs) AS {} FROM vs"
_ONE = "SELECT id, CASE WHEN id = (SELECT min(id) FROM vs) THEN 1.0e0 ELSE 0.0e0 END AS {} FROM vs"
_W = "SELECT src, dst, 1.0e0 / count(*) OVER (PARTITION BY src) AS w FROM us"


@query("pagerank", f"WITH {_US}, {_unrolled(_UNI.format('r'), _UNI.format('score'), _W, 8, 'score')}")
def pagerank(spark, d):
    return ranking.pagerank(us(spark, d).kept(), epsilon=0, max_iter=8).select("id", r6("score"))


@query("ppr", f"WITH {_US}, {_unrolled(_ONE.format('r'), _ONE.format('score'), _W, 8, 'score')}")
def ppr(spark, d):
    g = us(spark, d).kept()
    return ranking.personalised(g, g.vertices.agg(F.min("id").alias("id")), epsilon=0, max_iter=8).select("id", r6("score"))


@query("wppr", f"WITH {_US}, {_unrolled(_ONE.format('r'), _ONE.format('score'), 'SELECT src, dst, (1.0e0 + (src + dst) % 5) / sum(1.0e0 + (src + dst) % 5) OVER (PARTITION BY src) AS w FROM us', 8, 'score')}")
def wppr(spark, d):
    g = us(spark, d).kept()
    w = g.edges.withColumn("w", 1.0 + (F.col("src") + F.col("dst")) % 5)
    return ranking.personalised(g, g.vertices.agg(F.min("id").alias("id")), epsilon=0, max_iter=8, weights=w).select("id", r6("score"))


@query("monte_carlo_pagerank")
def monte_carlo_pagerank(spark, d):
    return ranking.monte_carlo(us(spark, d).kept(), 4)


# traversal -----------------------------------------------------------------


@query("bfs_levels", f"WITH RECURSIVE {_US}, b AS (SELECT min(id) AS id, 0 AS level FROM vs UNION SELECT dst, level + 1 FROM b JOIN us ON src = b.id WHERE level < 12) SELECT id, min(level) AS level FROM b GROUP BY id")
def bfs_levels(spark, d):
    g = us(spark, d).kept()
    return traversal.bfs_levels(g, g.vertices.agg(F.min("id").alias("id")))


@query("weak_components", f"WITH RECURSIVE {_CS}, un AS (SELECT src, dst FROM us UNION SELECT dst, src FROM us), r AS (SELECT (SELECT min(id) FROM vs) AS id UNION SELECT dst FROM r JOIN un ON src = r.id) SELECT id, (SELECT min(id) FROM vs) AS component FROM r")
def weak_components(spark, d):
    return traversal.weak_components(cs(spark, d).kept())


@query("strong_components", f"WITH RECURSIVE {_US}, r AS (SELECT id AS a, id AS b FROM vs UNION SELECT a, dst FROM r JOIN us ON src = b) SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strong_components(spark, d):
    return traversal.strong_components(us(spark, d).kept())


@query("k_cores")
def k_cores(spark, d):
    return traversal.k_cores(us(spark, d).kept())


@query("discovered_paths")
def discovered_paths(spark, d):
    g = us(spark, d).kept()
    a, b = g.vertices.agg(F.min("id"), F.max("id")).first()
    s = ranking.path_scores(g, a, b, epsilon=0, max_iter=6)
    return traversal.greedy_paths(g, saved(s.select("id", "product"), work_dir(spark, "scores")), a, b, k=2).select("rank", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("path_queries")
def path_queries(spark, d):
    """Three path queries at once, by decayed scores."""
    from ..operators import paths

    g = us(spark, d).kept()
    a, b = g.vertices.agg(F.min("id"), F.max("id")).first()
    pairs = [(a, b), (b, a), (a, a)]
    scores = None
    for q, (s, t) in enumerate(pairs[:2]):
        x = ranking.path_scores(g, s, t, epsilon=0, max_iter=5).select(F.lit(q).cast("long").alias("query"), "id", "product")
        scores = x if scores is None else scores.unionByName(x)
    out = paths.discover(g, scores, pairs, k=3)
    return out.select("query", "rank", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query("scored_walks")
def scored_walks(spark, d):
    g = us(spark, d).kept()
    return traversal.scored_walks(g, g.vertices, g.in_degrees().select("id", F.col("in_degree").cast("double").alias("s")), 3)


@query("simulations")
def simulations(spark, d):
    from .. import simulation

    return simulation.run(simulation.sweep(spark, 8, n=40, steps=10))


@query("simulation_classes")
def simulation_classes(spark, d):
    from .. import simulation

    return simulation.classes(simulation.run(simulation.sweep(spark, 8, n=40, steps=10)))


@query("multigrid_solution")
def multigrid_solution(spark, d):
    from ..operators import multigrid

    g = nt(spark, d).kept()
    levels = multigrid.setup(multigrid.laplacian(g, 1.0), max_levels=2, min_coarse=5)
    b = g.vertices.select("id", (F.col("id") % 3).cast("double").alias("x"))
    return multigrid.v_cycle(levels, b, b.select("id", F.lit(0.0).alias("x"))).select("id", r6("x"))


@query("random_walks")
def random_walks(spark, d):
    g = us(spark, d).kept()
    return traversal.random_walks(g, g.vertices, 4, jump=0.15)


@query("metropolis_walks")
def metropolis_walks(spark, d):
    g = us(spark, d).undirected().kept()
    return traversal.random_walks(g, g.vertices, 4, kind="metropolis")


# local clustering ----------------------------------------------------------

_S = "s AS (SELECT id FROM vs WHERE id % 4 = 0)"


@query("cut_volume", f"WITH {_US}, {_S}, x AS (SELECT (SELECT count(*) FROM us WHERE src IN (SELECT id FROM s)) AS volume, (SELECT count(*) FROM us WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s)) AS cut, (SELECT count(*) FROM us) AS total) SELECT volume, cut, round(cut / least(volume, total - volume), 6) AS conductance FROM x")
def cut_volume(spark, d):
    g = us(spark, d)
    from ..operators import local

    return local.conductance(g, g.vertices.filter("id % 4 = 0")).select("volume", "cut", r6("conductance"))


@query("support_children", f"WITH {_US}, {_DEG}, {_S}, f AS (SELECT DISTINCT dst AS id FROM us WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s)), k AS (SELECT id, (SELECT count(*) FROM us WHERE src = f.id AND dst IN (SELECT id FROM s)) + (SELECT count(*) FROM us WHERE dst = f.id AND src IN (SELECT id FROM s)) AS k_in FROM f) SELECT id, k_in::BIGINT AS k_in FROM k JOIN od USING (id) WHERE k_in >= 2 OR (od > 0 AND k_in / od >= 0.4)")
def support_children(spark, d):
    g = us(spark, d).kept()
    from ..operators import local

    return local.children_by_support(g, g.vertices.filter("id % 4 = 0")).select("id", "k_in")


# orderings, communities ----------------------------------------------------


@query("order_by_degree", f"WITH {_CS}, {_DEG} SELECT id AS old_id, row_number() OVER (ORDER BY ind DESC, id) AS new_id FROM idg")
def order_by_degree(spark, d):
    return ordering.by_score(cs(spark, d), "in_degree")


@query("order_minhash", f"WITH {_CS}, h AS (SELECT src AS id, {', '.join(f'min(md5({i} || chr(58) || dst)) AS h{i}' for i in range(4))} FROM us GROUP BY src) SELECT id AS old_id, row_number() OVER (ORDER BY {', '.join(f'coalesce(h{i}, chr(0))' for i in range(4))}, id) AS new_id FROM vs LEFT JOIN h USING (id)")
def order_minhash(spark, d):
    return ordering.minhash_md5(cs(spark, d), 4)


@query("order_web_lexicographic", f"WITH {_US}, l AS (SELECT id, coalesce(list(dst ORDER BY dst) FILTER (dst IS NOT NULL), []) AS n FROM vs LEFT JOIN us ON src = id GROUP BY id) SELECT id AS old_id, row_number() OVER (ORDER BY CASE WHEN len(n) <= 3 THEN len(n) ELSE 4 END, n, len(n), id) AS new_id FROM l")
def order_web_lexicographic(spark, d):
    return ordering.web_lexicographic(us(spark, d))


@query("order_lexicographic", f"WITH {_US}, l AS (SELECT id, coalesce(list(-dst ORDER BY dst) FILTER (dst IS NOT NULL), []) AS n FROM vs LEFT JOIN us ON src = id GROUP BY id) SELECT id AS old_id, row_number() OVER (ORDER BY n, id) AS new_id FROM l")
def order_lexicographic(spark, d):
    return ordering.lexicographic(us(spark, d))


@query("order_bfs")
def order_bfs(spark, d):
    return ordering.breadth_first(us(spark, d))


@query("order_rcm")
def order_rcm(spark, d):
    return ordering.breadth_first(us(spark, d), symmetric=True, reverse=True, by_degree=True)


@query("order_label_propagation")
def order_label_propagation(spark, d):
    return ordering.label_propagation_order(us(spark, d).kept())


@query("order_bisection")
def order_bisection(spark, d):
    return ordering.recursive_bisection(us(spark, d).kept())


@query("communities_louvain")
def communities_louvain(spark, d):
    return community.louvain(us(spark, d).kept(), passes=4)


@query("communities_leiden")
def communities_leiden(spark, d):
    return community.leiden(us(spark, d).kept(), passes=4)


@query("label_propagation")
def label_propagation(spark, d):
    return community.label_propagation(us(spark, d).kept(), 3)


@query("matching")
def matching(spark, d):
    return community.matching(us(spark, d).kept())


@query("coarse_graph", f"WITH {_NT}, l AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label FROM nation) SELECT a.label AS src, b.label AS dst, count(*)::DOUBLE AS w FROM us JOIN l a ON src = a.id JOIN l b ON dst = b.id GROUP BY ALL")
def coarse_graph(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label"))
    return community.coarse(nt(spark, d).edges.withColumn("w", F.lit(1.0)), labels)


# codes and codecs ----------------------------------------------------------

_FIB = "[" + ", ".join(map(str, codes.FIBONACCI[:40])) + "]"
_LEN = "length(bin({}))"
_DELTA = "(2 * length(bin(length(bin({0})))) - 1 + length(bin({0})) - 1)"
_FIBL = f"(len(list_filter({_FIB}, lambda f: f <= {{0}})) + 1)"
_TB = "(CASE WHEN {v} < 2 * (1::BIGINT << (length(bin({n})) - 1)::INT) - {n} THEN length(bin({n})) - 1 ELSE length(bin({n})) END)"
_Z3 = "((length(bin(v)) - 1) // 3)"
_CODES = f"""SELECT v, (v + 1)::BIGINT AS unary, (2 * length(bin(v)) - 1)::BIGINT AS gamma, {_DELTA.format('v')}::BIGINT AS delta, {_FIBL.format('v')}::BIGINT AS fibonacci,
 ({_Z3} + 1 + {_TB.format(v=f'(v - (1::BIGINT << (3 * {_Z3})::INT))', n=f'(7 * (1::BIGINT << (3 * {_Z3})::INT))')})::BIGINT AS zeta3,
 (v // 64 + 1 + 6)::BIGINT AS golomb64, ((v >> 3) + 4)::BIGINT AS rice3, ({_DELTA.format('(v // 64 + 1)')} + {_FIBL.format('(v % 64 + 1)')})::BIGINT AS fed,
 (CASE WHEN v % 2 = 0 THEN v // 2 ELSE -((v + 1) // 2) END)::BIGINT AS unzigzag FROM (SELECT DISTINCT l_partkey + 1 AS v FROM lineitem)"""


@query("code_lengths", _CODES)
def code_lengths(spark, d):
    v = F.col("v")
    x = table(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("v")).distinct()
    return x.select("v", codes.length(v, "unary").alias("unary"), codes.length(v, "gamma").alias("gamma"), codes.length(v, "delta").alias("delta"), codes.length(v, "fibonacci").alias("fibonacci"), codes.length(v, "zeta", k=3).alias("zeta3"),
                    codes.length(v, "golomb", b=64).alias("golomb64"), codes.length(v, "rice", k=3).alias("rice3"), codes.length(v, "fed").alias("fed"), codes.unzigzag(v).cast("long").alias("unzigzag"))


_BPE = "u1 AS (SELECT src + 1 AS src, dst + 1 AS dst FROM us), gv AS (SELECT coalesce(dst - lag(dst) OVER (PARTITION BY src ORDER BY dst), dst) AS v FROM u1)"


@query("bits_per_edge", f"WITH {_US}, {_DEG}, {_BPE} SELECT 'gamma' AS code, round(((SELECT sum(2 * length(bin(v)) - 1) FROM gv) + (SELECT sum(2 * length(bin(od + 1)) - 1) FROM od)) / (SELECT count(*) FROM gv), 6) AS bits_per_edge UNION ALL SELECT 'delta', round(((SELECT sum({_DELTA.format('v')}) FROM gv) + (SELECT sum({_DELTA.format('(od + 1)')}) FROM od)) / (SELECT count(*) FROM gv), 6) UNION ALL SELECT 'fibonacci', round(((SELECT sum({_FIBL.format('v')}) FROM gv) + (SELECT sum({_FIBL.format('(od + 1)')}) FROM od)) / (SELECT count(*) FROM gv), 6)")
def bits_per_edge(spark, d):
    g = us(spark, d)
    g = Graph(g.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst")), g.vertices.select((F.col("id") + 1).alias("id"))).kept()
    out = None
    for c in ("gamma", "delta", "fibonacci"):
        x = codec.bits_per_edge(g, c).select("code", r6("bits_per_edge"))
        out = x if out is None else out.unionByName(x)
    return out


@query("huffman_size")
def huffman_size(spark, d):
    return codec.huffman_bits(us(spark, d))


@query("container_round_trip", f"WITH {_US} SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS nbrs FROM vs LEFT JOIN us ON src = id GROUP BY id")
def container_round_trip(spark, d):
    g = us(spark, d).kept()
    back = codec.decoded_lists(codec.encoded_chunks(g)).join(g.vertices, "id", "left_semi")
    return back.select("id", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))


def _one_based(g: Graph) -> Graph:
    return Graph(g.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst")), g.vertices.select((F.col("id") + 1).alias("id")))


# text ----------------------------------------------------------------------

_TOK = "tk AS (SELECT doc_id, x[1] AS pos, x[2] AS token FROM (SELECT doc_id, unnest(list_zip(range(len(t)), t)) AS x FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)))"
_VOC = "vc AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM (SELECT token, count(*) AS n FROM tk GROUP BY token HAVING count(*) >= 5)), ti AS (SELECT doc_id, pos, token_id FROM tk JOIN vc USING (token))"
_WIN = "wi AS (SELECT doc_id, pos, list_distinct(list(token_id) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS items FROM ti)"


@query("token_counts_by_document", f"WITH {_TOK} SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM tk GROUP BY doc_id")
def token_counts_by_document(spark, d):
    return text.token_counts(table(spark, d, "documents"))


@query("vocabulary", f"WITH {_TOK}, v AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM tk GROUP BY token HAVING count(*) >= 3) SELECT token, n, df, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM v")
def vocabulary(spark, d):
    return text.vocabulary(text.tokens(table(spark, d, "documents")), 3).select("token", "n", "df", "token_id")


@query("character_ngrams", f"WITH {_TOK}, w AS (SELECT '<' || token || '>' AS w FROM tk), g AS (SELECT unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i::INT, 3))) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def character_ngrams(spark, d):
    return text.character_ngrams(table(spark, d, "documents"), 3).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _vocab(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return t, text.lexicon(t, 5)


@query("ppmi", f"WITH {_TOK}, {_VOC}, {_WIN}, tt AS (SELECT count(*)::DOUBLE AS t FROM wi), o AS (SELECT u, count(*) AS c FROM (SELECT unnest(items) AS u FROM wi) GROUP BY u), pr AS (SELECT u, v, count(*) AS c2 FROM (SELECT u, unnest(items) AS v FROM (SELECT items, unnest(items) AS u FROM wi)) WHERE u < v GROUP BY ALL) SELECT u, v, round(w, 6) AS w FROM (SELECT pr.u, pr.v, ln((c2 / t) / ((a.c / t) * (b.c / t) + 1e-12)) AS w FROM pr JOIN o a ON a.u = pr.u JOIN o b ON b.u = pr.v, tt) WHERE w > 0")
def ppmi(spark, d):
    return text.ppmi(*_vocab(spark, d), 5).select("u", "v", r6("w"))


@query("document_graphs", f"WITH {_TOK}, {_VOC}, {_WIN} SELECT doc_id, a, b, count(*) AS w FROM (SELECT doc_id, a, unnest(items) AS b FROM (SELECT doc_id, items, unnest(items) AS a FROM wi)) WHERE a < b GROUP BY ALL")
def document_graphs(spark, d):
    return text.document_graphs(*_vocab(spark, d), 5)


@query("tfidf", f"WITH {_TOK}, {_VOC}, tf AS (SELECT doc_id, token_id, count(*) AS c FROM ti GROUP BY ALL), al AS (SELECT doc_id, sum(c) AS s FROM tf GROUP BY doc_id), tr AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM labels)), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tr), df AS (SELECT token_id, count(*) AS df FROM tr GROUP BY token_id), x AS (SELECT doc_id, token_id, c / s * (ln((n + 1.0e0) / (coalesce(df, 0) + 1.0e0)) + 1.0e0) AS w FROM tf JOIN al USING (doc_id) LEFT JOIN df USING (token_id), nd) SELECT doc_id, token_id, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS w FROM x")
def tfidf(spark, d):
    return text.tfidf(*_vocab(spark, d), table(spark, d, "labels")).select("doc_id", "token_id", r6("w"))


@query("class_weights", f"WITH {_TOK}, {_VOC}, l AS (SELECT DISTINCT doc_id, quality AS label FROM labels), pc AS (SELECT label, count(*) AS nc FROM l GROUP BY label), kk AS (SELECT count(*) AS k, sum(nc) AS n FROM pc), p AS (SELECT label, k, (nc + 1.0e0) / (n + k) AS q FROM pc, kk), c AS (SELECT token_id, label, count(*) AS c FROM (SELECT DISTINCT doc_id, token_id FROM ti) JOIN l USING (doc_id) GROUP BY ALL), f AS (SELECT t.token_id, p.label, k, q, coalesce(c, 0) AS c FROM (SELECT DISTINCT token_id FROM c) t CROSS JOIN p LEFT JOIN c ON c.token_id = t.token_id AND c.label = p.label), g AS (SELECT *, (c + 1.0e0) / (sum(c) OVER (PARTITION BY token_id) + k) AS pp FROM f), s AS (SELECT token_id, sum(pp * ln(pp / q)) AS kl FROM g GROUP BY token_id) SELECT token_id, round(0.1e0 + 0.9e0 * kl / max(kl) OVER (), 6) AS w FROM s")
def class_weights(spark, d):
    return text.class_weights_of(*_vocab(spark, d), table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))).select("token_id", r6("w"))


@query("hyperedges", f"WITH {_TOK}, {_VOC}, s AS (SELECT doc_id, x[1] AS edge, x[2] AS s FROM (SELECT doc_id, unnest(list_zip(range(len(a)), a)) AS x FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS a FROM documents))) SELECT DISTINCT doc_id, edge::INT AS edge, token_id FROM (SELECT doc_id, edge, unnest(regexp_extract_all(lower(s), '[a-z]+')) AS token FROM s) JOIN vc USING (token)")
def hyperedges(spark, d):
    return text.hyperedges(*_vocab(spark, d))


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return tables.page_links(table(spark, d, "pages"))


# propagation ---------------------------------------------------------------


def _appnp(k: int) -> str:
    a = "a AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0e0 AS w FROM us UNION ALL SELECT id, id, 1.0e0 FROM vs) GROUP BY ALL), rs AS (SELECT src AS id, sum(w) AS d FROM a GROUP BY src), an AS (SELECT src AS i, dst AS j, w / sqrt(x.d * y.d) AS w FROM a JOIN rs x ON src = x.id JOIN rs y ON dst = y.id), b AS (SELECT id, (id % 3)::DOUBLE AS b FROM vs), x0 AS (SELECT id, b AS x FROM b)"
    steps = [f"x{i} AS (SELECT b.id, 0.15e0 * b + 0.85e0 * coalesce(s, 0) AS x FROM b LEFT JOIN (SELECT i AS id, sum(w * x) AS s FROM an JOIN x{i - 1} ON j = id GROUP BY i) p USING (id))" for i in range(1, k + 1)]
    return f"WITH {_NT}, {a}, {', '.join(steps)} SELECT id, round(x, 6) AS x FROM x{k}"


@query("appnp", _appnp(5))
def appnp(spark, d):
    g = nt(spark, d).kept()
    return propagate.appnp(g, g.vertices.select("id", (F.col("id") % 3).cast("double").alias("x")), 5).select("id", r6("x"))


@query("degree_features", f"WITH {_US}, {_DEG} SELECT id, round(ln(1 + ind), 6) AS log_in, round(ln(1 + od), 6) AS log_out, round(CASE WHEN ind + od > 0 THEN ind / (ind + od) ELSE 0 END, 6) AS in_share FROM idg JOIN od USING (id)")
def degree_features(spark, d):
    return propagate.degree_features(us(spark, d)).select("id", r6("log_in"), r6("log_out"), r6("in_share"))


@query("vector_centroids", "SELECT label, (i - 1)::INT AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def vector_centroids(spark, d):
    return propagate.centroids(table(spark, d, "embeddings")).select("label", "dim", r6("mean"))


# reaction networks ---------------------------------------------------------


@query("formula_atoms", "SELECT * FROM (VALUES ('C6H12O6', 'C', 6), ('C6H12O6', 'H', 12), ('C6H12O6', 'O', 6), ('NaCl', 'Na', 1), ('NaCl', 'Cl', 1), ('H2O', 'H', 2), ('H2O', 'O', 1)) t(formula, element, n)")
def formula_atoms(spark, d):
    x = spark.createDataFrame([("C6H12O6",), ("NaCl",), ("H2O",)], "formula string")
    return x.select("formula", F.explode(metabolic.parsed_formula(F.col("formula"))).alias("element", "n"))


@query("atom_similarity", "SELECT * FROM (VALUES ('C6H12O6', 'C3H6O3', 0.5e0), ('C2H6O', 'C2H4O2', 0.75e0)) t(a, b, s)")
def atom_similarity(spark, d):
    x = spark.createDataFrame([("C6H12O6", "C3H6O3"), ("C2H6O", "C2H4O2")], "a string, b string")
    return x.select("a", "b", metabolic.atom_similarity(metabolic.parsed_formula(F.col("a")), metabolic.parsed_formula(F.col("b"))).alias("s"))


# generators, streams -------------------------------------------------------


@query("generated_ring", "SELECT i AS src, i % 100 + 1 AS dst FROM range(1, 101) t(i)")
def generated_ring(spark, d):
    return generators.ring(spark, 100).edges


@query("generated_small_world")
def generated_small_world(spark, d):
    return generators.watts_strogatz(spark, 300, 6, 0.1).edges


@query("generated_random")
def generated_random(spark, d):
    return generators.erdos_renyi(spark, 300, 0.02).edges


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    x = ingest.windowed_counts(table(spark, d, "events"))
    return x.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return top_suppliers(spark, d)
