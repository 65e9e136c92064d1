"""Graphs as tables: ``edges(src, dst)``, distinct, and ``vertices(id)``, which may be isolated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import saved, work_dir


@dataclass(frozen=True)
class Graph:
    """A directed graph (or an undirected one, whose edge table is symmetric)."""

    edges: DataFrame
    vertices: DataFrame
    directed: bool = True

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, src: str = "src", dst: str = "dst") -> Graph:
        """From any table of pairs: nulls dropped, duplicates merged; symmetric closure where undirected."""
        e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src is not null and dst is not null")
        if not directed:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        e = e.distinct()
        v = vertices.select(F.col(vertices.columns[0]).cast("long").alias("id")) if vertices is not None else e.select(F.explode(F.array("src", "dst")).alias("id"))
        return Graph(e, v.distinct(), directed)

    def reverse(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.vertices, self.directed)

    def undirected(self) -> Graph:
        return Graph.of(self.edges, self.vertices, directed=False)

    def kept(self, name: str = "graph") -> Graph:
        """The same graph, written to the shared work folder and read back: for iterations."""
        folder = work_dir(self.edges.sparkSession, name)
        return Graph(saved(self.edges, f"{folder}/edges"), saved(self.vertices, f"{folder}/vertices"), self.directed)

    def out_degrees(self) -> DataFrame:
        """(id, out_degree), zeros included."""
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst", "in_degree")

    def _degrees(self, end: str, name: str) -> DataFrame:
        d = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices.join(d, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def neighbour_lists(self) -> DataFrame:
        """(id, nbrs) with ascending neighbours; empty lists for sinks."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        return self.vertices.join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))

    def relabelled(self, mapping: DataFrame) -> Graph:
        """Ids replaced by ``mapping(old_id, new_id)``."""
        a, b = (mapping.select(F.col("old_id").alias(c), F.col("new_id").alias(f"n_{c}")) for c in ("src", "dst"))
        e = self.edges.join(a, "src").join(b, "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))
        return Graph(e, mapping.select(F.col("new_id").alias("id")), self.directed)

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph of ``ids(id)``; ids are kept."""
        own = self.vertices.join(ids.select("id").distinct(), "id", "left_semi")
        a = own.select(F.col("id").alias("src"))
        b = own.select(F.col("id").alias("dst"))
        return Graph(self.edges.join(a, "src", "left_semi").join(b, "dst", "left_semi"), own, self.directed)

    def induced_renumbered(self, ids: DataFrame) -> tuple[Graph, DataFrame]:
        """The induced subgraph with ids 1..k in ascending order of the old, and the mapping (old_id, new_id)."""
        g = self.induced(ids)
        mapping = numbered(g.vertices, [F.col("id")], "new_id").select(F.col("id").alias("old_id"), "new_id")
        return g.relabelled(mapping), mapping


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Adds row numbers in a total order without a single-task window.

    Rows are range-partitioned and sorted; each partition's count gives the next
    one's offset (one small row a partition).
    """
    spark = df.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    kept = saved(ranged, work_dir(spark, "numbered"))
    counts = sorted((r["_p"], r["n"]) for r in kept.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    at, rows = start - 1, []
    for p, n in counts:
        rows.append((p, at))
        at += n
    offsets = spark.createDataFrame(rows, "_p int, _at long")
    w = Window.partitionBy("_p").orderBy(*keys)
    return kept.join(F.broadcast(offsets), "_p").withColumn(name, F.row_number().over(w).cast("long") + F.col("_at")).drop(*keys, "_p", "_at")


def successions(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Distinct (src, dst), src <> dst, of keys that follow one another in the order of (ts, tie).

    The order is global, yet no task sees the whole table: ``lead`` runs within
    days, and each day's last row takes the first row of the next day present.
    """
    day = events.select(F.to_date(ts).alias("day"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(key).alias("k"))
    w = Window.partitionBy("day").orderBy("ts", "tie")
    inner = day.withColumn("nx", F.lead("k").over(w)).withColumn("last", F.lead("tie").over(w).isNull())
    firsts = day.groupBy("day").agg(F.min_by("k", F.struct("ts", "tie")).alias("first"))
    nexts = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("first"))  # one row a day
    out = inner.join(F.broadcast(nexts), "day", "left").select(F.col("k").alias("src"), F.when(F.col("last"), F.col("first")).otherwise(F.col("nx")).alias("dst"))
    return out.filter("dst is not null and src <> dst").distinct()
