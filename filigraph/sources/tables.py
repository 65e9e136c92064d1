"""Readers and writers of graph and corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): lines with an order-preserving position."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def edge_list(spark: SparkSession, path: str, separator: str = ",", header: bool = False) -> tuple[Graph, DataFrame]:
    """An edge-list text and the map (raw, id): ids 1..n by first appearance, source before target.

    Comments (#), blank lines and lines of fewer than two fields are skipped.
    """
    lines = _lines(spark, path)
    if header:
        lines = lines.filter(F.col("pos") != 0)
    parts = lines.withColumn("p", F.split(F.trim("value"), rf"\Q{separator}\E")).filter((F.size("p") >= 2) & ~F.trim("value").startswith("#"))
    raw = parts.select("pos", F.trim(F.col("p")[0]).cast("decimal(20,0)").alias("a"), F.trim(F.col("p")[1]).cast("decimal(20,0)").alias("b")).filter("a is not null and b is not null")
    seen = raw.select(F.explode(F.array(F.struct(F.col("a").alias("raw"), (F.col("pos") * 2).alias("at")), F.struct(F.col("b").alias("raw"), (F.col("pos") * 2 + 1).alias("at")))).alias("x")).select("x.*")
    ids = numbered(seen.groupBy("raw").agg(F.min("at").alias("at")), [F.col("at")], "id").select("raw", "id")
    e = raw.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b").select("src", "dst")
    return Graph.of(e, ids.select("id")), ids


def pajek(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A Pajek file's ``*vertices`` and ``*arcs`` and (id, label); ids number the vertices as listed. Lower-cased; % comments."""
    lines = _lines(spark, path).select("pos", F.lower(F.trim("value")).alias("v")).filter("v <> '' and not startswith(v, '%')")
    heads = lines.filter(F.col("v").startswith("*")).select("pos", F.regexp_extract("v", r"^\*(\w+)", 1).alias("section"))
    marks = heads.orderBy("pos").collect()  # one row a section
    section = F.lit(None).cast("string")
    for h in marks:
        section = F.when(F.col("pos") > h.pos, h.section).otherwise(section)
    body = lines.filter(~F.col("v").startswith("*")).withColumn("section", section)
    vs = body.filter("section = 'vertices'").select("pos", F.regexp_extract("v", r"^(\S+)", 1).alias("key"), F.regexp_extract("v", r'"([^"]*)"', 1).alias("label"))
    ids = numbered(vs, [F.col("pos")], "id").select("id", "key", "label")
    arcs = body.filter("section = 'arcs'").select(F.split("v", r"\s+").alias("p")).filter(F.size("p") >= 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    e = arcs.join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b")
    return Graph.of(e, ids.select("id")), ids.select("id", "label")


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, c) of lines like ``(1,2,3)``."""
    r = r"^\(?\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)?$"
    x = spark.read.text(path).select(*[F.regexp_extract(F.trim("value"), r, i).alias(n) for i, n in enumerate("abc", 1)])
    return x.filter("a <> ''").select(*[F.col(c).cast("long") for c in "abc"])


def page_links(pages: DataFrame, html: str = "html", id_: str = "page_id") -> DataFrame:
    """(page_id, href) of every link."""
    return pages.select(F.col(id_).alias("page_id"), F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


def blog_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(blogger_id, gender, age, industry, sign, post, text) from files ``id.gender.age.industry.sign.xml``."""
    f = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    p = F.split("name", r"\.")
    f = f.filter(F.size(p) >= 6).select(p[0].alias("blogger_id"), p[1].alias("gender"), p[2].try_cast("int").alias("age"), p[3].alias("industry"), p[4].alias("sign"), F.regexp_replace("value", "[﻿\r]", "").alias("value"))
    posts = F.regexp_extract_all("value", F.lit(r"(?s)<post>(.*?)</post>"), F.lit(1))
    return f.select("blogger_id", "gender", "age", "industry", "sign", F.posexplode(posts).alias("post", "text"))


def split_corpus(spark: SparkSession, index: str, texts: str) -> DataFrame:
    """(doc_id, split, label, label_id, text) of two parallel files: id, split, label by tab; one text a line."""
    a = numbered(_lines(spark, index).filter("value <> ''"), [F.col("pos")], "line").select("line", F.split("value", "\t").alias("p"))
    b = numbered(_lines(spark, texts), [F.col("pos")], "line").select("line", F.col("value").alias("text"))
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"{na} index lines but {nb} texts")
    x = a.join(b, "line").select(F.col("p")[0].alias("doc_id"), F.when(F.col("p")[1].contains("train"), "train").otherwise("test").alias("split"), F.col("p")[2].alias("label"), "text")
    labels = x.select("label").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("label")))
    return x.join(F.broadcast(labels), "label")


def word_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(word, vector) of lines ``word x1 .. xd``; lines of another width are skipped."""
    p = spark.read.text(path).select(F.split("value", " ").alias("p")).filter(F.size("p") == width + 1)
    return p.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, width), lambda x: x.cast("float")).alias("vector"))


def metabolic_models(spark: SparkSession, path: str) -> DataFrame:
    """Models in JSON: metabolites and reactions with their coefficients as maps."""
    schema = "metabolites array<struct<id:string,name:string,compartment:string,formula:string>>, reactions array<struct<id:string,lower_bound:double,upper_bound:double,metabolites:map<string,double>>>"
    return spark.read.schema(schema).json(path, multiLine=True)


def transition_scores(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of a tab-separated file with a header; rows that do not parse are dropped."""
    x = spark.read.csv(path, sep="\t", header=True).toDF("src", "dst", "w")
    return x.select("src", "dst", F.col("w").try_cast("double").alias("w")).filter("w is not null and src is not null and dst is not null")


def write_graph(g: Graph, path: str) -> None:
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices"), directed)


def write_edge_csv(edges: DataFrame, path: str, separator: str = ",") -> None:
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).write.mode("overwrite").csv(path, sep=separator, header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def tuples(spark: SparkSession, path: str, members: int, width: int = 4) -> DataFrame:
    """(m1 .. mk) of binary files of big-endian tuples; a cut-off last tuple raises."""
    import pandas as pd

    names = [f"m{i}" for i in range(1, members + 1)]

    def read(batches):
        import numpy as np

        for pdf in batches:
            for data in pdf["content"]:
                if len(data) % (members * width):
                    raise ValueError("a file of cut-off tuples")
                x = np.frombuffer(data, f">u{width}").reshape(-1, members).astype(np.int64)
                yield pd.DataFrame(x, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"{n} long" for n in names))


def write_metabolic(metabolites: DataFrame, edges: DataFrame, path: str) -> None:
    """Edges as ``source,target`` and ``metabolites(id, bigg_id, name)``, commas in names as semicolons, in two folders."""
    write_edge_csv(edges, f"{path}_edges")
    names = metabolites.select("id", "bigg_id", F.regexp_replace("name", ",", ";").alias("name"))
    names.write.mode("overwrite").csv(f"{path}_metabolites", header=True)


def save_state(path: str, epoch: int, accuracy: float, loss: float, **arrays) -> None:
    """Arrays and progress of a training run, in one file that replaces the last in one step."""
    import os
    import uuid

    import numpy as np

    part = f"{path}.{uuid.uuid4().hex}.npz"
    np.savez(part, epoch=epoch, accuracy=accuracy, loss=loss, **arrays)
    os.replace(part, path)


def load_state(path: str) -> dict:
    import numpy as np

    with np.load(path) as z:
        return {k: z[k] if z[k].ndim else z[k].item() for k in z.files}
