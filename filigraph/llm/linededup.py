"""Line de-duplication over levelled sorted runs of line hashes.

Documents pass in batches of ascending id.  ``Runs`` keeps what earlier batches
held: sorted runs of 128-bit line hashes, each bucketed by hash and sorted within
its buckets.  A new batch merge-anti-joins every run, then adds the hashes it
brought as a run of level 0; ``fanout`` runs of one level are compacted into one
of the next.  A line goes when its key is in a run (an earlier, smaller document
holds it), or when a smaller document of the same batch holds it.

The keys of all texts are written once, split by batch, so texts are read twice
in all, whatever the number of batches.  Lines of keys with many occurrences are
joined by a bounded broadcast, all others by shuffle, after pre-aggregation.

Edge cases: a null or empty text is one empty line; a null id counts as one
document that sorts last; rows that repeat an id are one document; an empty
table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WHITE_BYTES, arrow_fn, heavy_split_join, packed, released, saved, small_batches, unpacked, work_dir


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lowered."""
    return [x.strip(WHITE_BYTES) for x in (text or "").encode().lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


class Runs:
    """Levelled sorted runs of line hashes in the shared folder.

    Runs are bucketed tables over external files, so that anti-joining a batch
    moves the batch alone.  The list of runs is the driver's; every run is
    complete on disk before it is listed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = 4):
        self.spark, self.folder, self.buckets, self.fanout, self.made = spark, folder, buckets, fanout, 0
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"run_{self.folder.rsplit('-', 1)[-1]}_{self.made}"
        self.made += 1
        (df.repartition(self.buckets, "h1").write.mode("overwrite").bucketBy(self.buckets, "h1").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti-join a run, on one shuffle of the batch."""
        keys = keys.repartition(self.buckets, "h1")
        for r in self.runs():
            keys = keys.join(self.spark.table(r).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        self._write(keys.select("h1", "h2"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for r in old[1:]:
                merged = merged.unionByName(self.spark.table(r))
            self._write(merged, level + 1)
            for r in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            level += 1

    def close(self) -> None:
        for r in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")


def _keys_of(docs: DataFrame, id_: str, text: str, least: int, cuts: list[int]) -> DataFrame:
    """(b, h1, h2, doc) for each distinct long key of each document."""
    edges = np.array(cuts, np.int64)

    def keys(batches):
        import xxhash

        for b in batches:
            ids, hs = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                own = {xxhash.xxh3_128_digest(k) for k in line_keys(t) if _long_enough(k, least)}
                ids.append(np.full(len(own), NO_ID if i is None else i, np.int64))
                hs.extend(own)
            if hs:
                h = np.frombuffer(b"".join(hs), np.int64).reshape(-1, 2)
                doc = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, doc, "left").astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc)], ["b", "h1", "h2", "doc"])

    return docs.select(F.col(id_).cast("long"), F.col(text)).mapInArrow(released(keys), "b int, h1 long, h2 long, doc long")


def drops(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 10, batches: int = 6, fanout: int = 3) -> DataFrame:
    """(doc, gone): for each document that loses lines, the hashes of the keys it loses."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "lines")
    ids = docs.select(F.col(id_).cast("long").alias("d")).filter("d is not null")
    cuts = sorted({int(x) for x in ids.approxQuantile("d", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    lines = f"{folder}/keys"
    _keys_of(docs, id_, text, least, cuts).write.partitionBy("b").parquet(lines)
    schema = "h1 long, h2 long, doc long, b int"
    runs = Runs(spark, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    out = []
    present = sorted(r.b for r in spark.read.schema(schema).parquet(lines).select("b").distinct().collect())
    for b in present:
        batch = spark.read.schema(schema).parquet(lines).filter(F.col("b") == b).select("h1", "h2", "doc")
        keys = batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
        keys = saved(keys, f"{folder}/batch{b}")
        total = batch.count()
        if runs.runs():
            new = saved(runs.unseen(keys), f"{folder}/new{b}")
            old = keys.join(new.select("h1", "h2"), ["h1", "h2"], "left_anti").withColumn("owner", F.lit(None).cast("long"))
            shared = new.filter("owner < last").unionByName(old)
        else:
            new, shared = keys, keys.filter("owner < last")
        lost = heavy_split_join(batch, shared.select("h1", "h2", "owner", "n"), ["h1", "h2"], "n", total, keys)
        out.append(saved(lost.filter("owner is null or doc > owner").select("doc", "h1", "h2"), f"{folder}/lost{b}"))
        if b != present[-1]:
            runs.add(new)
    runs.close()
    if not out:
        return spark.createDataFrame([], "doc long, gone array<struct<h1:long,h2:long>>")
    lost = out[0]
    for x in out[1:]:
        lost = lost.unionByName(x)
    return lost.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))


def rewritten(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 10, **how) -> DataFrame:
    """All columns of ``docs``, and ``new_text``, ``n_lines``, ``n_dropped``, ``kept_sha256``."""
    gone = drops(docs, id_, text, least, **how)
    need = {"_text": text, "_id": id_}
    left = packed(docs, **need).withColumn("_doc", F.coalesce(F.col("_id").cast("long"), F.lit(NO_ID)))
    left = left.join(gone.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")

    def keep(t: pa.Array, g: pa.Array) -> pa.Array:
        import xxhash

        texts, n, lost, sha = [], [], [], []
        for x, h in zip(t.to_pylist(), g.to_pylist()):
            lines = (x or "").split("\n")
            kept = lines
            if h:
                dead = {np.array([y["h1"], y["h2"]], np.int64).tobytes() for y in h}
                kept = [y for y, k in zip(lines, line_keys(x)) if not (_long_enough(k, least) and xxhash.xxh3_128_digest(k) in dead)]
            new = "\n".join(kept)
            texts.append(new), n.append(len(lines)), lost.append(len(lines) - len(kept)), sha.append(hashlib.sha256(new.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], ["new_text", "n_lines", "n_dropped", "kept_sha256"])

    out = left.withColumn("_k", arrow_fn(keep, "new_text string, n_lines long, n_dropped long, kept_sha256 string")(F.col("_text"), F.col("gone")))
    return unpacked(out, docs.columns, need, **{c: F.col(f"_k.{c}") for c in ("new_text", "n_lines", "n_dropped", "kept_sha256")})


def filtered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without the lines they share with a smaller one; documents left without any text go."""
    need = {"doc_id": "doc_id", "text": "text"}
    out = rewritten(packed(docs, **need))
    out = out.filter((F.col("n_dropped") == 0) | (F.length(F.trim("new_text")) > 0))
    new = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("new_text"))
    return unpacked(out, docs.columns, need, text=new, **({"n_chars": F.length(new).cast("long")} if "n_chars" in docs.columns else {}))
