"""Near-duplicates by MinHash banding with sequential Bayesian verification.

1. One pass over the texts gives each document's number of distinct shingles, a
   128-bit digest of the set, and its MinHash signature.
2. Documents of equal sets form classes; only the smallest id of each goes on.
3. Bands of signature rows make buckets.  Each member of a bucket is a candidate
   of its bucket's smallest id, which keeps candidates linear in the bands.
4. Each document is tested against the leader it shares most bands with:
   signatures are compared batch by batch and a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below
   ``miss``; survivors are verified on the full sets.
5. Candidate groups that these links leave in several parts are finished exactly:
   in blocks of at most ``block`` documents, every pair that shares a band and is
   not yet connected passes the same test.  Links stay below the number of members.
6. The links' connected components give each document its component.

With 32 bands of 6 rows a pair of similarity 0.85 shares no band with probability
below 3e-7; ``miss`` is 1e-7.  The pipeline's stage links from 0.8 on, where that
probability is 6e-5 at the threshold itself.

Edge cases: a text of fewer words than a shingle has one shingle, its whole word
sequence; null, empty or blank texts have none and are linked with nothing; rows
with a null id are linked with nothing and kept; rows that repeat an id share
its component; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_split_join, mixed, packed, released, saved, small_batches, unpacked, word_hashes, words, work_dir
from .components import components

BANDS, ROWS = 32, 6
IDS = 500_000  # ids that may be broadcast (8 bytes each)
_R = np.random.default_rng(20240)
_A = (_R.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _R.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_C = _R.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    flat, at = words(column)
    h = word_hashes(flat)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        s = np.zeros(n, np.uint64)
        for j in range(size):
            s += mixed(h[j : j + n] + _C[j]) * _C[size + j]
        s = mixed(s)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(s[a : b - size + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = mixed((x * _C[11] + w)[None])[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 4096):
        out = np.minimum(out, (h[k : k + 4096, None] * _A + _B).min(0))
    return out


def least_matches(threshold: float, miss: float, most: int = BANDS * ROWS, step: int = 32) -> list[tuple[int, int]]:
    """(compared, fewest matches to go on) after each batch, from a uniform prior on the similarity."""
    out = []
    for n in range(step, most + 1, step):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices may still reach the threshold; later batches see survivors only."""
    live, matches, last = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in needed:
        matches = matches + (a[live, last:n] == b[live, last:n]).sum(1)
        ok = matches >= m
        live, matches, last = live[ok], matches[ok], n
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (both - inter)


def _features(docs: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    def run(batches):
        import xxhash

        for b in batches:
            sets = shingle_sets(b.column(1), size)
            sig = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, BANDS * ROWS), np.uint32)
            with np.errstate(over="ignore"):
                parts = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
                bands = mixed((mixed(parts + _C[:ROWS]) * _C[ROWS : 2 * ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C[40])
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))],
                ["doc", "n", "d1", "d2", "sig", "bands"])

    return docs.select(F.col(id_).cast("long"), F.col(text)).mapInArrow(released(run), "doc long, n long, d1 long, d2 long, sig binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_: str, text: str, size: int, rows: int) -> DataFrame:
    """(doc, set) of the wanted documents."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), size)], pa.binary())], ["doc", "set"])

    own = docs.select(F.col(id_).cast("long").alias("doc"), F.col(text).alias("t"))
    own = own.join(F.broadcast(wanted) if rows <= IDS else wanted, "doc", "left_semi")
    return own.mapInArrow(released(run), "doc long, set binary").dropDuplicates(["doc"])


def _with(pairs: DataFrame, side: DataFrame, what: str, total: int, folder: str) -> DataFrame:
    """Adds a column of both documents to (lead, doc): a document has one leader, but some may lead very many."""
    of = lambda key: side.select(F.col("doc").alias(key), F.col(what).alias(f"{key}_{what}"))
    counts = saved(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("_n")), folder)
    out = heavy_split_join(pairs, counts.join(of("lead"), "lead"), ["lead"], "_n", total, counts).drop("_n")
    return out.join(of("doc"), "doc").select("lead", "doc", f"lead_{what}", f"doc_{what}")


def _in_block(rows: list[dict], needed: list, percent: int) -> list[tuple[int, int]]:
    """Spanning links of one block: pairs sharing a band, not yet connected, surviving, verified."""
    n = len(rows)
    sig = np.stack([np.frombuffer(r["sig"], np.uint32) for r in rows])
    bands = np.array([r["bands"] for r in rows], np.int64)
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    part = np.unique(np.array([r["comp"] for r in rows], np.int64), return_inverse=True)[1]
    links, tested = [], set()
    for j in range(bands.shape[1]):
        order = np.argsort(bands[:, j], kind="stable")
        cut = np.flatnonzero(np.diff(bands[order, j])) + 1
        for bucket in np.split(order, cut):
            if len(bucket) < 2 or (part[bucket] == part[bucket[0]]).all():
                continue
            for k in range(1, len(bucket)):
                i = bucket[k]
                others = bucket[:k]
                others = others[part[others] != part[i]]
                if not len(others):
                    continue
                others = others[survives(sig[others], np.broadcast_to(sig[i], (len(others), sig.shape[1])), needed)]
                for o in others.tolist():
                    if part[o] == part[i] or (o, int(i)) in tested or (int(i), o) in tested:
                        continue
                    if linked(sets[o], sets[i], percent):
                        links.append((rows[o]["doc"], rows[i]["doc"]))
                        part[part == part[o]] = part[i]
                    else:
                        tested.add((o, int(i)))
    return links


def duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, miss: float = 1e-7, block: int = 2048) -> DataFrame:
    """(doc, n_shingles, component): one row per distinct non-null id."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "neardup")
    needed = least_matches(percent / 100, miss)
    feats = saved(_features(docs, id_, text, size), f"{folder}/features")
    own = feats.filter("doc is not null and n > 0")

    # classes of equal sets
    classes = saved(own.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("k")), f"{folder}/classes")
    member = heavy_split_join(own.select("doc", "d1", "d2"), classes, ["d1", "d2"], "k", own.count(), classes).select("doc", "rep")
    reps = own.join(classes.select("d1", "d2", F.col("rep").alias("doc")), ["d1", "d2", "doc"], "left_semi").dropDuplicates(["doc"])
    buckets = reps.select("doc", F.explode("bands").alias("band"))
    keys = saved(buckets.groupBy("band").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("k")).filter("k > 1"), f"{folder}/buckets")
    total = max(1, classes.count() * BANDS)
    stars = heavy_split_join(buckets, keys, ["band"], "k", total, keys).filter("lead < doc").groupBy("lead", "doc").agg(F.count(F.lit(1)).alias("shared"))
    stars = saved(stars, f"{folder}/stars")
    n_stars = stars.count()
    roots = None
    if n_stars:
        # each document against the leader it shares most bands with
        best = stars.groupBy("doc").agg(F.max(F.struct("shared", (-F.col("lead")).alias("l"))).alias("x")).select("doc", (-F.col("x.l")).alias("lead"))
        best = saved(best, f"{folder}/best")
        n_best = best.count()

        def bayes(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in (b.column(2), b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["lead", "doc"]).filter(pa.array(survives(x, y, needed)))

        alive = saved(_with(best, feats, "sig", n_best, f"{folder}/led").mapInArrow(released(bayes), "lead long, doc long"), f"{folder}/alive")
        ids = stars.select("doc").unionByName(stars.select(F.col("lead").alias("doc"))).distinct()
        sets = saved(_sets(docs, ids, id_, text, size, 2 * n_stars), f"{folder}/sets")

        def verify(batches):
            for b in batches:
                ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        links = saved(_with(alive, sets, "set", n_best, f"{folder}/alive_led").mapInArrow(released(verify), "a long, b long"), f"{folder}/links")
        roots = components(links, f"{folder}/c1")

        # candidate groups in several parts
        groups = components(stars.select(F.col("lead").alias("a"), F.col("doc").alias("b")), f"{folder}/c0")
        placed = groups.withColumnRenamed("v", "doc").join(roots.select(F.col("v").alias("doc"), F.col("root").alias("comp")), "doc", "left")
        placed = saved(placed.withColumn("comp", F.coalesce("comp", "doc")), f"{folder}/placed")
        open_ = placed.groupBy("root").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k")).filter("x < y and k > 2").select("root", "k")
        open_ = saved(open_, f"{folder}/open")
        rest = saved(heavy_split_join(placed, open_, ["root"], "k", n_best, open_).select("doc", "root", "comp", F.ceil(F.col("k") / block).cast("int").alias("blocks")), f"{folder}/rest")
        if rest.limit(1).count():
            def finish(batches):
                key, rows = None, []
                for b in batches:
                    for r in b.to_pylist():
                        k = r["root"], r["i"], r["j"]
                        if k != key and rows:
                            yield from _batch(_in_block(rows, needed, percent))
                            rows = []
                        key = k
                        rows.append(r)
                if rows:
                    yield from _batch(_in_block(rows, needed, percent))

            mine = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
            cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
            dealt = rest.withColumn("own", mine).join(feats.select("doc", "sig", "bands").dropDuplicates(["doc"]), "doc").join(sets, "doc")
            dealt = dealt.select("root", "doc", "comp", "sig", "bands", "set", F.explode(cells).alias("c")).select("root", "c.i", "c.j", "doc", "comp", "sig", "bands", "set")
            more = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "doc").mapInArrow(released(finish), "a long, b long")
            more = saved(more, f"{folder}/more")
            if more.limit(1).count():
                roots = components(roots.select(F.col("root").alias("a"), F.col("v").alias("b")).unionByName(more), f"{folder}/c2")
    out = member
    if roots is not None:
        size_of = roots.groupBy("v").agg(F.first("root").alias("root"))
        out = member.join(size_of.withColumnRenamed("v", "rep"), "rep", "left")
        out = out.withColumn("component", F.coalesce("root", "rep"))
    else:
        out = out.withColumn("component", F.col("rep"))
    out = out.groupBy("doc").agg(F.min("component").alias("component"))
    counts = feats.filter("doc is not null").groupBy("doc").agg(F.max("n").alias("n_shingles"))
    return saved(counts.join(out, "doc", "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component")), f"{folder}/out")


def _batch(links: list[tuple[int, int]]):
    if links:
        a = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def marked(docs: DataFrame, id_: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns of ``docs``, and component_id, kept, n_shingles."""
    found = duplicates(docs, id_, text, **how).select(F.col("doc").alias("_doc"), "component", "n_shingles")
    need = {"_id": id_}
    out = packed(docs, **need).join(found.hint("shuffle_hash"), F.col("_id").cast("long") == F.col("_doc"), "left")
    kept = F.coalesce(F.col("_id").cast("long") == F.col("component"), F.lit(True))
    return unpacked(out, docs.columns, need, component_id=F.col("component"), kept=kept, n_shingles=F.coalesce("n_shingles", F.lit(0).cast("long")))


def digests(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    found = duplicates(docs, id_, text)
    out = docs.select(F.col(id_)).join(found.withColumnRenamed("doc", id_), id_, "left")
    return out.select(id_, F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col(id_) == F.col("component"), F.lit(True)).alias("kept"))


def filtered(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """Pipeline stage: one document of each component, the one of smallest id. Links from ``percent`` on."""
    need = {"doc_id": "doc_id", "text": "text"}
    return unpacked(marked(packed(docs, **need), percent=percent).filter("kept"), docs.columns, need)
