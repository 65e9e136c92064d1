"""Language identification by Bayesian evidence fusion.

For each text: log-likelihoods of its byte trigrams under one multinomial model
per language (and one uniform model for unknown languages), tempered to an
effective number of trigrams; the likelihood of the declared markup language
under each true language, from a confusion table counted over all rows; and a
prior per host, smoothed towards its address suffix, which is smoothed towards
the whole corpus.  Confusion table and priors come from one grouped aggregation
of the text posteriors of all rows.

Only the trigram models are fitted on a bounded sample: about ``per_language``
labelled rows of each language, those with the smallest hashes of id and text.
The label may be the declaration itself, which is evidence too.  So that no row's
declaration also speaks through the text model, the sample is cut in ``folds`` by
another hash, and a row is scored by the model of the other folds.

Edge cases: a null or empty text, or one without letters, has no text evidence:
the prior and the declaration decide, and ``kept`` is false.  A null host, suffix
or declaration is neutral.  Without any labelled row all languages are null and
nothing is kept.  Repeated rows are judged alike.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_fn, packed, released, saved, small_batches, text_buffer, unpacked, work_dir

BUCKETS = 1 << 14
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams that hold a letter, and the offsets of each text's."""
    raw, at = text_buffer(column)
    b = _LOWER[raw]
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    x = b.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int32)
    letter = b != 32
    good = letter[:-2] | letter[1:-1] | letter[2:]
    for end in at[1:-1]:  # no trigram spans two texts
        good[max(0, end - 2) : end] = False
    before = np.concatenate([[0], np.cumsum(good, dtype=np.int64)])
    return h[good], before[np.minimum(at, len(good))]


def _fold(id_: str, text: str, folds: int) -> Column:
    """The fold of a row: not a function of the hash that samples."""
    return F.pmod(F.hash(F.lit(folds), F.col(id_).cast("string"), F.col(text)), F.lit(folds)) if folds > 1 else F.lit(0)


def fit(docs: DataFrame, text: str, label: str, id_: str, per_language: int = 1500, folds: int = 1) -> dict:
    """Trigram models: ``{"langs": [...], "ll": float32[folds, BUCKETS, L + 1]}``; the last column is the unknown language.

    With several folds, the k-th model is fitted on the rows of all folds but the k-th.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # every label: the model has a column for each
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "ll": np.zeros((folds, BUCKETS, 1), np.float32)}
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "_k string, _share double")
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(id_).cast("string"), F.col(text)), 11).cast("double") / float(1 << 53))
    sample = known.join(F.broadcast(rates), F.col(label) == F.col("_k")).filter(unit < F.col("_share"))
    sample = sample.select(F.col(label).alias("l"), F.col(text).alias("t"), _fold(id_, text, folds).alias("f"))
    sample = sample.limit(4 * per_language * len(langs)).repartition(4)  # a bound for tables made up of copies of one row

    def count(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            h, at = _trigrams(b.column(1))
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if key not in total:
                    total[key] = np.zeros(BUCKETS)
                total[key] += np.bincount(h[at[k] : at[k + 1]], minlength=BUCKETS)
        for (name, f), c in total.items():
            yield pa.RecordBatch.from_pydict({"l": [name], "f": pa.array([f], pa.int32()), "c": pa.array([c.tobytes()], pa.binary())})

    counts = {(k, f): np.zeros(BUCKETS) for k in langs for f in range(folds)}
    for r in sample.mapInArrow(released(count), "l string, f int, c binary").collect():
        counts[r.l, r.f] += np.frombuffer(r.c)
    ll = []
    for f in range(folds):
        m = np.stack([sum(counts[k, g] for g in range(folds) if g != f or folds == 1) for k in langs], 1) + 0.05
        ll.append(np.concatenate([np.log(m / m.sum(0)), np.full((BUCKETS, 1), -np.log(BUCKETS))], 1))
    return {"langs": langs, "ll": np.stack(ll).astype(np.float32)}


def _scored(df: DataFrame, text: str, fold: str, model, tempered: float) -> DataFrame:
    """Adds ``_ll``: tempered log-likelihoods by language, the unknown one last; null without text evidence."""

    def score(t: pa.Array, f: pa.Array) -> pa.Array:
        every, f = model.value["ll"], np.asarray(f)
        h, at = _trigrams(t)
        n = np.diff(at)
        sums = np.zeros((len(n), every.shape[2]))
        for k, ll in enumerate(every):
            some = (n > 0) & (f == k)
            if some.any():
                mine = h if some.sum() == (n > 0).sum() else h[np.repeat(f == k, n)]
                start = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                for j, column in enumerate(ll.T):  # one language at a time keeps what is gathered small
                    sums[some, j] = np.add.reduceat(np.ascontiguousarray(column)[mine], start, dtype=np.float64)
        sums *= (np.minimum(n, tempered) / np.maximum(n, 1))[:, None]
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * every.shape[2]), pa.array(sums.ravel()))
        return pa.ListArray.from_arrays(out.offsets, out.values, mask=pa.array(n == 0)) if len(n) else out

    return df.withColumn("_ll", arrow_fn(score, "array<double>")(F.col(text), F.col(fold)))


def _softmax(xs: list) -> list:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    es = [F.exp(x - top) for x in xs]
    total = sum(es[1:], es[0])
    return [e / total for e in es]


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source",
             suffix: str | None = None, id_: str = "doc_id", label: str | None = None, model: dict | None = None,
             per_language: int = 1500, folds: int = 2, tempered: float = 60.0, host_weight: float = 20.0, suffix_weight: float = 50.0,
             least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``posterior``, ``has_text``, ``kept``.

    ``label`` names the column the trigram models are fitted on (by default the
    declared one).  ``kept``: the text has letters, the language is not the
    unknown one, and its posterior is at least ``least``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = model or fit(docs, text, label or declared, id_, per_language, folds)
    langs = model["langs"]
    if not langs:
        none = {"lang_pred": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "has_text": F.lit(False), "kept": F.lit(False)}
        return docs.withColumns(none)  # replaces namesakes
    every = [*langs, UNKNOWN]
    need = {"_t": text, "_d0": declared, "_h0": host, "_s0": suffix}
    own = packed(docs.withColumn("_i", _fold(id_, text, len(model["ll"]))), _f="_i", **need).withColumns({c: F.col(f"{c}0").cast("string") for c in ("_d", "_h", "_s")})
    shared = spark.sparkContext.broadcast(model)
    scored = _scored(own, "_t", "_f", shared, tempered)
    ll = [F.get("_ll", F.lit(i)) for i in range(len(every))]
    unknown_prior = F.lit(float(np.log(1e-3)))
    soft = _softmax([x + (unknown_prior if i == len(langs) else F.lit(0.0)) for i, x in enumerate(ll)])
    evidence = (
        _scored(own.select("_d", "_h", "_s", "_t", "_f"), "_t", "_f", shared, tempered)
        .filter(F.col("_ll").isNotNull()).select("_d", "_h", "_s", *[p.alias(f"p{i}") for i, p in enumerate(soft)])
        .groupBy("_d", "_h", "_s").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(every))])
    )
    evidence = saved(evidence, work_dir(spark, "langid"))
    sums = lambda *by: evidence.groupBy(*by).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(every))])
    n = len(every)
    total = np.array([float(x or 0) for x in sums().first()]) + 0.5
    base = total / total.sum()

    # P(declared | language), for every value declared in a text with evidence; others share one row
    rows = sums("_d").filter("_d is not null")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]).first()
    table = np.array([(whole[f"p{i}"] or 0.0) + 0.5 * whole["n"] + 0.5 for i in range(n)])
    other = np.log(0.5 / table) if whole["n"] else np.zeros(n)
    spoken = rows.select("_d", F.array(*[F.log((F.col(f"p{i}") + 0.5) / F.lit(float(table[i]))) for i in range(n)]).alias("_dl"))
    spoken = saved(spoken, work_dir(spark, "declared"))

    # prior by suffix and by host, each smoothed towards the level above
    share = lambda i, w, parent: (F.coalesce(F.col(f"p{i}"), F.lit(0.0)) + w * parent) / (F.col("_n") + w)
    add = lambda d: d.withColumn("_n", sum((F.col(f"p{i}") for i in range(1, n)), F.col("p0")))
    by_suffix = add(sums("_s").filter("_s is not null")).select("_s", *[share(i, suffix_weight, F.lit(float(base[i]))).alias(f"s{i}") for i in range(n)])
    by_host = add(sums("_h", "_s").filter("_h is not null")).join(by_suffix, "_s", "left")
    by_host = by_host.select("_h", "_s", F.array(*[share(i, host_weight, F.coalesce(F.col(f"s{i}"), F.lit(float(base[i])))) for i in range(n)]).alias("_hp"))
    by_host = saved(by_host, work_dir(spark, "hosts"))
    by_suffix = by_suffix.select(F.col("_s").alias("_s2"), F.array(*[f"s{i}" for i in range(n)]).alias("_sp"))
    small = lambda d: F.broadcast(d) if d.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else d

    out = scored.join(small(spoken), "_d", "left")
    right = small(by_host.withColumnsRenamed({"_h": "_h2", "_s": "_s3"}))
    out = out.join(right, (F.col("_h") == F.col("_h2")) & F.col("_s").eqNullSafe(F.col("_s3")), "left")
    if suffix:
        out = out.join(small(by_suffix), F.col("_s") == F.col("_s2"), "left")
    prior = lambda i: F.coalesce(F.get("_hp", F.lit(i)), *([F.get("_sp", F.lit(i))] if suffix else []), F.lit(float(base[i])))
    heard = lambda i: F.when(F.col("_d").isNull(), 0.0).otherwise(F.coalesce(F.get("_dl", F.lit(i)), F.lit(float(other[i]))))
    post = [F.coalesce(ll[i], F.lit(0.0)) + heard(i) + F.log(prior(i)) for i in range(n)]
    out = out.withColumn("_p", F.array(*post))
    out = out.withColumn("_p", F.transform("_p", lambda x: F.exp(x - F.array_max("_p"))))
    out = out.withColumn("_post", F.array_max("_p") / F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    found = F.element_at(F.array(*[F.lit(x) for x in every]), best)
    has = F.col("_ll").isNotNull()
    kept = has & (found != UNKNOWN) & (F.col("_post") >= least)
    need = {k: c for k, c in need.items() if c}
    return unpacked(out, docs.columns, need, lang_pred=found, posterior=F.col("_post"), has_text=has, kept=kept)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``text`` (tags, scripts and comments blanked), ``declared`` (the html lang), ``host`` and ``suffix``."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"&#?\w+;", " ")
    lang = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    full = lambda c: F.when(c != "", c)
    return pages.withColumns({"text": body, "declared": full(lang), "host": full(host), "suffix": full(F.regexp_extract(host, r"\.([a-z]+)$", 1))})


def with_suffix(docs: DataFrame, source: str = "source", to: str = "suffix") -> DataFrame:
    """Adds the address suffix of a source that is a host name or an address; null for others."""
    host = F.regexp_extract(F.lower(F.col(source)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    found = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return docs.withColumn(to, F.when(found != "", found))


def filtered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents of a known language, with ``lang`` set to the language found."""
    need = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source"}
    out = identify(with_suffix(packed(docs, **need)), suffix="suffix").filter("kept")
    return unpacked(out, docs.columns, need, lang=F.col("lang_pred"))
