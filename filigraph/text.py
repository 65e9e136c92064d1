"""Text corpora as graphs: tokens, vocabularies, co-occurrence kernels, seeds, per-document graphs.

Where an operator takes ``toks``, these are tokens (doc_id, pos, token) or, which spares their shuffle, texts (doc_id, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cooccur
from .cooccur import Corpus, Packed, Piece, out_batches, summed_runs


def token_array(text: Column) -> Column:
    """Runs of a-z of the lowered text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def tokens(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, pos, token)."""
    return docs.select(F.col(id_).alias("doc_id"), F.posexplode(token_array(F.col(text))).alias("pos", "token"))


def character_ngrams(docs: DataFrame, n: int, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, gram) of each token wrapped in < and >."""
    t = tokens(docs, text, id_).withColumn("w", F.concat(F.lit("<"), "token", F.lit(">"))).filter(F.length("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, F.lit(n)))
    return t.select("doc_id", F.explode(grams).alias("gram"))


def vocabulary(toks: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(token, n, df, token_id): ids 1.. by count descending, then token."""
    v = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("df")).filter(F.col("n") >= least)
    if most is not None:
        v = v.orderBy(F.desc("n"), "token").limit(most)
        return v.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long"))
    from .graph import numbered

    return numbered(v, [-F.col("n"), F.col("token")], "token_id")


def lexicon(docs: DataFrame, least: int = 1) -> DataFrame:
    """(token, n, token_id) of texts ``docs(text)``: ``vocabulary`` without the numbers of documents."""
    from .graph import numbered

    return numbered(cooccur.counted_tokens(docs).filter(F.col("n") >= least), [-F.col("n"), F.col("token")], "token_id")


def distinct_tokens(docs: DataFrame) -> DataFrame:
    """(token) of texts ``docs(text)``."""
    return cooccur.counted_tokens(docs).select("token")


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n, n_distinct) of documents that have tokens."""
    cooccur.session(docs.sparkSession)

    def run(batches):
        for p in cooccur.pieces(batches, None):
            n = np.bincount(p.doc, minlength=p.rows.num_rows)
            x = Packed((p.doc, p.rows.num_rows), (p.code, len(p.ids)))
            own = np.bincount(x.column(0, x.starts(2)), minlength=p.rows.num_rows)
            ok = np.flatnonzero(n)
            yield from out_batches({"doc_id": p.rows["doc_id"].take(pa.array(ok)).combine_chunks(), "n": n[ok], "n_distinct": own[ok]})

    once, repeated = cooccur.by_document(docs)
    out = once.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, n long, n_distinct long")
    if repeated is None:
        return out
    return out.unionByName(tokens(repeated).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct")))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def windows(toks: DataFrame, vocab: DataFrame, width: int) -> DataFrame:
    """(doc_id, at, items): token ids of each window of ``width`` in-vocabulary tokens, the shrinking tail included."""
    ids = toks.join(vocab.select("token", "token_id"), "token")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, width - 1)
    return ids.select("doc_id", F.col("pos").alias("at"), F.array_distinct(F.collect_list("token_id").over(w)).alias("items"))


def _window_blocks(width: int, both: bool = False):
    """Blocks of a piece's pairs and their windows; ``both``: each pair in either order."""

    def blocks(p: Piece, b: cooccur.Buckets) -> Iterator[pa.RecordBatch]:
        u, v, w = cooccur.window_pairs(p, width)
        order, rank = b.order(p.ids)
        n = len(p.ids)
        for one, two in ((u, v), (v, u))[: 1 + both]:
            x = Packed((rank[two], n), (one, n), (w, width))
            at = x.starts(2)
            yield from b.blocks(p.ids, x.column(1, at), order[x.column(0, at)], summed_runs(x.column(2), at))

    return blocks


def window_counts(toks: DataFrame, vocab: DataFrame, width: int) -> DataFrame:
    """(u, v, w), u < v: how many windows two tokens share."""
    c = Corpus(toks, vocab)
    return c.summed(_window_blocks(width), lambda u, v, w, _: {"u": u, "v": v, "w": w.astype(float)}, "u long, v long, w double", c.buckets(c.total() * (width - 1)))


def ppmi(toks: DataFrame, vocab: DataFrame, width: int) -> DataFrame:
    """(u, v, w), u < v: positive pointwise mutual information over windows."""
    from .runtime import saved, work_dir

    c = Corpus(toks, vocab)

    def own(p: Piece) -> Iterator[pa.RecordBatch]:
        n = np.bincount(p.code, np.minimum(np.minimum(p.first() + 1, width), p.near(width - 1, -1)), len(p.ids)).astype(np.int64)
        yield from out_batches({"token_id": p.ids, "c": n, "n": np.bincount(p.code, minlength=len(p.ids))})

    uri, top = work_dir(c.spark, "windows"), c.top
    t = saved(c.map(own, "token_id long, c long, n long").groupBy("token_id").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), uri).agg(F.sum("n")).first()[0] or 0
    held = []

    def weights(u, v, c2, _):
        if not held:
            held.append(cooccur.column_of(uri, "c", top))
        one = held[0]
        w = np.log((c2 / t) / ((one[u] / t) * (one[v] / t) + 1e-12))
        ok = w > 0
        return {"u": u[ok], "v": v[ok], "w": w[ok]}

    return c.summed(_window_blocks(width), weights, "u long, v long, w double", c.buckets(t * (width - 1)))


def tfidf(toks: DataFrame, vocab: DataFrame, train: DataFrame, norm: str = "l1") -> DataFrame:
    """(doc_id, token_id, w): idf = ln((N+1)/(df+1)) + 1 over the training documents; documents without tokens are dropped."""
    from .runtime import saved, work_dir

    c = Corpus(toks, vocab)

    def seen(p: Piece) -> Iterator[pa.RecordBatch]:
        x = Packed((p.code, len(p.ids)), (p.doc, p.rows.num_rows))
        at = x.starts(2)
        yield from out_batches({"token_id": np.append(p.ids, 0), "df": np.append(np.bincount(x.column(0, at), minlength=len(p.ids)), len(np.unique(p.doc)))})

    uri, top = work_dir(c.spark, "df"), c.top
    df = c.map(seen, "token_id long, df long", train.select("doc_id").distinct()).groupBy("token_id").agg(F.sum("df").alias("df"))
    nd = (saved(df, uri).filter("token_id = 0").agg(F.sum("df")).first()[0]) or 0
    held = []

    def weights(p: Piece) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(np.log((nd + 1.0) / (cooccur.column_of(uri, "df", top) + 1.0)) + 1.0)
        docs = p.rows.num_rows
        x = Packed((p.doc, docs), (p.code, len(p.ids)))
        at = x.starts(2)
        doc, code, n = x.column(0, at), x.column(1, at), np.diff(np.append(at, len(p.doc)))
        w = n / np.bincount(p.doc, minlength=docs)[doc] * held[0][p.ids[code]]
        z = np.bincount(doc, w, docs) if norm == "l1" else np.sqrt(np.bincount(doc, w * w, docs))
        yield from out_batches({"doc_id": p.rows["doc_id"].take(pa.array(doc)).combine_chunks(), "token_id": p.ids[code], "w": w / z[doc]})

    return c.map(weights, f"doc_id {_kind(toks, 'doc_id')}, token_id long, w double")


def class_weights(doc_tokens: DataFrame, classes: DataFrame, floor: float = 0.1, smoothing: float = 1.0) -> DataFrame:
    """(token_id, w): divergence of the smoothed class law of a token from the smoothed prior, scaled to [floor, 1].

    ``doc_tokens(doc_id, token_id)`` distinct; ``classes(doc_id, label)``.
    """
    labelled = classes.select("doc_id", "label").distinct()
    return _class_law(doc_tokens.select("doc_id", "token_id").distinct().join(labelled, "doc_id").groupBy("token_id", "label").agg(F.count(F.lit(1)).alias("c")), labelled, floor, smoothing)


def class_weights_of(toks: DataFrame, vocab: DataFrame, classes: DataFrame, floor: float = 0.1, smoothing: float = 1.0) -> DataFrame:
    """``class_weights`` of the tokens of texts or of (doc_id, pos, token)."""
    labelled = classes.select("doc_id", "label").distinct()

    def seen(p: Piece) -> Iterator[pa.RecordBatch]:
        label = p.rows["label"].combine_chunks().dictionary_encode(null_encoding="encode")
        own = np.asarray(label.indices).astype(np.int64)
        x = Packed((p.doc, p.rows.num_rows), (p.code, len(p.ids)))
        at = x.starts(2)
        y = Packed((own[x.column(0, at)], len(label.dictionary)), (x.column(1, at), len(p.ids)))
        at = y.starts(2)
        yield from out_batches({"token_id": p.ids[y.column(1, at)], "label": label.dictionary.take(pa.array(y.column(0, at))), "c": np.diff(np.append(at, len(y.key)))})

    c = Corpus(toks, vocab).map(seen, f"token_id long, label {_kind(classes, 'label')}, c long", labelled)
    return _class_law(c.groupBy("token_id", "label").agg(F.sum("c").alias("c")), labelled, floor, smoothing)


def _class_law(c: DataFrame, labelled: DataFrame, floor: float, smoothing: float) -> DataFrame:
    """``class_weights`` from (token_id, label, c), the documents of each label that hold a token."""
    prior = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("nc"))
    k = prior.agg(F.count(F.lit(1)).alias("k"), F.sum("nc").alias("n"))
    prior = prior.join(F.broadcast(k)).select("label", "k", ((F.col("nc") + smoothing) / (F.col("n") + smoothing * F.col("k"))).alias("q"))
    full = c.select("token_id").distinct().join(F.broadcast(prior)).join(c, ["token_id", "label"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    s = full.groupBy("token_id").agg(F.sum("c").alias("s"))
    p = (F.col("c") + smoothing) / (F.col("s") + smoothing * F.col("k"))
    score = full.join(s, "token_id").withColumn("p", p).groupBy("token_id").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
    top = score.agg(F.max("kl").alias("top"))
    return score.join(F.broadcast(top)).select("token_id", (floor + (1 - floor) * F.when(F.col("top") > 0, F.col("kl") / F.col("top")).otherwise(0.0)).alias("w"))


def document_graphs(toks: DataFrame, vocab: DataFrame, width: int) -> DataFrame:
    """(doc_id, a, b, w), a < b: in how many windows of the document two tokens meet."""

    def graphs(p: Piece) -> Iterator[pa.RecordBatch]:
        a, b, w, doc = cooccur.window_pairs(p, width, True)
        x = Packed((doc, p.rows.num_rows), (a, len(p.ids)), (b, len(p.ids)), (w, width))
        at = x.starts(3)
        yield from out_batches({"doc_id": p.rows["doc_id"].take(pa.array(x.column(0, at))).combine_chunks(), "a": p.ids[x.column(1, at)], "b": p.ids[x.column(2, at)], "w": summed_runs(x.column(3), at)})

    return Corpus(toks, vocab).map(graphs, f"doc_id {_kind(toks, 'doc_id')}, a long, b long, w long")


def hyperedges(docs: DataFrame, vocab: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, edge, token_id): the distinct tokens of each sentence (split at . ! ?)."""
    docs = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    c = Corpus(docs, vocab)
    uri, out = c.uri, None

    def run(batches):
        for p in cooccur.pieces(batches, uri):
            x = Packed((p.doc, p.rows.num_rows), (p.part, int(p.part.max(initial=0)) + 1), (p.code, len(p.ids)))
            at = x.starts(3)
            yield from out_batches({"doc_id": p.rows["doc_id"].take(pa.array(x.column(0, at))).combine_chunks(), "edge": pa.array(x.column(1, at).astype(np.int32)), "token_id": p.ids[x.column(2, at)]})

    if c.docs is not None:
        out = c.docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, edge int, token_id long")
    if c.repeated is not None:
        s = c.repeated.select("doc_id", F.posexplode(F.split("text", "[.!?]+")).alias("edge", "s"))
        t = s.select("doc_id", "edge", F.explode(F.array_distinct(token_array(F.col("s")))).alias("token"))
        x = t.join(c.vocab, "token").select("doc_id", "edge", "token_id").distinct()
        out = x if out is None else out.unionByName(x)
    return out


def collocations(toks: DataFrame, vocab: DataFrame, reach: int) -> DataFrame:
    """(doc_id, u, v, n, d): pairs v within ``reach`` after u, before u's next occurrence; summed distance v - u - 1."""

    def near(p: Piece) -> Iterator[pa.RecordBatch]:
        doc, u, v, k = cooccur.pairs_ahead(p, reach)
        x = Packed((doc, p.rows.num_rows), (u, len(p.ids)), (v, len(p.ids)), (k, reach))
        at = x.starts(3)
        yield from out_batches({"doc_id": p.rows["doc_id"].take(pa.array(x.column(0, at))).combine_chunks(), "u": p.ids[x.column(1, at)], "v": p.ids[x.column(2, at)], "n": np.diff(np.append(at, len(x.key))), "d": summed_runs(x.column(3), at)})

    return Corpus(toks, vocab).map(near, f"doc_id {_kind(toks, 'doc_id')}, u long, v long, n long, d long")


def collocation_weights(toks: DataFrame, vocab: DataFrame, reach: int = 10, power: float = 1.0, width: float = 1.0) -> DataFrame:
    """(u, v, w): closeness exp(-d^power / width) summed in each document, its share of the document's, and -ln(share) summed."""
    c = Corpus(toks, vocab)

    def blocks(p: Piece, b: cooccur.Buckets) -> Iterator[pa.RecordBatch]:
        doc, u, v, k = cooccur.pairs_ahead(p, reach)
        order, rank = b.order(p.ids)
        x = Packed((rank[v], len(p.ids)), (u, len(p.ids)), (doc, p.rows.num_rows), (k, reach))
        at = x.starts(3)
        f = summed_runs(np.exp(-(np.arange(1.0, reach + 1) ** power) / width)[x.column(3)], at)
        doc = x.column(2, at)
        share = -np.log(f / np.bincount(doc, f, p.rows.num_rows)[doc])
        pair = x.starts(2, at)
        at = at[pair]
        yield from b.blocks(p.ids, x.column(1, at), order[x.column(0, at)], summed_runs(share, pair))

    return c.summed(blocks, lambda u, v, w, _: {"u": u, "v": v, "w": w}, "u long, v long, w double", c.buckets(c.total() * reach, True))


def locality(toks: DataFrame, vocab: DataFrame, near: int) -> DataFrame:
    """(u, v, both, close): documents that hold both tokens, for pairs that are at most ``near`` apart in ``close`` of them.

    Pairs that never meet are not made: what is shuffled grows with the texts' length times ``near``.
    The documents of both are counted from files of the documents' distinct tokens.
    """
    return _locality(toks, vocab, near, lambda u, v, x, both: {"u": u, "v": v, "both": both(u, v), "close": x}, "u long, v long, both long, close long")


def _locality(toks: DataFrame, vocab: DataFrame, near: int, rows, schema: str, seed: int | None = None) -> DataFrame:
    """``rows(u, v, x, both)`` of the pairs that meet; ``x``: in how many documents, plus 2^32 times those after shuffling."""
    from .runtime import work_dir

    c = Corpus(toks, vocab)
    b = c.buckets(c.total() * near // 4)
    folder = work_dir(c.spark, "postings")
    bits = 32 if c.texts or dict(toks.dtypes)["pos"] == "int" else 64
    files = [r.name for r in c.map(lambda p: iter([pa.record_batch({"name": [cooccur.save_postings(p, b, folder)]})]), "name string").collect()]  # one name a piece

    def blocks(p: Piece, b: cooccur.Buckets) -> Iterator[pa.RecordBatch]:
        order, rank = b.order(p.ids)
        n, found = len(p.ids), []
        codes = [p.code]
        if seed is not None:
            h = cooccur.hashed(p.pos, p.rows["h"].to_numpy()[p.doc], bits)
            h = cooccur.hashed(np.full(len(h), seed), h, 32)
            codes.append(p.code[np.lexsort((p.pos, h, p.doc))])
        for k, code in enumerate(codes):
            doc, u, v = cooccur.met_pairs(p, near, code)
            x = Packed((rank[v], n), (u, n), (doc, p.rows.num_rows))
            each = x.starts(3)
            at = x.starts(2, each)
            found.append((x.column(0, each[at]), x.column(1, each[at]), np.diff(np.append(at, len(each))) << 32 * k))
        v, u, w = (np.concatenate(f) for f in zip(*found))
        if seed is not None:
            key = v * n + u
            o = np.argsort(key, kind="stable")
            at = cooccur.run_starts(key[o])
            v, u, w = v[o][at], u[o][at], summed_runs(w[o], at)
        yield from b.blocks(p.ids, u, order[v], w)

    return c.summed(blocks, lambda u, v, x, bucket: rows(u, v, x, lambda u, v: cooccur.held_together(files, b, bucket, u, v)), schema, b)


def locality_surprise(toks: DataFrame, vocab: DataFrame, near: int = 10, least: int = 3, seed: int = 7) -> DataFrame:
    """(u, v, w): the share of common documents in which two tokens are near, less that after shuffling each document.

    Pairs with ``least`` common documents or more; only what is above 0 is kept.
    The shuffle orders a document's places by a hash.
    """

    def rows(u, v, x, both):
        close, chance = x & 0xFFFFFFFF, x >> 32
        ok = close > chance
        u, v, close, chance = u[ok], v[ok], close[ok], chance[ok]
        n = both(u, v)
        ok = n >= least
        return {"u": u[ok], "v": v[ok], "w": (close[ok] - chance[ok]) / n[ok]}

    return _locality(toks, vocab, near, rows, "u long, v long, w double", seed)


def heaviest_windows(toks: DataFrame, vocab: DataFrame, width: int, k: int) -> DataFrame:
    """``top_per_token`` of ``window_counts``, whose pairs come to both of their tokens, so that only the k of each are given on."""
    c = Corpus(toks, vocab)

    def top(u, v, w, _):
        order = np.lexsort((u, -w, v))
        u, v, w = u[order], v[order], w[order]
        at = cooccur.run_starts(v)
        ok = np.arange(len(v)) - np.repeat(at, np.diff(np.append(at, len(v)))) < k
        return {"u": np.minimum(u, v)[ok], "v": np.maximum(u, v)[ok], "w": w[ok].astype(float)}

    x = c.summed(_window_blocks(width, True), top, "u long, v long, w double", c.buckets(c.total() * 2 * (width - 1)))
    return x.groupBy("u", "v").agg(F.max("w").alias("w"))


def top_per_token(kernel: DataFrame, k: int) -> DataFrame:
    """(u, v, w), u < v: pairs that are among the ``k`` heaviest of either token; ties go to the smaller other token.

    Each task keeps k pairs a token before the shuffle (a window group limit).
    """
    both = kernel.select("u", "v", "w").unionByName(kernel.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    x = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("w"), "v"))).filter(F.col("r") <= k)
    return x.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "w").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.max("w").alias("w"))


def domain_graph(kernel: DataFrame, n: int, density: float, weighted: bool = False) -> DataFrame:
    """(u, v, w), u < v: the pairs as heavy as the one of rank round(density n (n - 1) / 2), ties kept; weight 1 or the kernel's.

    The threshold comes from counts by weight, so that no task sorts all pairs.
    """
    rank = int(density * n * (n - 1) / 2 + 0.5)
    if rank <= 0:
        return kernel.select("u", "v", "w").limit(0)
    from .graph import numbered

    counts = numbered(kernel.groupBy("w").agg(F.count(F.lit(1)).alias("k")), [-F.col("w")], "place")
    from .runtime import saved, work_dir

    counts = saved(counts, work_dir(kernel.sparkSession, "weights"))
    lo, hi = 1, counts.count()
    while lo < hi:  # the first place that reaches the rank, by halves
        mid = (lo + hi) // 2
        if (counts.filter(F.col("place") <= mid).agg(F.sum("k")).first()[0] or 0) >= rank:
            hi = mid
        else:
            lo = mid + 1
    limit = counts.filter(F.col("place") == lo).select(F.col("w").alias("limit"))
    w = F.col("w") if weighted else F.lit(1.0)
    return kernel.join(F.broadcast(limit), F.col("w") >= F.col("limit")).select("u", "v", w.alias("w"))


def stem(word: Column) -> Column:
    """A light suffix stripper: one long suffix, then short ones, then i for y and doubled ends; never below three letters.

    Long: -ational and the like to a shorter form; short: -ies, -ied, -ing, -ed, -ly, -es, -s.
    """
    long_ = {"ational": "ate", "ization": "ize", "fulness": "ful", "iveness": "ive", "ousness": "ous", "tional": "tion", "ement": "", "ment": "", "ness": "", "able": "", "ible": ""}
    w = F.lit(None).cast("string")
    for end, short in reversed(long_.items()):
        cut = F.concat(word.substr(F.lit(1), F.length(word) - len(end)), F.lit(short))
        w = F.when(word.endswith(end) & (F.length(word) > len(end) + 2), cut).otherwise(w)
    w = F.coalesce(w, word)
    short_ = ((r"^(.{3,})(?:ies|ied)$", "$1i"), (r"^(.{3,})(?:ing|ed|ly)$", "$1"), (r"^(.{3,}?)(?:es|s)$", "$1"), (r"^(.{2,})([^slz])\2$", "$1$2"), (r"^(.{2,})y$", "$1i"))
    for pattern, to in short_:
        w = F.regexp_replace(w, pattern, to)
    return w


def balanced_split(docs: DataFrame, by: str, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Adds ``split``: the ``share`` of each group with the smallest hashes is the test part."""
    w = Window.partitionBy(by)
    r = F.row_number().over(w.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    return docs.withColumn("split", F.when(r <= F.floor(share * F.count(F.lit(1)).over(w)), "test").otherwise("train"))


def chunked(docs: DataFrame, size: int, tokens_column: str = "tokens") -> DataFrame:
    """One row per chunk of ``size`` tokens; a last chunk shorter than a quarter is dropped."""
    n = F.size(tokens_column)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size) - 1).cast("int"))
    x = docs.select("*", F.explode(cuts).alias("chunk")).withColumn("part", F.slice(tokens_column, F.col("chunk") * size + 1, size))
    return x.filter((F.size("part") >= size / 4) & (F.size("part") > 0))
