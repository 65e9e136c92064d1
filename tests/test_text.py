"""Text operators against brute force, over texts and over tokens; documents of one id are one document."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigraph import cooccur, text

DOCS = [
    (1, "The cat sat on the mat. The dog; the cat!! A cat ran? to the mat"), (2, "dog dog dog cat"), (3, None), (4, ""), (5, "...on the x9mat. On"),
    (6, "ab" * 40 + " zebra " + "the of and to in " * 30), (7, "mat cat"), (7, "dog"), (None, "the cat"), (8, "!?. . the.the!cat"), (9, "KKat İx caT"),
]
REACH = 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def toks(docs):
    return text.tokens(docs)


@pytest.fixture(scope="module")
def vocab(docs):
    return text.lexicon(docs, 2).cache()


@pytest.fixture(scope="module")
def lists(toks, vocab):
    """Each document's (pos, token id)."""
    ids, out = {r.token: r.token_id for r in vocab.collect()}, defaultdict(list)
    for r in toks.collect():
        if r.token in ids:
            out[r.doc_id].append((r.pos, ids[r.token]))
    return {k: sorted(x) for k, x in out.items()}


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def both_ways(f, docs, toks, vocab):
    """The rows over texts, which are those over tokens."""
    a, b = rows(f(docs, vocab)), rows(f(toks, vocab))
    assert a and a == b
    return a


def test_lexicon_and_counts(docs, toks):
    assert rows(text.lexicon(docs, 2)) == rows(text.vocabulary(toks, 2).select("token", "n", "token_id"))
    want = toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct"))
    assert rows(text.token_counts(docs)) == rows(want)
    assert rows(text.distinct_tokens(docs)) == rows(toks.select("token").distinct())


def test_windows(docs, toks, vocab, lists):
    n, shared, own = Counter(), Counter(), Counter()
    for d, x in lists.items():
        for i in range(len(x)):
            items = sorted({t for _, t in x[i : i + 4]})
            own.update(items)
            for k, a in enumerate(items):
                n.update((d, a, b) for b in items[k + 1 :])
                shared.update((a, b) for b in items[k + 1 :])
    assert both_ways(lambda t, v: text.document_graphs(t, v, 4), docs, toks, vocab) == sorted(((*k, w) for k, w in n.items()), key=str)
    assert both_ways(lambda t, v: text.window_counts(t, v, 4), docs, toks, vocab) == sorted(((*k, float(w)) for k, w in shared.items()), key=str)
    heaviest = both_ways(lambda t, v: text.heaviest_windows(t, v, 4, 2), docs, toks, vocab)
    assert heaviest == rows(text.top_per_token(text.window_counts(docs, vocab, 4), 2))
    t = sum(map(len, lists.values()))
    w = {(a, b): math.log(c / t / (own[a] / t * own[b] / t + 1e-12)) for (a, b), c in shared.items()}
    assert both_ways(lambda t, v: text.ppmi(t, v, 4), docs, toks, vocab) == sorted(((*k, round(x, 9)) for k, x in w.items() if x > 0), key=str)


def ahead(x):
    for i, (_, a) in enumerate(x):
        for k, (_, b) in enumerate(x[i + 1 : i + 1 + REACH]):
            if a == b:
                break
            yield a, b, k


def test_collocations(docs, toks, vocab, lists):
    n, dist, w = Counter(), Counter(), Counter()
    for d, x in lists.items():
        f = Counter()
        for a, b, k in ahead(x):
            n[d, a, b] += 1
            dist[d, a, b] += k
            f[a, b] += math.exp(-k - 1)
        for p, y in f.items():
            w[p] -= math.log(y / sum(f.values()))
    assert both_ways(lambda t, v: text.collocations(t, v, REACH), docs, toks, vocab) == sorted(((*k, c, dist[k]) for k, c in n.items()), key=str)
    got = {r[:2]: r[2] for r in both_ways(lambda t, v: text.collocation_weights(t, v, REACH), docs, toks, vocab)}
    assert got.keys() == w.keys() and all(abs(got[k] - w[k]) < 1e-8 for k in w)


def test_locality(docs, toks, vocab, lists):
    close, both = Counter(), Counter()
    for x in lists.values():
        close.update({(min(a, b), max(a, b)) for i, a in x for j, b in x if abs(i - j) <= 2 and a != b})
        own = sorted({t for _, t in x})
        both.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    assert both_ways(lambda t, v: text.locality(t, v, 2).select("u", "v", "both", "close"), docs, toks, vocab) == sorted(((*k, both[k], c) for k, c in close.items()), key=str)
    both_ways(lambda t, v: text.locality_surprise(t, v, 1, 2), docs, toks, vocab)


def test_sparks_hash(spark):
    x = np.array([0, 1, -5, 2**31 - 1], np.int64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i int, x long").select("i", F.xxhash64("x", F.col("x").cast("int"), F.lit(7)).alias("h")).orderBy("i")
    h = cooccur.hashed(np.full(4, 7), cooccur.hashed(x, cooccur.hashed(x, np.full(4, 42), 64), 32), 32)
    assert [r.h for r in df.collect()] == h.tolist()


def test_weights_of_documents(spark, docs, toks, vocab, lists):
    marks = spark.createDataFrame([(1, 0), (2, 1), (7, 1), (8, 0), (8, 1), (8, 1), (3, 0)], "doc_id long, label int")
    own = toks.join(vocab, "token").select("doc_id", "token_id")
    want = rows(text.class_weights(own, marks))
    assert both_ways(lambda t, v: text.class_weights_of(t, v, marks), docs, toks, vocab) == want
    train = {1, 2, 7, 8}
    df, w = Counter(t for d in train for t in {t for _, t in lists[d]}), {}
    for d, x in lists.items():
        c = Counter(t for _, t in x)
        y = {t: k / len(x) * (math.log((len(train) + 1) / (df[t] + 1)) + 1) for t, k in c.items()}
        w |= {(d, t): round(v / sum(y.values()), 9) for t, v in y.items()}
    assert both_ways(lambda t, v: text.tfidf(t, v, marks), docs, toks, vocab) == sorted(((*k, x) for k, x in w.items()), key=str)


def test_hyperedges(docs, vocab):
    s = docs.select("doc_id", F.posexplode(F.split("text", "[.!?]+")).alias("edge", "s"))
    want = s.select("doc_id", "edge", F.explode(text.token_array(F.col("s"))).alias("token")).join(vocab, "token").select("doc_id", "edge", "token_id").distinct()
    assert rows(text.hyperedges(docs, vocab)) == rows(want)


def test_pieces_and_blocks_of_any_size(docs, toks, vocab, monkeypatch):
    """Small pieces and buckets give the same; no token is a row of a window or of a shuffle."""
    want = [rows(f) for f in (text.window_counts(docs, vocab, 4), text.locality(docs, vocab, 2), text.collocation_weights(docs, vocab, REACH))]
    monkeypatch.setattr(cooccur, "BUCKET", 8)
    once = docs.filter("doc_id <> 7")
    plan = text.window_counts(once, vocab, 4)._jdf.queryExecution().toString()
    assert "Window" not in plan and "explode" not in plan
    assert want == [rows(f) for f in (text.window_counts(docs, vocab, 4), text.locality(docs, vocab, 2), text.collocation_weights(docs, vocab, REACH))]
    x = np.array([0, 5, 2**40, 3, 255], np.int64)
    assert (cooccur.decoded(cooccur.coded(x), 5).view(np.int64) == x).all()
