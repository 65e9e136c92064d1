"""Every operator against brute force, on small texts with edge cases."""

import base64
import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigraph.llm import bpe, common, components, decontam, eliasfano, langid, linededup, lm, neardup, quality, tokencount, toxicity, warc
from filigraph.llm.queries import lm_scoring, vocabulary


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1 ------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit(1)).withColumn("_d", F.lit(2))
    got = by_id(langid.identify(docs, per_language=100))
    right = sum(r.lang_pred == r.lang for r in got.values())
    assert right >= 0.97 * len(got) and sum(r.kept for r in got.values()) >= 0.97 * len(got)
    # the declaration is no more than evidence: all labels wrong on new texts
    model = langid.fit(docs, "text", "lang", "doc_id", 100)
    lies = docs.filter("lang = 'fr'").withColumn("lang", F.lit("de")).unionByName(docs.filter("lang = 'de'"))
    assert langid.identify(lies, model=model, declared=None).filter("lang_pred = 'fr'").count() >= 0.9 * docs.filter("lang = 'fr'").count()


def test_language_id_without_and_against_the_declaration(spark):
    """No row's own declaration reaches its text model, so these are held-out figures."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long_ = "length(text) > 200"
    masked = langid.identify(docs, declared=None, label="lang").filter(long_)
    n = masked.count()
    assert masked.filter("lang_pred = lang").count() >= 0.98 * n
    wrong = docs.withColumn("said", F.when(F.col("doc_id") % 5 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    lied = langid.identify(wrong, declared="said", label="lang").filter(long_ + " and said <> lang")
    assert lied.filter("lang_pred = lang").count() >= 0.95 * lied.count()


def test_language_id_repeated_rows_and_suffix(twice, spark):
    got = langid.identify(langid.with_suffix(twice), suffix="suffix").select("doc_id", "text", "lang_pred", "kept").collect()
    assert len(got) == twice.count()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), set()).add((r.lang_pred, r.kept))
    assert all(len(v) == 1 for v in by.values())
    hosts = spark.createDataFrame([("a.example.fr",), ("https://u@b.example.de:80/x.html",), ("src12",), (None,)], "source string")
    assert [r.suffix for r in langid.with_suffix(hosts).collect()] == ["fr", "de", None, None]


def test_language_models_of_every_label(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i % 70 // 26)} text", f"l{i % 70:02}") for i in range(210)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(many, "text", "lang", "doc_id")
    assert model["langs"] == [f"l{k:02}" for k in range(70)] and model["ll"].shape[2] == 71


def test_language_id_edges(docs, none, spark):
    assert langid.identify(none).count() == 0 and langid.filtered(spark, none).columns == none.columns
    got = by_id(langid.identify(docs))
    assert not got[200].kept and not got[201].kept and not got[202].kept and len(got) == docs.count()
    assert not langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("kept").count()
    pages = spark.createDataFrame([(1, "https://a.example.fr:80/x", '<!DOCTYPE html><HTML class="a" lang="fr-FR"><script>var x="<p>";</script><p>salut</p>'), (2, None, None)], "page_id long, url string, html string")
    a, b = langid.page_evidence(pages).orderBy("page_id").collect()
    assert (a.declared, a.host, a.suffix, a.text.split()) == ("fr", "a.example.fr", "fr", ["salut"]) and b.host is None and b.declared is None


# 2 ------------------------------------------------------------------------


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2)])
def test_line_dedup(docs, rows, batches, fanout):
    want = brute.line_dedup(rows)
    got = by_id(linededup.rewritten(docs, batches=batches, fanout=fanout))
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 10


def test_line_dedup_edges(twice, none, docs, rows, spark):
    assert linededup.rewritten(none).count() == 0
    got = linededup.rewritten(twice).collect()
    assert len(got) == 2 * len(rows) + 1
    want = brute.line_dedup(rows)
    # the document without an id comes last, so that all others are as before
    assert all((r.n_lines, r.n_dropped, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert linededup.filtered(spark, docs).columns == docs.columns


# 3 ------------------------------------------------------------------------


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 1 << 50), (1000, 1500), (3000, 1 << 20), (500, 1 << 40)):
        v = np.sort(r.integers(0, u, n)) if n else np.zeros(0, np.int64)
        e = eliasfano.EliasFano(np.frombuffer(eliasfano.EliasFano.encode(v, u), np.uint8))
        assert e.n == n
        if n:
            assert (e.get(np.arange(n)) == v).all()
        ask = np.concatenate([v, r.integers(0, u, 200)])
        at = e.find(ask)
        for x, k in zip(ask, at):
            assert (k >= 0 and v[k] == x) if x in v else k == -1


def test_registered_language_model_keeps_all_ngrams(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute.language_model(rows, least=(1, 1))
    got = by_id(lm_scoring(spark, d))
    assert all(abs(got[i].score - w[4]) < 1e-3 * w[0] for (i, _), w in zip(rows, want))


@pytest.mark.parametrize("least", [(2,), (1, 1), (2, 2, 2)])
def test_language_model(docs, rows, least, spark):
    got = by_id(lm.scored(docs, lm.train(docs, least=least, shards=3)))
    want = brute.language_model(rows, least=least)
    for (i, _), w in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert abs(r.base_score - w[3]) < 1e-9 * max(1, abs(w[3])) and abs(r.score - w[4]) < 1e-3 * r.n_tokens
        assert r.held_out == (brute.crc(i) % 7 == 2)


def test_language_model_is_a_distribution(docs):
    m = lm.train(docs, least=(2, 2), shards=2)
    words = docs.select(F.explode(F.split(F.lower("text"), "\\s+")).alias("w")).filter("w <> ''").distinct().limit(5).collect()
    every = [r.w for r in docs.filter("crc32(cast(doc_id as string)) % 7 <> 2").select(F.explode(F.split("text", "[ \\t\\n\\r]+")).alias("w")).select(F.lower("w").alias("w")).filter("w <> ''").distinct().collect()]
    for a in [r.w for r in words][:2]:
        # P(. | a): score of "a x" less score of "a", without the end token
        texts = pa.array([f"{a} {x}" for x in every])
        place, count, at, _, found = m.chain(texts, m.order)
        p = (count + 1) / (m.total + m.vocabulary + 1)
        for _, q, rest in found:
            p = q + rest * p
        second = p[at[:-1] + 1]
        assert 0.5 < second.sum() <= 1.0 + 1e-9


def test_language_model_edges(none, twice):
    assert lm.scored(none, lm.train(none)).count() == 0
    assert lm.scored(twice, lm.train(twice)).count() == twice.count()
    assert lm.scored(twice, lm.train(none)).filter("n_known > 0 or base_score <> 0").count() == 0


# 4 ------------------------------------------------------------------------


def test_quality(docs, rows, none, twice):
    got = by_id(quality.judged(docs, keep=("doc_id",)))
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(t), t
        assert not (r.base_failed and r.kept)
    assert quality.judged(none, keep=("doc_id",)).count() == 0
    assert quality.judged(twice, keep=("doc_id",)).count() == twice.count()


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    odd = docs.limit(5).selectExpr("doc_id + 100000 as doc_id", "repeat('### $$$ %%% &&& ', 60) || uuid() as text", "lang", "source", "n_chars")
    odd = odd.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.substring(F.md5(F.concat("text", i.cast("string"))), 1, 6), F.lit("###$$$")))))
    got = by_id(quality.judged(docs.unionByName(odd), keep=("doc_id",)))
    assert not any(got[i].kept for i in got if i >= 100000)
    plain = [i for i, t in docs.select("doc_id", "text").collect() if not brute.quality_base(t)[-1] and not brute.quality_base(t)[2]]
    assert sum(got[i].kept for i in plain) >= 0.99 * len(plain)


def test_quality_against_own_estimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('en', 'de', 'fr')").withColumn("source", F.when(F.col("lang") == "en", F.concat(F.lit("s"), F.col("doc_id") % 2)).otherwise(F.col("source")))
    rows = [r for r in quality.statistics(docs).collect() if not r.base_failed]
    got = by_id(quality.judged(docs, keep=("doc_id", "kept", "distance"), least_rows=100))
    vector = lambda r: [r[f] for f in quality.FEATURES]
    by = {}
    for r in rows:
        for key in ((r.lang, r.source), (r.lang,)):
            by.setdefault(key, []).append(vector(r))
    made, near, same, far = {}, 0, 0, 0
    for r in rows:
        key = next(k for k in ((r.lang, r.source), (r.lang,)) if len(by[k]) >= 100)
        if key not in made:
            made[key] = brute.mcd(by[key], quality.FLOOR)
        m, c = made[key]
        gap = np.array(vector(r)) - m
        want = gap @ np.linalg.inv(c) @ gap
        near += abs(got[r.doc_id].distance - want) <= 0.02 * want + 0.01
        same += got[r.doc_id].kept == (want <= 22.4577)
        far += want > 22.4577
    assert len(made) > 3 and near >= 0.97 * len(rows) and same >= 0.995 * len(rows) and 0 < far < 0.2 * len(rows)


# 5, 6 ---------------------------------------------------------------------


def test_pattern_engines_agree_on_all_common_characters():
    import regex
    import tiktoken

    ranks = bpe.ranks(vocabulary("byte_bpe_50k.tiktoken"))
    rare = regex.compile(bpe.BPE_RARE)
    own = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not rare.match(chr(c))]
    from filigraph.llm import common

    for p, own_class in ((r"\p{L}", common._LETTERS), (r"\p{N}", common._NUMBERS), (r"\s", common._SPACES)):
        spelt = regex.compile(f"[{own_class}]")
        assert all(bool(spelt.match(c)) == bool(regex.match(p, c)) for c in own)
        e, g = tiktoken.Encoding("x", pat_str=p, mergeable_ranks=ranks, special_tokens={}), regex.compile(p)
        assert all(bool(e.encode_ordinary(c)) == bool(g.match(c)) for c in own)


def test_token_counts(docs, rows, none, twice):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(tokencount.counted(docs, path))
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024)
    assert tokencount.counted(none, path).count() == 0 and tokencount.counted(twice, path).count() == twice.count()
    proven = tokencount.prove(path)
    assert len(proven) > 30_000 and all(len(t.encode(x).ids) == 1 for x in list(proven)[:500])


def test_byte_bpe(docs, rows, none, twice):
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=bpe.BPE_PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = by_id(bpe.digests(docs, path))
    for i, x in rows:
        ids = e.encode_ordinary(x or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, path), path)
    assert back.filter(F.coalesce("text", F.lit("")) != F.decode("decoded", "UTF-8")).count() == 0
    assert bpe.digests(none, path).count() == 0 and bpe.digests(twice, path).count() == twice.count()


def test_fold_and_heap_agree(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    words = [" the", "étrange", "aaaaaaaaaaaaaaaaa", " unbelievably", "\n\n", "日本", "x", "1234567", "!!!???"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold(F.col("w"), bpe.rank_literal(path)).alias("ids")).collect()
    for r in got:
        assert r.ids == bpe.merged(r.w.encode(), bpe.ranks(path)), r.w
        assert b"".join(base64.b64decode(base64.b64encode({v: k for k, v in bpe.ranks(path).items()}[i])) for i in r.ids) == r.w.encode()


def test_cut_is_the_library_s_for_all_characters():
    """The library's own classes, spelt out: every character between a letter, a number and spaces."""
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=bpe.BPE_PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 37]
    for k in range(0, len(every), 3000):
        text = " ".join(f"a{c}1 {c}{c}" for c in every[k : k + 3000])
        assert [i for w in bpe.cutter()(text) for i in e.encode_ordinary(w)] == e.encode_ordinary(text)


def test_columns_with_names_of_results(docs, spark):
    path, json_ = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
    few = docs.filter("doc_id < 20").withColumns({c: F.lit("own") for c in ("score", "n_tokens", "ids", "decoded", "held_out", "i", "n_bytes", "n_words", "distance", "nearest")})
    assert bpe.decoded(bpe.encoded(few, path), path).columns == few.columns
    assert bpe.decoded(bpe.encoded(few, path), path).filter("score <> 'own' or n_tokens <> 'own'").count() == 0
    for out in (tokencount.counted(few, json_), bpe.digests(few, path), lm.scored(few, lm.train(few)), quality.judged(few, keep=("doc_id", "distance", "n_words"))):
        assert out.count() == few.count() and len(set(out.columns)) == len(out.columns)


# 7 ------------------------------------------------------------------------


def test_decontamination(docs, rows, none, twice, spark):
    texts = dict(rows)
    w = texts[4].split()
    items = [(10, texts[1][:200]), (2, " ".join(texts[2].split()[:14])), (30, texts[1][:200]), (4, "one two THREE"), (5, None), (6, "!!"), (None, " ".join(w[:10])), (7, " ".join(["zz"] * 12)), (8, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(rows, items)
    got = by_id(decontam.digests(docs, bench))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    for how in ({"block_words": 20}, {"most_words": 30}):
        marked = by_id(decontam.marked(docs, bench, **how))
        assert {i: r.found.n_hit for i, r in marked.items()} == {i: x[1] for i, x in want.items()}
    assert decontam.digests(none, bench).count() == 0 and decontam.digests(twice, bench).count() == twice.count()
    assert decontam.digests(docs, bench.limit(0)).filter("contaminated").count() == 0
    clean = decontam.filtered(spark, docs, bench)
    assert clean.columns == docs.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert all(x[1] < 10 for x in brute.decontaminate(left, items[:3]).values())
    assert {i for i, x in want.items() if not x[1]} <= {i for i, _ in left}


# 8 ------------------------------------------------------------------------


def test_near_duplicates(docs, rows, none, twice, spark):
    want = brute.near(rows)
    got = by_id(neardup.digests(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert sum(i != c for i, (_, c) in want.items()) > 10
    assert neardup.digests(none).count() == 0
    again = neardup.digests(twice).collect()
    assert len(again) == twice.count() and all(r.component_id == want[r.doc_id][1] for r in again if r.doc_id is not None)
    kept = neardup.filtered(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in brute.near(rows, 80).values()}


def test_near_duplicates_in_chains_and_blocks(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):  # each two steps of the chain are further apart than neighbours are
        rows.append((k, " ".join([*(f"c{k}_{j}" if j <= 3 * 0 else x for j, x in enumerate(base[k * 12 :])), *(f"t{j}" for j in range(k * 12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    for block in (2048, 4):
        got = {r.doc: r.component for r in neardup.duplicates(df, block=block).collect()}
        assert got == {i: c for i, (_, c) in want.items()}


def test_components_in_one_task_and_in_rounds(spark, tmp_path):
    r = np.random.default_rng(9)
    chain = r.permutation(200) - 50
    edges = [*zip(chain[1:], chain[:-1]), *[(1000, 1001 + k) for k in range(1500)], *[tuple(x) for x in r.integers(5000, 5400, (220, 2))], (9000, 9000)]
    edges = [(int(x), int(y)) for x, y in edges + edges[:40]]
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in up:
        for x, y in edges:
            if x != y:
                up[x] = up[y] = min(up[x], up[y])
        if all(up[x] == up[y] for x, y in edges if x != y):
            break
    df = spark.createDataFrame(edges, "a long, b long")
    for k, how in enumerate(({}, {"one_task": 0})):
        got = components.components(df, f"{tmp_path}/{k}", **how).collect()
        assert len(got) == len(up) and {x.v: x.root for x in got} == up
        assert components.components(df.limit(0), f"{tmp_path}/none{k}", **how).count() == 0


def test_near_duplicates_take_few_jobs(docs, spark):
    """Each query costs the driver memory, whatever its rows."""
    sc = spark.sparkContext
    sc.setJobGroup("near", "near-duplicates")
    try:
        neardup.duplicates(docs)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 10 < len(sc.statusTracker().getJobIdsForGroup("near")) < 110


def test_heavy_keys_are_split_off_only_where_there_are_any(spark, tmp_path):
    left = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    for name, rows in (("heavy", left), ("light", left.filter("id > 2990"))):
        counts = common.saved(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), f"{tmp_path}/{name}")
        got = common.heavy_split_join(rows, counts, ["k"], "n", 6000, counts)
        assert got.count() == rows.count() and got.filter(F.col("k") == 0).count() == rows.filter(F.col("k") == 0).count()
        assert ("BroadcastExchange" in got._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) == (name == "heavy")


def test_pruning_misses_few_pairs():
    needed = neardup.least_matches(0.85, 1e-7)
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 32, (2000, 192), dtype=np.uint32)
    same = r.random((2000, 192)) < 0.85
    assert neardup.survives(a, np.where(same, a, a + 1), needed).all()
    low = r.random((2000, 192)) < 0.3
    assert not neardup.survives(a, np.where(low, a, a + 1), needed).any()


# 9 ------------------------------------------------------------------------


def test_block_max_neighbours_are_exact():
    r = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        v = {int(t): float(r.random()) for t in r.integers(0, 40, r.integers(0, 8))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()} if n else {})
    index = toxicity.BlockMaxIndex(vectors, 16)
    for q in vectors[:60]:
        got, want = index.nearest(q, 7), brute.nearest(vectors, q, 7)
        assert [i for _, i in got] == [i for _, i in want] or np.allclose([s for s, _ in got], [s for s, _ in want])


def test_toxicity(spark, none, docs):
    d = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(texts, labels)
    x = toxicity.scored(texts, model).join(labels, "doc_id").filter("held_out").collect()
    tp, fp, fn = (sum(c) for c in zip(*[(r.predicted and r.toxic, r.predicted and not r.toxic, (not r.predicted) and r.toxic) for r in x]))
    assert fp <= 3 and tp >= fn and all(0 <= r.score <= 1 for r in x)
    assert toxicity.scored(none, model).count() == 0
    flat = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(docs, flat).select("score").distinct().count() == 1


def test_toxicity_index_holds_all_terms(spark):
    assert toxicity.word_terms("ab") == ["ab"] and toxicity.word_terms("x" * 30 + "a")[0] != toxicity.word_terms("x" * 30 + "b")[0]
    assert "道中+" in toxicity.word_terms("街道中的") and toxicity.word_terms("\u9053")[-1] == "\u9053+"
    r = np.random.default_rng(2)
    vectors = [{int(t): float(w) for t, w in zip(r.choice(90, 9, p=np.arange(90) / 4005, replace=False), r.random(9))} for _ in range(150)]
    pairs = [(np.array(list(v)), np.array(list(v.values()))) for v in vectors]
    row = np.repeat(np.arange(150), 9)
    for head in (0, 20, 512):
        index = toxicity.ExactIndex(150, row, np.concatenate([t for t, _ in pairs]), np.concatenate([w for _, w in pairs]), 90, head)
        for v, c in zip(vectors, index.cosines(pairs)):
            got, want = index.best(c, 7), brute.nearest(vectors, v, 7)
            assert np.allclose([s for s, _ in got], [s for s, _ in want])
    # texts of ordinary words are compared with examples too
    words = "alpha beta gamma delta omega sigma kappa theta".split()
    rows = [(i, " ".join(words[(i * 3 + j) % 8] for j in range(4)) + (" vile" if i % 5 == 0 else "")) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = texts.selectExpr("doc_id", "int(doc_id % 5 = 0) as toxic")
    model = toxicity.fit(texts, labels)
    assert set(model.places()) >= {toxicity.term_key(w) for w in [*words, "vile"]}
    got = toxicity.scored(texts, model).join(labels, "doc_id").collect()
    assert all(len(x.nearest) == model.k and x.predicted == x.toxic for x in got)


# 10 -----------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, None), (4, "http://a/4", ""), (None, "u", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (5, "http://é", "日本" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.digests(pages).collect()
    assert len(got) == len(rows)
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == want
    kind = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kind == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("revisit", 2), None: ("revisit", 1), 5: ("response", None)}
    assert warc.digests(pages.limit(0)).count() == 0


def test_warc_dictionary_and_many_archives(spark, tmp_path):
    import zstandard

    html = lambda i: f"<html><head><title>Page {i}</title><meta charset='utf-8'></head><body class='plain'><p>" + " ".join(f"word{(i * k) % 97} of the page" for k in range(40)) + "</p></body></html>"
    rows = [(i, f"http://host{i % 7}.example/{i}", html(i)) for i in range(400)] + [(1000, "http://x/", html(3)), (None, None, "né" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"path": F.lit(1), "first": F.lit(2), "h": F.lit(3)})
    d = warc.train(pages)
    assert len(d) > 1000 and d == warc.train(pages.repartition(5)) and warc.train(pages.limit(3)) == b""
    written = warc.write(pages.repartition(2), f"file://{tmp_path}", d, archive_bytes=4000)
    paths = [r.path for r in written.collect()]
    assert len(paths) > 10 and written.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read(written).collect()
    assert sorted(r.payload.decode() for r in back if r.headers["WARC-Type"] == "response") == sorted(h for i, _, h in rows if i != 1000)
    raw = open(paths[0][7:], "rb").read()  # the frames can't be read without the dictionary
    at = 8 + int.from_bytes(raw[4:8], "little")
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[at:])


def test_warc_archives_are_checked(tmp_path):
    import zstandard

    z = zstandard.ZstdCompressor()
    good = warc.record(1, "u", b"x", base64.b32encode(hashlib.sha1(b"x").digest()).decode(), None, False)
    p = tmp_path / "a.warc.zst"

    def read(*frames, head=warc.dictionary_frame(b"")):
        p.write_bytes(head + b"".join(frames))
        return list(warc.records(f"file://{p}"))

    assert [x[1] for x in read(z.compress(good), z.compress(good))] == [b"x", b"x"]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"\r\n\r\nx", b"\r\n\r\ny")):
        with pytest.raises(ValueError):
            read(z.compress(bad))
    with pytest.raises(ValueError):
        read(z.compress(good)[:-3])
    with pytest.raises(ValueError):
        read(z.compress(good), head=b"")


# pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
