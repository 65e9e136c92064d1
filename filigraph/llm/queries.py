"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, linededup, lm, neardup, quality, tokencount, toxicity, warc

#: Folder of the vocabulary files; None takes the installed package's.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(langid.with_suffix(docs), suffix="suffix").select("doc_id", "lang_pred", "posterior", "has_text", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, "text", "lang", "doc_id")
    pages = langid.page_evidence(table(spark, sf_dir, "pages"))
    out = langid.identify(pages, "text", "declared", "host", "suffix", "page_id", model=model)
    return out.select("page_id", "declared", "host", "suffix", "lang_pred", "posterior", "kept")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.rewritten(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scored(docs, lm.train(docs, least=(1, 1)))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs, keep=("doc_id",))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id, "op2_line_dedup": line_dedup, "op3_lm_scoring": lm_scoring, "op4_quality_rules": quality_rules,
        "op5_token_counts": token_counts, "op6_byte_bpe": byte_bpe, "op7_decontamination": decontamination, "op8_minhash_neardup": minhash_neardup,
        "op9_toxicity": toxicity_scores, "op10_warc": warc_archives, "llm_language_id_pages": language_id_pages, "pipeline": pipeline,
    }


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
WITH l AS (
  SELECT doc_id, x[1] AS pos, x[2] AS line, translate(trim(x[2], {_WHITE}), '{_UP}', '{_LOW}') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(len(a)), a)) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner IS NOT NULL AND doc_id > owner) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM l LEFT JOIN o USING (k) GROUP BY doc_id"""

_WINDOWS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (
  SELECT item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
m AS (SELECT doc_id, k, i, item_id FROM dw JOIN iw USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, g.b FROM r JOIN g ON g.a = r.u),
c AS (SELECT v, min(u) AS root FROM r GROUP BY v)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.v = doc_id"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(x, ((k // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) % 32)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINES, "op7_decontamination": _WINDOWS, "op8_minhash_neardup": _NEAR, "op10_warc": _WARC}
