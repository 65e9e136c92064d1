"""A corpus pipeline: language ID, line de-duplication, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all
but the last return the columns of documents.

Edge cases: documents without text, or of no known language, go in the first stage;
a document all of whose lines are another's stays with an empty text; a row with a
null id is nobody's copy and stays; rows that repeat an id share their component, and
the smallest id's rows all stay; an empty table gives an empty result of the same
columns; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filigraph.llm import bpe, common, decontam, langid, linededup, neardup
from filigraph.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filtered(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.filtered(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.filtered(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.filtered(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_neardup", near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: The stages hold a fitted classifier, MinHash and BPE merges, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    folder = common.work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.saved(docs, f"{folder}/{k}_{name}")
    return docs
