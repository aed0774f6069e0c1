"""Corpus pipeline: quality rules, near-duplicate join, PII redaction, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents. A stage's decisions reach the documents by their key. What is decided for each key is broadcast where it is
few rows and joined by a shuffle where it is not.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, mixing, ngram_jaccard, pii, quality_rules
from tapeloom.llm.common import if_small, load, small_batches, stored, unused, with_unique_key

#: Percent and words of a shingle of the second stage. Those of op7_ngram_jaccard bind that query alone.
NEAR_PERCENT, NEAR_WIDTH = 80, 5


def _without(rows: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key isn't in gone, a table of one column."""
    own = unused(rows, "_k")
    return rows.join(if_small(stored(gone.toDF(own), "gone")), F.col(key) == F.col(own), "left_anti").select(*columns)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and from the others the lines above the limit; n_chars follows the text."""
    return _recounted(quality_rules.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest key stays, and every document without words."""
    rows, key = with_unique_key(docs)
    others = ngram_jaccard.join(rows, percent=NEAR_PERCENT, width=NEAR_WIDTH, key=key).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return _without(rows, key, others, docs.columns)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return _recounted(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes its words, in the order of the mix's slots; one that is taken in part stays whole."""
    rows, key = with_unique_key(docs)
    return mixing.in_order(rows, key=key).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for each document of the mix."""
    return bpe.round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), *bpe.public_vocabulary())


def _set_up(stage):
    @wraps(stage)
    def run(spark, docs, sf_dir):
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _set_up(stage)) for name, stage in (("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", redaction), ("mixing sources", mix), ("byte-level BPE", encoding))]

#: The trees of the third stage aren't SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
