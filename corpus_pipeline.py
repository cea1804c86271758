"""A corpus pipeline: five stages over ``documents``, each written before the next reads it.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame.  All but the last return the columns of
documents; the last returns each remaining document's token ids as digests.

Cases: null, empty and blank texts fail the quality rules and go there.  Rows
without an id, and rows of one id, are documents of their own text in every
stage but line dedup, which counts them as one document of several rows; of equal rows near-dedup keeps all or
none.  An empty table gives an empty table; columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivener.llm import bpe, decontam, linededup, minhash, quality
from scrivener.llm.common import materialize, table
from scrivener.llm.queries import ERROR_RATE, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, quality.fit_crf(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(docs, linededup.line_bitmaps(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), error_rate=ERROR_RATE)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# quality, near-duplicate and edit-distance stages have no SQL form
ORACLE_SQL = None
