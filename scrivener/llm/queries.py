"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivener.llm import bpe, decontam, licenses, linededup, lmscore, minhash, oracles, quality, secrets, suffixes, urls
from scrivener.llm.common import table


# Share of an item's characters that may be edited in a leak
ERROR_RATE = 0.10


def tokenizer_path() -> str:
    """The published word-level vocabulary; an installed file, never copied."""
    import public_tokenizers

    return os.environ.get("SCRIVENER_TOKENIZER", public_tokenizers.path("word_bpe_49k.json"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digest_lines(docs, linededup.line_bitmaps(docs))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_secrets(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_passages(suffixes.dedup_passages(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.page_labels(pages))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit_crf(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents only: a row for each document and the item it holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_rate=ERROR_RATE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_license_scans, op3_line_dedup, op4_lm_scoring, op5_secret_scans, op6_suffix_dedup, op7_bpe, op8_url_filters, op9_quality_rules, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
