"""Schemas of the base tables: StructTypes in place of declared tables and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(ddl: str) -> str:
    return " ".join(ddl.split())


DDL = {
    "conferences": "id BIGINT NOT NULL, series STRING NOT NULL, title STRING NOT NULL, url STRING, timetable MAP<STRING,STRING>, year INT, wayback_url STRING, categories ARRAY<STRING>, accessible STRING, crawled STRING",
    "conference_pages": "id BIGINT NOT NULL, conf_id BIGINT NOT NULL, url STRING NOT NULL, html STRING, content_type STRING, processed STRING",
    "journals": "id BIGINT NOT NULL, title STRING NOT NULL, publisher STRING NOT NULL, url STRING",
    "lexicon": "type STRING NOT NULL, content STRING NOT NULL",
    "journal_lines": "line_id BIGINT NOT NULL, publisher STRING NOT NULL, title STRING NOT NULL, line STRING NOT NULL",
    "tagged_lines": "line_id BIGINT NOT NULL, publisher STRING NOT NULL, title STRING NOT NULL, line STRING NOT NULL",
    "crawled": "seq BIGINT NOT NULL, publisher STRING NOT NULL, title STRING NOT NULL, role STRING NOT NULL, name STRING NOT NULL, affiliation STRING NOT NULL",
    "page_lines": "id BIGINT NOT NULL, page_id BIGINT NOT NULL, line_num INT, line_text STRING, tag STRING, indentation INT, label STRING, dl_prediction STRING, svm_prediction STRING",
    "persons": "id BIGINT NOT NULL, name STRING",
    "organizations": "id BIGINT NOT NULL, name STRING, location STRING",
    "person_organization": "affiliation_id BIGINT NOT NULL, org_id BIGINT, person_id BIGINT",
    "person_role": "role_id BIGINT NOT NULL, role_type STRING NOT NULL, doc_type STRING NOT NULL, doc_id BIGINT NOT NULL, person_id BIGINT",
    "consolidated_persons": "id BIGINT, name STRING, org_id BIGINT, orcid STRING, gscholar_id STRING, aminer_id STRING, dblp_id STRING, score DOUBLE",
    "candidates": "person_id BIGINT, type STRING, id STRING, name STRING, affiliations ARRAY<STRING>, topics ARRAY<STRING>",
}

#: Columns that are unique together; Spark does not enforce them, the sinks in ``operators.dml`` do.
UNIQUE = {
    "conferences": [("title",)],
    "conference_pages": [("url",)],
    "journals": [("title",), ("url",)],
    "lexicon": [("content",)],
    "journal_lines": [("line",)],
    "tagged_lines": [("line",)],
    "person_organization": [("org_id", "person_id")],
    "consolidated_persons": [("name", "org_id")],
}


def schema(name: str) -> StructType:
    return _parse_datatype_string(_schema(DDL[name]))


def empty(spark: SparkSession, name: str) -> DataFrame:
    """The table before anything is stored."""
    return spark.createDataFrame([], schema(name))
