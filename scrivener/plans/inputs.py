"""The driver's tables seen as the engine's entities, in DataFrames and as SQL.

persons = customer, conferences = supplier, journals = part, organizations =
nation, roles = lineitem with the order's priority as role, page lines = events,
journal lines = lines of documents, tagged lines = turns of conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.plans.registry import table

ROLES = {"1-URGENT": "General Chair", "2-HIGH": "Senior PC Member", "3-MEDIUM": "PC Member", "4-NOT SPECIFIED": "Program Chair", "5-LOW": "Reviewer"}
LABELS = {"signup": "Role-Label", "click": "Person", "purchase": "Affiliation", "view": "Complex"}

_ROLE_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE 'Member' END"
_LABEL_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'Undefined' END"

ROLES_SQL = f"""
roles AS (
  SELECT 'conference' AS doc_type, CAST(l_suppkey AS BIGINT) AS doc_id, {_ROLE_CASE} AS role_type, CAST(o_custkey AS BIGINT) AS person_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
JOURNAL_ROLES_SQL = f"""
journal_roles AS (
  SELECT 'journal' AS doc_type, CAST(l_partkey AS BIGINT) AS doc_id, {_ROLE_CASE} AS role_type, CAST(o_custkey AS BIGINT) AS person_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAGE_LINES_SQL = f"""
page_lines AS (
  SELECT user_id AS conf_id, CAST(1 AS BIGINT) AS page_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS num,
    CAST(floor(value) AS BIGINT) % 40 AS indent, {_LABEL_CASE} AS label,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(upper(substr(event_type, 1, 1)), substr(event_type, 2), ' Name', CAST(event_id AS VARCHAR)) END AS line_text
  FROM events)"""
JOURNAL_LINES_SQL = r"""
journal_lines AS (
  SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, source AS publisher, lang AS title, line
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents))"""
TOKENS_SQL = r"""
tokens AS (
  SELECT sent, CAST(pos - 1 AS BIGINT) AS pos, word,
    CASE WHEN length(word) >= 8 THEN 'S-ORG' WHEN regexp_matches(word, '^[A-Z]') THEN 'S-PER' WHEN word IN ('the', 'of', 'and') THEN 'ROLE' ELSE 'O' END AS tag
  FROM (SELECT conv_id * 1000 + turn AS sent, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM conversations))"""


def _mapped(column: str, mapping: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def roles(spark: SparkSession, sf_dir: str, doc_type: str = "conference") -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey" if doc_type == "conference" else "l_partkey").cast("long").alias("doc_id"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("person_id"), _mapped("o_orderpriority", ROLES, "Member").alias("role_type"))
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit(doc_type).alias("doc_type"), "doc_id", "role_type", "person_id")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    text = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substr(event_type, 2)"), F.lit(" Name"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conf_id"), F.lit(1).cast("long").alias("page_id"), F.col("event_id").alias("id"), num.alias("num"), (F.floor("value").cast("long") % 40).alias("indent"), _mapped("event_type", LABELS, "Undefined").alias("label"), text.alias("line_text")
    )


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("publisher"), F.col("lang").alias("title"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select("doc_id", F.col("pos").cast("long").alias("pos"), "publisher", "title", "line")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent"), F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    tag = F.when(F.length("word") >= 8, "S-ORG").when(F.rlike("word", F.lit("^[A-Z]")), "S-PER").when(F.col("word").isin("the", "of", "and"), "ROLE").otherwise("O")
    return words.select("sent", F.col("pos").cast("long").alias("pos"), "word", tag.alias("tag"))
