"""Linking persons to external candidates by name distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.functions.names import name_distance

LIMIT, PER_SOURCE = 3, 3
ID_COLUMNS = {"orcid": "orcid", "gscholar": "gscholar_id", "aminer": "aminer_id", "dblp": "dblp_id"}


def top_candidates(candidates: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """The first ``per_source`` candidates (rank) of each person and source."""
    w = Window.partitionBy("person_id", "type").orderBy("rank")
    return candidates.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_source).drop("__n")


def fuzzy_matches(persons: DataFrame, candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Candidates of a person whose name distance is below ``limit``; joined on the person, filtered on the score."""
    joined = candidates.join(persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name")), "person_id")
    return joined.withColumn("distance", name_distance(F.col("person_name"), F.col("name"))).where(F.col("distance") < limit)


def enrich(persons: DataFrame, matches: DataFrame) -> DataFrame:
    """External ids of persons: the first match of each source; ids that are there already stay."""
    first = matches.groupBy("person_id").pivot("type", list(ID_COLUMNS)).agg(F.min_by("id", "rank"))
    found = first.select(F.col("person_id").alias("id"), *(F.col(source).alias(f"__{source}") for source in ID_COLUMNS))
    joined = persons.join(found, "id", "left")
    new = {column: F.coalesce(F.col(column), F.col(f"__{source}")) for source, column in ID_COLUMNS.items()}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in persons.columns))


def parse_aminer(payload: DataFrame, n: int = PER_SOURCE) -> DataFrame:
    """(person_id, type, id, name, rank, affiliations, topics) from JSON answers (person_id, payload)."""
    person = "struct<id:string,name:string,desc:string,desc_zh:string,aff:struct<desc:string,desc_zh:string>,tags:array<struct<t:string>>>"
    found = payload.select("person_id", F.posexplode(F.slice(F.from_json("payload", f"struct<result:array<{person}>>")["result"], 1, n)).alias("rank", "r"))
    return found.select(
        "person_id",
        F.lit("aminer").alias("type"),
        F.col("r.id").alias("id"),
        F.col("r.name").alias("name"),
        "rank",
        F.array(F.coalesce("r.aff.desc", "r.aff.desc_zh", F.lit("Not Available"))).alias("affiliations"),
        F.coalesce(F.transform("r.tags", lambda t: t["t"]), F.array().cast("array<string>")).alias("topics"),
    )


def parse_dblp(payload: DataFrame, n: int = PER_SOURCE) -> DataFrame:
    """The same from XML answers."""
    names, urls = F.xpath("payload", F.lit("//hit/info/author/text()")), F.xpath("payload", F.lit("//hit/info/url/text()"))
    found = payload.select("person_id", F.posexplode(F.slice(F.arrays_zip(names.alias("name"), urls.alias("url")), 1, n)).alias("rank", "r"))
    none = F.array().cast("array<string>")
    return found.select("person_id", F.lit("dblp").alias("type"), F.col("r.url").alias("id"), F.col("r.name").alias("name"), "rank", none.alias("affiliations"), none.alias("topics"))


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
