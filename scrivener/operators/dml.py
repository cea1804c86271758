"""Writes as DataFrame-to-DataFrame steps: upserts, get-or-create ids, updates, ordered sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.operators.stable import fixed


def upsert(table: DataFrame, rows: DataFrame, keys: list[tuple[str, ...]], order: str) -> DataFrame:
    """Last writer wins on any of the unique ``keys``; ``order`` is the write order inside ``rows``.

    ``table`` and ``rows`` have the same columns but ``order``; old rows come before all new ones.
    A row goes if a later one shares any of its keys, whether or not that one
    goes too; null keys never collide; equal ``order`` values rank by their columns.
    """
    out = table.withColumn("__at", F.lit(-1).cast("long")).unionByName(rows.withColumn("__at", F.col(order).cast("long")).select(*table.columns, "__at"))
    stays = F.lit(True)
    for k, key in enumerate(keys):
        out = out.withColumn(f"__n{k}", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__at"), *table.columns)))
        stays = stays & ((F.col(f"__n{k}") == 1) | F.greatest(*(F.col(c).isNull() for c in key), F.lit(False)))
    return out.where(stays).select(*table.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """First writer wins on ``key``; rows with a null key are always stored."""
    null = F.greatest(*(F.col(c).isNull() for c in key), F.lit(False))
    fresh = rows.join(table.select(*key), key, "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where((F.col("__n") == 1) | null)
    return table.unionByName(first.select(*table.columns))


def numbered(df: DataFrame, order: list[Column | str], name: str = "id", start: int = 1) -> DataFrame:
    """Dense numbers in ``order`` without one task for all rows.

    Range partitions are sorted, counted, and each gets the sum of the counts
    before it; the counts, one a partition, are the only rows brought together.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # ranges come from a sample: both uses below have to see the same ones
    placed = fixed(df.repartitionByRange(int(parts), *order).withColumn("__part", F.spark_partition_id()))
    local = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    return local.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__n") + F.col("__before") + start - 1).cast("long").alias(name))


def get_or_create(rows: DataFrame, key: list[str], order: str, known: DataFrame | None = None) -> DataFrame:
    """(key..., id) of all keys: known ids stay, new keys are numbered in first-seen order behind them."""
    seen = rows.groupBy(*key).agg(F.min(order).alias("__first"))
    if known is None:
        return numbered(seen, ["__first", *key]).select(*key, "id")
    fresh = seen.join(known.select(*key), key, "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = numbered(fresh, ["__first", *key]).select(*key, (F.col("id") + top).alias("id"))
    return known.select(*key, "id").unionByName(new)


def update(table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``table`` with the non-null values of ``changes`` (one row a key)."""
    new = changes.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def replace_group(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the groups that ``rows`` rewrites are dropped first."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def add_column(table: DataFrame, name: str, kind: str) -> DataFrame:
    """Null column, unless it is there already."""
    return table if name in table.columns else table.withColumn(name, F.lit(None).cast(kind))


def ordered_split(rows: DataFrame, order: list[str], train: int, val: int) -> DataFrame:
    """The first floor(n * train / (train + val)) rows in ``order`` are train, the others val."""
    n = numbered(rows, order, "__n")
    cut = F.floor(rows.agg(F.count("*")).scalar() * train / (train + val))
    return n.withColumn("split", F.when(F.col("__n") <= cut, "train").otherwise("val")).drop("__n")


def tsv_text(columns: list[str]) -> Column:
    """One unquoted line; tabs, line ends and backslashes escaped."""

    def escape(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("\\", "\\\\"), ("\t", "\\\t"), ("\n", "\\\n")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    return F.concat_ws("\t", *(escape(c) for c in columns))


def write_text(df: DataFrame, path: str, line: Column, split: str | None = None, mode: str = "overwrite") -> None:
    """Text files, one folder for each value of ``split``."""
    out = df.select(line.alias("value"), *([split] if split else []))
    writer = out.write.mode(mode)
    (writer.partitionBy(split) if split else writer).text(path)


def normalise_conferences(conferences: DataFrame) -> dict[str, DataFrame]:
    """Series, topics and their links from denormalised conferences (id, series, categories)."""
    series = get_or_create(conferences.select(F.trim("series").alias("title"), F.col("id").alias("at")), ["title"], "at")
    topics = conferences.select(F.col("id").alias("conf_id"), F.explode("categories").alias("topic"))
    topic_ids = get_or_create(topics, ["topic"], "conf_id")
    links = topics.join(topic_ids, "topic").select("conf_id", F.col("id").alias("topic_id")).distinct()
    named = conferences.withColumn("__title", F.trim("series")).join(series.select(F.col("title").alias("__title"), F.col("id").alias("series_id")), "__title").drop("__title", "categories", "series")
    return {"series": series, "topics": topic_ids, "conference_topics": links, "conferences": named}


def load_crawled(crawled: DataFrame, journals: DataFrame) -> dict[str, DataFrame]:
    """Persons, organizations, affiliations and roles from crawled facts (seq, title, role, name, affiliation).

    Persons and organizations are unique by non-empty name; only a person's first
    fact affiliates it; every fact with a person adds a role.
    """
    named = crawled.where("name <> ''")
    persons = get_or_create(named, ["name"], "seq")
    orgs = get_or_create(crawled.where("affiliation <> ''").select(F.col("affiliation").alias("name"), "seq"), ["name"], "seq")
    first = named.groupBy("name").agg(F.min_by("affiliation", "seq").alias("affiliation")).where("affiliation <> ''")
    affiliated = first.join(persons.withColumnRenamed("id", "person_id"), "name").join(orgs.select(F.col("name").alias("affiliation"), F.col("id").alias("org_id")), "affiliation")
    roles = named.join(persons.withColumnRenamed("id", "person_id"), "name").join(journals.select("title", F.col("id").alias("doc_id")), "title", "left")
    return {
        "persons": persons,
        "organizations": orgs,
        "person_organization": affiliated.select("person_id", "org_id"),
        "person_role": roles.select("seq", F.col("role").alias("role_type"), F.lit("journal").alias("doc_type"), "doc_id", "person_id"),
    }
