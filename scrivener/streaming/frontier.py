"""Crawl frontier: what is still to fetch and to process, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scrivener.functions.web import absolute_url, classify_link, links_of, same_domain


def unsaved(links: DataFrame, saved: DataFrame, key: str = "url") -> DataFrame:
    return links.join(saved.select(key), key, "left_anti")


def relevant_links(pages: DataFrame) -> DataFrame:
    """(page_id, home, url, text, kind) of links that stay on the site and name committees or speakers; ``url`` is absolute."""
    found = pages.select("page_id", F.col("url").alias("home"), F.explode(links_of(F.col("html"))).alias("a"))
    out = found.select("page_id", "home", F.col("a.url").alias("url"), F.col("a.text").alias("text"))
    kept = out.withColumn("kind", classify_link(F.col("text"), F.col("url"))).where(same_domain(F.col("home"), F.col("url")) & (F.col("kind") != "unk"))
    return kept.select("page_id", "home", absolute_url(F.col("home"), F.col("url")).alias("url"), "text", "kind")


def link_actions(links: DataFrame, rules: dict[str, list[str]], url_col: str = "url") -> DataFrame:
    """Links with the first action one of whose fragments they contain; others are dropped."""
    action = F.lit(None).cast("string")
    for name, parts in reversed(rules.items()):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(url_col, F.lit(part))
        action = F.when(hit, name).otherwise(action)
    return links.withColumn("action", action).where("action is not null")


def seeds(urls: DataFrame, constant: list[str]) -> DataFrame:
    """(url, status, error) of the start pages: those of a table and constant ones."""
    more = urls.sparkSession.createDataFrame([(u,) for u in constant], "url string")
    return urls.select("url").unionByName(more).select("url", F.lit("seed").alias("status"), F.lit(None).cast("string").alias("error"))


def with_status(fetched: DataFrame) -> DataFrame:
    """``fetched`` (http_status, archived) with what the answer makes of the page; the fetch itself is outside the engine."""
    return fetched.withColumn("status", F.when(F.coalesce(F.col("http_status"), F.lit(404)) != 200, "Error").when(F.col("archived"), "Wayback Accessible").otherwise("Accessible URL"))


def walk(pages: DataFrame, links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(url, hop) reachable from ``seeds`` (url) over ``links`` (src, dst) within ``hops``; pages fetched once."""
    seen = seeds.select("url").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        step = front.join(links, front["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        front = step.join(seen.select("url"), "url", "left_anti").join(pages.select("url"), "url", "left_semi").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def next_batch(pages: DataFrame, done: DataFrame, size: int | None = None) -> DataFrame:
    """Pages whose id is not among the finished ones; a failed page is there again until it is finished."""
    left = pages.join(done.where("status = 'Yes'").select("page_id"), "page_id", "left_anti")
    return left if size is None else left.orderBy("page_id").limit(size)


def stream_pages(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """New page files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_seen(pages: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Pages once by url; state older than ``delay`` behind the latest time is dropped."""
    return pages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url"])


def process_stream(pages: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Lines of unprocessed pages, appended; an interrupted run goes on from its checkpoint."""
    from scrivener.sources.readers import lines_of_pages

    return lines_of_pages(pages.where(~F.col("processed").eqNullSafe("Yes"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
