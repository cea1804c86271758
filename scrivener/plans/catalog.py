"""All registered queries of the engine, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import rank
from scrivener.plans import analytic, inputs, relational  # noqa: F401  (their queries register on import)
from scrivener.plans.registry import ORACLES, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite PageRank: the highest-scored persons and venues."""
    scores = rank.page_rank(rank.weighted_edges(inputs.roles(spark, sf_dir)))
    return rank.top(scores, 20).withColumn("pr_score", F.round("pr_score", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
