"""TF-IDF vectors and Ward clusters of names, exactly and without all pairs.

Vectors have unit length, so a distance below ``threshold`` means a cosine above
1 - threshold^2 / 2, and names without a common term are too far apart.  Ward
linkage is reducible: a merge below the threshold implies two points below it,
so clusters lie inside the components of that neighbour graph, and each
component is clustered alone.  Pairs come from a join on terms; the terms of a
name that alone cannot reach the cosine (a prefix bound on weights, most
frequent terms last) are not joined, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivener.operators.stable import fixed

THRESHOLD = 0.8


def _joined_words(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def terms(names: DataFrame, ngrams: int = 2) -> DataFrame:
    """(id, term, tf): unigrams to ``ngrams`` of lower-case words of two or more characters."""
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    grams = [words]
    for n in range(2, ngrams + 1):
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        grams.append(F.transform(at, _joined_words(words, n)))
    return names.select("id", F.explode(F.concat(*grams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tf_idf(names: DataFrame, ngrams: int = 2) -> DataFrame:
    """(id, term, weight) of unit length: tf * (ln((1 + n) / (1 + df)) + 1)."""
    t = terms(names, ngrams)
    n = names.agg(F.count("*")).scalar()
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    raw = t.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"), "df")


def similar_pairs(vectors: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b, cosine) of pairs a < b with a cosine above ``min_cosine``, by prefix filtering."""
    w = Window.partitionBy("id").orderBy(F.desc("df"), "term")
    # terms whose common part of the vector is shorter than the bound cannot make a pair alone
    suffix = vectors.withColumn("length", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w)))
    prefix = suffix.where(F.col("length") > min_cosine - 1e-9).select("id", "term")
    left = prefix.select(F.col("id").alias("a"), "term")
    right = prefix.select(F.col("id").alias("b"), "term")
    candidates = left.join(right, "term").where("a < b").select("a", "b").distinct()
    x = vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("x"))
    y = vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("y"))
    return candidates.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine")).where(F.col("cosine") > min_cosine)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, by repeated min-label steps with pointer jumps."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).persist()
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("to"), "component")
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        new = hooked.join(jump, "to").select("id", F.least("to", "far").alias("component"), (F.least("to", "far") != F.col("component")).alias("moved"))
        new = fixed(new)
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels


def ward(points: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative Ward clustering, merging the closest pair while closer than ``threshold``."""
    n = len(points)
    label, size = np.arange(n), np.ones(n)
    square = (points * points).sum(1)
    gap = np.maximum(square[:, None] + square - 2 * points @ points.T, 0.0)
    np.fill_diagonal(gap, np.inf)
    while n > 1:
        k = int(gap.argmin())
        i, j = sorted(divmod(k, len(points)))
        d = gap[i, j]
        if not np.sqrt(max(d, 0.0)) < threshold:
            break
        other = np.isfinite(gap[i]) & np.isfinite(gap[j])
        total = size[i] + size[j] + size
        merged = ((size[i] + size) * gap[i] + (size[j] + size) * gap[j] - size * d) / total
        gap[i, other] = gap[other, i] = merged[other]
        gap[j], gap[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        n -= 1
    return label


def cluster_names(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, name, cluster, representative) of distinct names; names without terms form one cluster."""
    vectors = tf_idf(names).persist()
    min_cosine = 1 - threshold * threshold / 2
    linked = components(names.select("id"), similar_pairs(vectors, min_cosine))
    bare = names.select("id").join(vectors.select("id").distinct(), "id", "left_anti")
    first = bare.agg(F.min("id")).first()[0]
    together = bare.select("id", F.lit(first).cast("long").alias("cluster"))
    rows = vectors.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    inputs = linked.join(rows, "id")

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        if len(part) == 1:
            return pd.DataFrame({"id": part["id"], "cluster": part["id"]})
        words = {t: k for k, t in enumerate(sorted({t for ts in part["terms"] for t in ts}))}
        points = np.zeros((len(part), len(words)))
        for i, (ts, ws) in enumerate(zip(part["terms"], part["weights"])):
            points[i, [words[t] for t in ts]] = ws
        ids = part["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": ids[ward(points, threshold)]})

    clusters = inputs.groupBy("component").applyInPandas(split, "id long, cluster long").unionByName(together)
    joined = names.join(clusters, "id")
    least = joined.groupBy("cluster").agg(F.min("name").alias("representative"))
    return joined.join(least, "cluster").select("id", "name", "cluster", "representative")


def cluster_members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("members"))


def consolidate(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct (conf_id, person, org, role) with every organization replaced by its representative."""
    reps = clusters.select(F.col("name").alias("org"), "representative")
    return facts.join(reps, "org").select("conf_id", "person", F.col("representative").alias("org"), "role").distinct()


def save_clusters(clusters: DataFrame, path: str) -> None:
    """The cluster map as a table, in place of a pickled object."""
    clusters.select("id", "name", "cluster", "representative").write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, name string, cluster long, representative string").parquet(path)
