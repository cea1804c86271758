"""Weighted bipartite PageRank of venues and persons, and one-shot organization scores.

Node keys carry their kind, so ids of different kinds never collide.  The
reference updates in place with venues first; on a bipartite graph that equals
the alternating two-phase update here: venues from the last persons, then
persons from the new venues.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions.names import role_score
from scrivener.operators.stable import fixed

DAMPING, ITERATIONS = 0.85, 30
HOT_EDGES, HOT_NODES = 1_000_000, 4096


def weighted_edges(roles: DataFrame, literal_scores: bool = True) -> DataFrame:
    """(doc_type, doc_id, person_id, to_person, to_venue) from (doc_type, doc_id, role_type, person_id).

    ``to_person``: the role's share of its venue's scores, summed over repeated
    roles; ``to_venue``: one over the person's number of roles, summed likewise.
    """
    scored = roles.select("doc_type", "doc_id", "person_id", role_score(F.col("doc_type"), F.col("role_type"), literal_scores).alias("score"))
    pairs = scored.groupBy("doc_type", "doc_id", "person_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    # sums are made a task at a time, so that no window holds all edges of a popular node
    venue = pairs.groupBy("doc_type", "doc_id").agg(F.sum("score").alias("all_scores"))
    person = pairs.groupBy("person_id").agg(F.sum("n").alias("all_roles"))
    joined = pairs.join(venue, ["doc_type", "doc_id"]).join(person, "person_id")
    return joined.select("doc_type", "doc_id", "person_id", (F.col("score") / F.col("all_scores")).alias("to_person"), (F.col("n") / F.col("all_roles")).alias("to_venue"))


def hot_nodes(edges: DataFrame, keys: list[str], least: int = HOT_EDGES) -> DataFrame | None:
    """(keys, buckets) of the nodes with more than ``least`` edges and more than one in ``HOT_NODES`` of all: at most ``HOT_NODES`` rows; None without any."""
    limit = max(least, -(-edges.count() // HOT_NODES))
    found = edges.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    found = fixed(found.select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("buckets")))
    return None if found.isEmpty() else found


def _edge_bucket(edges: DataFrame, hot: DataFrame | None, keys: list[str], others: list[str]) -> DataFrame:
    """Edges with the bucket of their node that their other end falls in; 0 for nodes that are not hot."""
    if hot is None:
        return edges.withColumn("bucket", F.lit(0))
    bucket = F.pmod(F.xxhash64(*others), F.coalesce("buckets", F.lit(1))).cast("int")
    return edges.join(F.broadcast(hot), keys, "left").withColumn("bucket", bucket).drop("buckets")


def _node_buckets(values: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """A row of every node for each of its buckets."""
    if hot is None:
        return values.withColumn("bucket", F.lit(0))
    buckets = F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - 1)
    return values.join(F.broadcast(hot), keys, "left").withColumn("bucket", F.explode(buckets)).drop("buckets")


def inbound(edges: DataFrame, persons: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """(doc_type, doc_id, total): what the persons (person_id, p) of a venue give to it; ``dealt``: further columns to meet on."""
    return edges.join(persons, ["person_id", *dealt]).groupBy("doc_type", "doc_id").agg(F.sum(F.col("to_venue") * F.col("p")).alias("total"))


def page_rank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, checkpoint_every: int = 6, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(kind, id, pr_score) of all nodes of ``edges``; the start is 1, the update is not divided by the number of nodes.

    The edges of a node with more than ``hot_edges`` of them are dealt to several tasks.
    """
    # kept by each end, so that a half-step moves one partial sum a node and task, never the edges
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
    person, venue = ["person_id"], ["doc_type", "doc_id"]
    hot_persons, hot_venues = hot_nodes(edges, person, hot_edges), hot_nodes(edges, venue, hot_edges)
    by_person = _edge_bucket(edges.select(*venue, *person, "to_venue"), hot_persons, person, venue).repartition(parts, *person, "bucket").persist(StorageLevel.MEMORY_AND_DISK)
    by_venue = _edge_bucket(edges.select(*venue, *person, "to_person"), hot_venues, venue, person).repartition(parts, *venue, "bucket").persist(StorageLevel.MEMORY_AND_DISK)
    rest = F.lit(1 - damping)
    persons = by_person.select("person_id").distinct().withColumn("p", F.lit(1.0))
    venues = None
    for k in range(1, iterations + 1):
        venues = inbound(by_person, _node_buckets(persons, hot_persons, person), ("bucket",)).select("doc_type", "doc_id", (rest + damping * F.col("total")).alias("v"))
        if k == iterations:  # read by the result and by the last persons
            venues = venues.persist(StorageLevel.MEMORY_AND_DISK)
        persons = by_venue.join(_node_buckets(venues, hot_venues, venue), [*venue, "bucket"]).groupBy("person_id").agg((rest + damping * F.sum(F.col("to_person") * F.col("v"))).alias("p"))
        if k % checkpoint_every == 0 and k < iterations:
            persons = fixed(persons)
    return venues.select(F.col("doc_type").alias("kind"), F.col("doc_id").alias("id"), F.col("v").alias("pr_score")).unionByName(persons.select(F.lit("person").alias("kind"), F.col("person_id").alias("id"), F.col("p").alias("pr_score")))


def organization_scores(orgs: DataFrame, affiliations: DataFrame, persons: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(id, pr_score): 1 - d plus d times the scores of affiliated persons; without persons 1 - d."""
    sums = affiliations.join(persons.select(F.col("id").alias("person_id"), "pr_score"), "person_id").groupBy("org_id").agg(F.sum("pr_score").alias("s"))
    return orgs.join(sums, orgs["id"] == sums["org_id"], "left").select(orgs["id"], (1 - damping + damping * F.coalesce("s", F.lit(0.0))).alias("pr_score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("pr_score"), "kind", "id").limit(k)
