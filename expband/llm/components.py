"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expband.llm import shared


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours, and itself, to its least neighbour.

    The least neighbour comes from an aggregate with map-side combine, so a node with very many
    links costs one row per task; the join back can be split by adaptive execution.
    """
    both = edges.select("u", "v")
    if larger:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, F.col("u") == F.col("node"))
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            moved.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node that has a link.

    Large-star and small-star steps alternate until nothing changes; each round is written to the
    shared folder, so lineage stays short. Only a count and a checksum come to the driver.
    """
    edges = shared.written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), name)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
        edges = shared.written(_star(_star(edges, True), False), name)
    raise RuntimeError("the links did not settle; raise most_rounds")
