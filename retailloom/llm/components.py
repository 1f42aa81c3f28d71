"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.session import materialise


def _star(edges: DataFrame, large: bool, stored: bool) -> DataFrame:
    """Large: every larger neighbour of a node moves to the smallest of its neighbourhood. Small:
    the node and its smaller neighbours do."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if stored:
        least = materialise(least, "least")
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its smallest
    node. Nulls and loops are left out. The edges of each round are stored, which cuts lineage.

    ``stored`` also stores the smallest neighbours before they are joined: adaptive execution splits
    a hub between two scans, but not beside an aggregation. It takes two more jobs a round.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while True:
        edges = materialise(_star(_star(edges, True, stored), False, stored), "edges")
        state = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if state == before or not state["n"]:
            break
        before = state
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("component").alias("node"), "component").distinct()
    return pairs.unionByName(roots)
