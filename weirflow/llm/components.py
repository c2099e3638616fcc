"""Connected components of a graph given as a table of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node it reaches.

    Alternating large-star and small-star steps; each node's neighbours only meet the smallest of them (an aggregate
    with partial sums and a join in which the nodes with most neighbours are broadcast), so no neighbourhood is
    gathered. Every step is written to the shared folder. Loops and repeated edges are allowed; nulls are left out. It
    ends when a step changes nothing, after about as many steps as the logarithm of the longest path; the first for
    stars around their smallest nodes.
    """
    edges = materialize(edges.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state() -> Row:
        return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    before = state()
    if not before["n"]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def with_least(rows: DataFrame) -> DataFrame:
        """Each edge with the smallest neighbour of its first node."""
        least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        return join_weighted(rows, materialize(least, "stars"), "a", "degree")

    while True:
        # large star: the larger neighbours of a node, all linked to its smallest
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours of a node and itself, all linked to the smallest
        joined = with_least(materialize(large, "large-stars"))
        own = joined.select("a", F.col("m").alias("b"))
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()
        edges = materialize(small, "edges")
        after = state()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
