"""Connected components of an edge table, by large-star and small-star rounds.

Each round is two aggregations and two joins on the edges, so a hot vertex is combined before the shuffle and its join
can be split; nothing is collected but one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) with a > b. Large: every neighbour above the vertex moves to the vertex's least
    neighbour. Small: the vertex and its smaller neighbours move to the least of them."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each vertex of ``links`` (a, b): the smallest id that can be reached. Vertices without a
    link are not listed."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = written(edges, "edges"), None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        found = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (found["n"], found["x"]) == mark:
            break
        mark = (found["n"], found["x"])
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
