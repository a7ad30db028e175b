"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component), the component being the smallest node reachable. Nodes without an edge to another are left out.

    Each round is two aggregations with a join; the number of rounds grows with the logarithm of the graph's size.
    No component is ever gathered in one place.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.filter("a != b").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("own"))
        smaller = smaller.select("a", "b").union(smaller.select(F.col("own").alias("a"), "b"))
        edges = written(smaller.filter("a != b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
