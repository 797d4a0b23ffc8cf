"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link greater neighbours to the least one; small star: link the node and its lesser ones to it."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("n", "m")
    if not large:
        both = both.filter("m < n")
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("l"))
    linked = both.join(least, "n")
    if large:
        return linked.filter("m > n").select(F.col("m").alias("a"), F.col("l").alias("b")).filter("a != b").distinct()
    own = least.select(F.col("n").alias("a"), F.col("l").alias("b"))
    rest = linked.select(F.col("m").alias("a"), F.col("l").alias("b"))
    return own.union(rest).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): the least node of its component. Logarithmic number of rounds."""
    current = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(current)
    while True:
        current = materialize(_star(_star(current, True), False), "edges")
        after = mark(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(current.select("b", "b")).distinct()
