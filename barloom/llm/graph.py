"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

Every step is written to the shared folder, so plans stay short and a lost executor costs a re-read. A hot node (the centre of a
large group) is reduced by a partial ``min`` and met again in a plain join, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): the least node of each component, for every node that has an edge to another node."""
    e = stage(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    while (now := _checksum(e)) != before:
        before = now
        e = stage(_star(stage(_star(e, True), "large"), False), "small")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
