"""Shared parts of the corpus operators: null-safe text, words, row keys, distributed ranks.

Internal columns start with ``_b_``; operators select what they need first, so other columns of the input, whatever their
names, do not meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stage

SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["SPACE", "SPACE_CHARS", "ascii_lower", "row_key", "ranked", "stage", "text_of", "words"]


def text_of(c: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: Column) -> list[Column]:
    """128 bits that stand for the values (nulls included): equal rows share them, different rows do not."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*marked).alias("_b_k1"), F.xxhash64(F.lit(1), *marked).alias("_b_k2")]


def ranked(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Number the rows in ``order`` over the whole table, from ``first``, without one task that sees them all.

    Range partitions are sorted and counted; each partition starts after the rows of those before it (one row per
    partition is broadcast). Ties are numbered in no fixed order.
    """
    w = Window.partitionBy("_b_part").orderBy(*order)
    parts = stage(df.repartitionByRange(*order).withColumn("_b_part", F.spark_partition_id()), "ranked")
    offsets = parts.groupBy("_b_part").agg(F.count("*").alias("_b_n"))
    offsets = offsets.select("_b_part", (F.sum("_b_n").over(Window.orderBy("_b_part")) - F.col("_b_n")).alias("_b_before"))
    out = parts.join(F.broadcast(offsets), "_b_part")
    return out.withColumn(name, F.col("_b_before") + F.row_number().over(w) - 1 + first).drop("_b_part", "_b_before")
