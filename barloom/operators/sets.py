"""Set operations, de-duplication, top rows and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.blocks import Grid, row_numbers


def union_rows(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column missing on one side is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedup(df: DataFrame, keys: Sequence[str], order: Column, keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ``order``. Aggregates before the shuffle, so many copies
    of one key never meet in one task."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def column_symmetric_diff(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in ``a`` and only in ``b``."""
    return [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]


def key_symmetric_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on exactly one side, with the side."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return left.join(right, list(keys), "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        *keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def ordered_union(lists: Sequence[DataFrame], item: str, rank: str, limit: int) -> DataFrame:
    """Union of ranked lists: earlier lists first, first occurrence wins, cut at ``limit``.

    Each input is a short ranked list (a top-k result), so the final ranking is small.
    """
    tagged = [f.select(F.col(item), F.lit(i).alias("_list"), F.col(rank).alias("_rank")) for i, f in enumerate(lists)]
    firsts = union_rows(*tagged).groupBy(item).agg(F.min(F.struct("_list", "_rank")).alias("_at"))
    top = firsts.orderBy("_at", item).limit(limit)
    return top.select(item, F.row_number().over(Window.orderBy("_at", item)).alias("position"))


def overlap_merge(old: DataFrame, new: DataFrame, g: Grid, revisable: int = 24) -> DataFrame:
    """Merge a newer fetch into stored rows: per cell, old rows except the last ``revisable`` of each
    series win, then the new value, then the old one."""
    cols = [c for c in old.columns if c not in (*g.keys, g.ts)]
    numbered = row_numbers(old, g, "_rn", "_n").withColumn("_final", F.col("_rn") <= F.col("_n") - revisable)
    joined = numbered.alias("o").join(new.alias("n"), [*g.keys, g.ts], "full_outer")
    return joined.select(*g.keys, g.ts, *[
        F.coalesce(F.when(F.col("o._final"), F.col(f"o.{c}")), F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols
    ])


def tail_rows(df: DataFrame, g: Grid, n: int, skip: int = 0) -> DataFrame:
    """The last ``n`` rows of each series, without the newest ``skip`` of them.

    Up to 1000 rows Spark cuts each input partition to n rows per series before the shuffle; longer
    tails use counted row numbers.
    """
    if n <= 1000:
        w = Window.partitionBy(*g.keys).orderBy(F.col(g.ts).desc())
        return df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= n) & (F.col("_rn") > skip)).drop("_rn")
    back = F.col("_n") - F.col("_rn") + 1
    return row_numbers(df, g, "_rn", "_n").where((back <= n) & (back > skip)).drop("_rn", "_n")


def tail_share(df: DataFrame, g: Grid, share: float) -> DataFrame:
    """The newest ``share`` of the rows of each series (whole rows, rounded down)."""
    out = row_numbers(df, g, "_rn", "_n")
    return out.where(F.col("_rn") > F.col("_n") - F.floor(F.col("_n") * share)).drop("_rn", "_n")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group in ``order``, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def batches(df: DataFrame, g: Grid, steps: int, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``steps`` rows of each series, numbered from 0."""
    return row_numbers(df, g, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / steps)).drop("_rn")
