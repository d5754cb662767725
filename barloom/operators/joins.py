"""Joins on the time axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators.blocks import Grid, bounded
from barloom.operators.windows import back_fill


def align(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join frames on their keys: ``full_outer`` keeps all rows, ``inner`` the common ones."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), how)
    return out


def coalesce_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cell the first non-null of ``a`` and ``b``; union of keys and of columns."""
    cols = [c for c in a.columns if c not in keys] + [c for c in b.columns if c not in keys and c not in a.columns]
    joined = a.alias("a").join(b.alias("b"), list(keys), "full_outer")

    def cell(c: str):
        sides = [F.col(f"{s}.{c}") for s, f in (("a", a), ("b", b)) if c in f.columns]
        return F.coalesce(*sides).alias(c)
    return joined.select(*keys, *[cell(c) for c in cols])


def pivot_peers(df: DataFrame, peers: Sequence[str], cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """One column block per peer series (``<peer>_<column>``), one row per time.

    The peer list is explicit, so no extra job looks for it; values are combined before the shuffle.
    """
    return df.where(F.col("series").isin(list(peers))).groupBy(ts).agg(*[
        F.first(F.when(F.col("series") == p, F.col(c)), ignorenulls=True).alias(f"{p}_{c}") for p in peers for c in cols
    ])


def last_prices(df: DataFrame, ts: str = "ts", price: str = "price") -> DataFrame:
    """Last known price of each series."""
    return df.groupBy("series").agg(F.max_by(price, F.when(F.col(price).isNotNull(), F.col(ts))).alias("last_price"))


def with_parameters(df: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """Every row for every parameter set. The sets are literals of a fixed list: rows are multiplied
    inside the task, without a join."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in grid])
    return df.withColumn("param", F.explode(sets))


def snapshot_pairs(snapshots: DataFrame, keys: Sequence[str], distance: int, cols: Sequence[str], tail: int) -> DataFrame:
    """Absolute difference of a snapshot and the one ``distance`` seconds later on their common rows.

    Input: ``(keys, snapshot_ts, ts, cols)``. The last ``tail`` common rows of a pair are kept and
    numbered from 0; a snapshot holds a fixed number of rows, so a pair is a small unit.
    """
    old, new = snapshots.alias("o"), snapshots.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in (*keys, "ts")]
    later = F.col("n.snapshot_ts") == F.col("o.snapshot_ts") + F.expr(f"interval '{distance}' second")
    pairs = old.join(new, [*same, later]).select(
        *[F.col(f"o.{k}") for k in keys], F.col("o.snapshot_ts"), F.col("o.ts"),
        *[F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")).alias(c) for c in cols])
    w = Window.partitionBy(*keys, "snapshot_ts")
    back = F.row_number().over(w.orderBy(F.col("ts").desc()))
    kept = pairs.withColumn("_back", back).where(F.col("_back") <= tail)
    return kept.withColumn("pos", F.row_number().over(w.orderBy("ts")) - 1).drop("_back")


def join_late(df: DataFrame, slow: DataFrame, g: Grid, cols: Sequence[str]) -> DataFrame:
    """Join a slow source one bar late and fill its gaps backward."""
    joined = df.join(slow, [*g.keys, g.ts], "left")
    late = bounded(joined, g, lambda w: {c: F.lag(c).over(w) for c in cols}, back=1)
    return back_fill(late, g, cols)
