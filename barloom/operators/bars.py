"""Ticks to bars, bars to coarser bars, and the full time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.time import bucket_start, epoch_seconds, from_epoch, tie_order
from barloom.operators.blocks import Grid, bounded, running
from barloom.session import stage

OHLC = ["open", "high", "low", "price"]


def bars(ticks: DataFrame, step: int = 3600) -> DataFrame:
    """Tumbling OHLCV bars of ``step`` seconds; open and last price are ordered by (ts, event_id).

    All aggregates are partial, so a hot series is combined before the shuffle.
    """
    order = tie_order("ts", "event_id")
    return ticks.groupBy("series", bucket_start("ts", step).alias("bar")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("price"),
        F.sum("value").alias("volume"),
        F.count(F.lit(1)).alias("ticks"),
    ).withColumnRenamed("bar", "ts")


def rule_for(column: str) -> str | None:
    """Resampling rule of a column, by name."""
    if column.endswith("high"):
        return "max"
    if column.endswith("low"):
        return "min"
    if column.endswith("open"):
        return "first"
    if column.endswith("price"):
        return "last"
    if column.endswith("volume"):
        return "sum"
    if column.startswith("on_chain_"):
        return "avg"
    if column.startswith("long_short_") and column != "long_short_top_global_ratio":
        return "first"
    if column.startswith("sentiment_lc_"):
        return "first"
    return None


def aggregate_by_rule(column: str, order: Column) -> Column | None:
    c = F.col(column)
    known = F.when(c.isNotNull(), order)
    return {
        "max": lambda: F.max(c), "min": lambda: F.min(c), "first": lambda: F.min_by(c, known),
        "last": lambda: F.max_by(c, known), "sum": lambda: F.sum(c), "avg": lambda: F.avg(c), None: lambda: None,
    }[rule_for(column)]()


def resample(df: DataFrame, step: int, keys: tuple[str, ...] = ("series",), ts: str = "ts") -> DataFrame:
    """Coarser bars; each column follows the rule of its name, columns without a rule are left out."""
    aggs = [
        a.alias(c) for c in df.columns if c not in (*keys, ts)
        for a in [aggregate_by_rule(c, F.col(ts))] if a is not None
    ]
    return df.groupBy(*keys, bucket_start(ts, step).alias("_bar")).agg(*aggs).withColumnRenamed("_bar", ts)


def with_derivatives(df: DataFrame, g: Grid, price: str = "price", prefix: str = "") -> DataFrame:
    """Return, acceleration and jerk of a price column.

    The price is filled forward first, so a null row has return 0 and the next known price is compared
    with the last known one.
    """
    filled = running(df, g, {"_p": ("last", F.col(price).cast("double"))})
    # Up to three rows back: jerk needs the price of t-3.
    def exprs(w: Window) -> dict[str, Column]:
        p = [F.col("_p")] + [F.lag("_p", k).over(w) for k in (1, 2, 3)]
        ret = [F.try_divide(p[k] - p[k + 1], p[k + 1]) for k in range(3)]
        return {
            f"{prefix}return": ret[0],
            f"{prefix}acceleration": ret[0] - ret[1],
            f"{prefix}jerk": ret[0] - ret[1] - (ret[1] - ret[2]),
        }
    return bounded(filled, g, exprs, back=3).drop("_p")


def span_grid(df: DataFrame, g: Grid) -> DataFrame:
    """Every bar between the first and last one of each series.

    Rows are generated per block, not by one task per series.
    """
    p = F.floor(epoch_seconds(g.ts) / F.lit(g.step))
    spans = df.groupBy(*g.keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    blocks = spans.select(
        *g.keys, "_lo", "_hi",
        F.explode(F.sequence(F.floor(F.col("_lo") / g.block), F.floor(F.col("_hi") / g.block))).alias("_b"),
    )
    return blocks.select(
        *g.keys,
        F.explode(F.sequence(
            F.greatest(F.col("_lo"), F.col("_b") * g.block),
            F.least(F.col("_hi"), F.col("_b") * g.block + g.block - 1),
        )).alias("_p"),
    ).select(*g.keys, from_epoch(F.col("_p") * g.step).alias(g.ts))


def gap_fill(df: DataFrame, g: Grid) -> DataFrame:
    """Rows on the full grid; new rows hold nulls."""
    return span_grid(df, g).join(df, [*g.keys, g.ts], "left").select(*df.columns)


def missing_bars(df: DataFrame, g: Grid) -> DataFrame:
    """Grid rows that the table does not have."""
    return span_grid(df, g).join(df.select(*g.keys, g.ts), [*g.keys, g.ts], "left_anti")


def dense_bars(df: DataFrame, g: Grid) -> DataFrame:
    """Bars without gaps: prices filled forward, volume and tick count 0 in empty bars.

    ``df`` should be a table: it is read for the span of each series and for its rows.
    """
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "ticks") if c in df.columns}
    return running(stage(gap_fill(df, g).withColumns(zero)), g, {c: ("last", F.col(c)) for c in OHLC})
