"""Vendor-shaped rows to typed frames. Fetching is not part of this library: inputs are tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.time import bucket_start, epoch_millis_to_ts, from_epoch
from barloom.operators.blocks import Grid
from barloom.operators.joins import align
from barloom.operators.project import drop_flat_runs
from barloom.operators.sets import tail_rows, tail_share

# Positions in a kline row.
KLINE = {"open": 1, "high": 2, "low": 3, "price": 4, "volume": 5}


def klines(raw: DataFrame, g: Grid, periods: int, drop_unfinished: bool = True) -> DataFrame:
    """``(series, row array<string>)`` to bars: typed, flat runs dropped, the last ``periods`` bars of
    each series without the unfinished newest one."""
    typed = raw.select(
        *g.keys, epoch_millis_to_ts(F.col("row")[0].cast("bigint")).alias(g.ts),
        *[F.col("row")[i].cast("double").alias(n) for n, i in KLINE.items()])
    return tail_rows(drop_flat_runs(typed, g, "price"), g, periods, skip=1 if drop_unfinished else 0)


def account_ratios(shares: DataFrame, top: DataFrame) -> DataFrame:
    """Long/short account ratios of all and of top traders, side by side, with their quotient."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            epoch_millis_to_ts(F.col("timestamp").cast("bigint")).alias("ts"),
            F.col("longAccount").cast("double").alias(f"long_short_{name}_long_perc"),
            F.col("longShortRatio").cast("double").alias(f"long_short_{name}_long_short_ratio"))
    both = align([side(shares, "global"), side(top, "top_traders")], ["ts"], "full_outer")
    return both.withColumn("long_short_top_global_ratio", F.try_divide(
        "long_short_top_traders_long_short_ratio", "long_short_global_long_short_ratio"))


# Social metrics kept.
SOCIAL = ["circulating_supply", "galaxy_score", "volatility", "alt_rank", "contributors_active", "posts_active",
          "interactions", "social_dominance"]


def sentiment(raw: DataFrame) -> DataFrame:
    return raw.select(from_epoch(F.col("time").cast("double").cast("bigint")).alias("ts"), *[
        F.col(c).cast("double").alias(f"sentiment_lc_{c}") for c in SOCIAL])


def fear_greed(raw: DataFrame) -> DataFrame:
    """Daily index, oldest first; time to the minute."""
    minute = F.floor(F.col("timestamp").cast("bigint") / 60) * 60
    return raw.select(
        from_epoch(minute).alias("ts"), F.col("value").cast("int").alias("sentiment_btc_fgi_btc_fgi"),
        F.col("value_classification").alias("sentiment_btc_fgi_btc_fgi_class")).orderBy("ts")


def newest(df: DataFrame, periods: int, ts: str = "ts") -> DataFrame:
    """The last ``periods`` rows of a single daily table."""
    return df.orderBy(F.col(ts).desc()).limit(periods)


def economic(treasury: DataFrame, rates: DataFrame, periods: int) -> DataFrame:
    """Two daily series; '.' means 0."""
    number = lambda name: F.when(F.col("value") == ".", 0.0).otherwise(F.col("value").try_cast("double")).alias(name)
    side = lambda df, name: df.select(F.to_date("date").cast("timestamp_ntz").alias("ts"), number(name))
    return newest(align([side(treasury, "economic_treasury_yield"), side(rates, "economic_interest_rate")], ["ts"], "full_outer"), periods)


def on_chain(series: dict[str, DataFrame], step: int | None, periods: int) -> DataFrame:
    """Charts of ``(x epoch seconds, y)``, outer-joined; with ``step`` the first value of each bucket."""
    sides = [df.select(from_epoch(F.col("x").cast("bigint")).alias("ts"), F.col("y").cast("double").alias(f"on_chain_{n}"))
             for n, df in series.items()]
    joined = align(sides, ["ts"], "full_outer")
    if step:
        joined = joined.groupBy(bucket_start("ts", step).alias("_b")).agg(*[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in joined.columns if c != "ts"
        ]).withColumnRenamed("_b", "ts")
    return newest(joined, periods)


def stock_closes(raw: DataFrame, tickers: Sequence[str], zone: str, step: int) -> DataFrame:
    """``(ticker, local, close)`` in exchange time to ``stock_<ticker>_price`` columns in UTC, first close per bucket."""
    utc = raw.select("ticker", "close", F.expr(f"convert_timezone('{zone}', 'UTC', local)").alias("ts"))
    return utc.groupBy(bucket_start("ts", step).alias("ts")).agg(*[
        F.min_by("close", F.when(F.col("ticker") == t, F.col("ts"))).alias(f"stock_{t}_price") for t in tickers])


def key_uniform(*cols: str | Column, salt: str = "") -> Column:
    """Number in [0, 1) from a hash of the key: the same row always gets the same number."""
    digest = F.md5(F.concat_ws("|", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in cols], F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / 4294967296.0


def combined_panel(y: DataFrame, x: DataFrame, g: Grid, keep: float, sample: float) -> DataFrame:
    """Targets and features of all series on common rows: the newest ``keep`` of each series, then a
    repeatable sample by key hash. Keys that are not unique in both tables are refused."""
    for name, df in (("targets", y), ("features", x)):
        twice = df.groupBy(*g.keys, g.ts).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(3).collect()
        if twice:
            raise ValueError(f"{name}: keys stand more than once, such as {[tuple(r)[:-1] for r in twice]}")
    return tail_share(align([y, x], [*g.keys, g.ts]), g, keep).where(key_uniform(*g.keys, g.ts) < sample)


def modeling_dataset(frames: Sequence[DataFrame], g: Grid, periods: int) -> DataFrame:
    """Several tables cut to their common rows and to the last ``periods`` of each series."""
    return tail_rows(align(frames, [*g.keys, g.ts]), g, periods)
