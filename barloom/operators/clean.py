"""Outlier correction, null policy, repair and the whole cleaning of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.scalars import clip, finite
from barloom.operators import windows as win
from barloom.operators.aggregate import exact_quantiles, most_frequent, outlier_thresholds
from barloom.operators.bars import gap_fill
from barloom.operators.blocks import Grid, ema
from barloom.operators.joins import coalesce_join, pivot_peers
from barloom.operators.project import align_schema, fix_high_low, fix_open_gap, null_flat_runs, null_negative
from barloom.operators.sets import dedup, tail_rows
from barloom.session import join_staged, stage


def band_outliers(df: DataFrame, g: Grid, cols: Sequence[str], thresholds: DataFrame, span: int = 10, width: float = 7.0) -> DataFrame:
    """Values beyond the thresholds, then values further than ``width`` residual deviations from an
    exponential average, are replaced by interpolation."""
    inside = lambda c: F.when((F.col(c) >= F.col(f"{c}_low")) & (F.col(c) <= F.col(f"{c}_high")), F.col(c))
    kept = join_staged(df, thresholds.select(*g.keys, *[f"{c}_{s}" for c in cols for s in ("low", "high")]), g.keys)
    first = stage(win.interpolate(stage(kept.withColumns({c: inside(c) for c in cols}).select(*df.columns)), g, cols))
    # Leading nulls take the first known value: the average then starts there.
    led = stage(win.running_next(first, g, {f"_x_{c}": c for c in cols}))
    smooth = stage(ema(led, g, {f"_e_{c}": (F.col(f"_x_{c}"), 2 / (span + 1)) for c in cols}))
    spread = smooth.groupBy(*g.keys).agg(*[F.stddev_samp(F.col(c) - F.col(f"_e_{c}")).alias(f"_s_{c}") for c in cols])
    near = lambda c: F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"_e_{c}")) > width * F.col(f"_s_{c}"), F.lit(False)), F.col(c))
    trimmed = join_staged(smooth, spread, g.keys).withColumns({c: near(c) for c in cols}).select(*df.columns)
    return win.interpolate(stage(trimmed), g, cols)


def correct_outliers(df: DataFrame, g: Grid, prices: Sequence[str], cols: Sequence[str], thresholds: DataFrame) -> DataFrame:
    """Price outliers by band, opens that jump, then a hard clip of every column."""
    banded = stage(band_outliers(df, g, prices, thresholds))
    opened = fix_open_gap(banded, g) if {"open", "price"} <= set(df.columns) else banded
    limits = join_staged(opened, thresholds, g.keys)
    return limits.withColumns({c: clip(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")) for c in cols}).select(*df.columns)


def fill_nulls(df: DataFrame, g: Grid, fill_cols: Sequence[str], mid_cols: dict[str, tuple[str, str]], numbers: Sequence[str],
               strings: Sequence[str]) -> DataFrame:
    """The null policy of a panel.

    ``fill_cols``  forward, then backward fill
    ``mid_cols``   ``{column: (low, high)}`` names of threshold columns: rows before the first value take
                   the middle of the band, later nulls are filled backward, then forward
    ``numbers``    infinities to null, linear interpolation, then the median of the series
    ``strings``    most frequent value of the series
    """
    out = stage(win.fill_both(stage(df), g, fill_cols)) if fill_cols else df
    if mid_cols:
        out = stage(win.leading_fill(out, g, {c: (F.col(lo) + F.col(hi)) / 2 for c, (lo, hi) in mid_cols.items()}))
    if numbers:
        out = stage(win.interpolate(stage(out.withColumns({c: finite(F.col(c)) for c in numbers})), g, numbers))
        for c in numbers:
            medians = exact_quantiles(df, g.keys, c, [0.5]).select(*g.keys, F.col("quantiles")[0].alias("_median"))
            out = join_staged(out, medians, g.keys, "left").withColumn(c, F.coalesce(F.col(c), F.col("_median"))).drop("_median")
    for c in strings:
        modes = most_frequent(df, g.keys, c).withColumnRenamed(c, "_mode")
        out = join_staged(out, modes, g.keys, "left").withColumn(c, F.coalesce(F.col(c), F.col("_mode"))).drop("_mode")
    return out.select(*df.columns)


def clean_panel(df: DataFrame, g: Grid, order: str, prices: Sequence[str], cols: Sequence[str], periods: int) -> DataFrame:
    """Cleaning from raw rows to the last ``periods`` bars of each series.

    Negative values and flat runs become null, repeated keys keep the last load, gaps get rows,
    outliers and nulls are corrected, highs and lows made consistent; only original bars are kept.
    """
    loose = Grid(keys=g.keys, ts=g.ts, step=g.step, block=g.block, dense=False)
    unique = stage(dedup(null_negative(df, cols), [*g.keys, g.ts], F.col(order), "last").drop(order))
    steady = stage(null_flat_runs(unique, loose, prices))
    full = stage(align_schema(gap_fill(steady, g), list(cols), [*g.keys, g.ts]))
    limits = stage(outlier_thresholds(full, g.keys, cols, prices))
    corrected = correct_outliers(full, g, prices, cols, limits)
    filled = fill_nulls(corrected, g, prices, {}, [c for c in cols if c not in prices], [])
    original = fix_high_low(filled).join(unique.select(*g.keys, g.ts), [*g.keys, g.ts], "left_semi")
    return tail_rows(original, g, periods)


def repair(df: DataFrame, g: Grid, failed: Sequence[str], order: str, expected: Sequence[str], backup: DataFrame | None = None) -> DataFrame:
    """Repair by failed check: repeated keys, unexpected and missing columns, missing rows, nulls.

    Cells still null are taken from the backup.
    """
    keys = [*g.keys, g.ts]
    out = df
    if "duplicate_keys" in failed:
        out = dedup(out, keys, F.col(order), "first")
    if "unexpected_columns" in failed or "missing_columns" in failed:
        out = align_schema(out, list(expected), keys, backup)
    if "missing_rows" in failed:
        out = gap_fill(stage(out), g)
    if "null_ratio" in failed and backup is not None:
        out = coalesce_join(out, backup, keys).join(out.select(*keys), keys, "left_semi")
    return out.select(*keys, *[c for c in expected if c in out.columns])


def donor_columns(df: DataFrame, g: Grid, cols: Sequence[str], target: str, share: float = 0.95) -> DataFrame:
    """Shared columns of one series filled from the best other series that covers at least ``share`` of
    its rows; ties go to the first series by name."""
    series = g.keys[0]
    mine = df.where(F.col(series) == target)
    cover = df.join(mine.select(g.ts), g.ts, "left_semi").groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    # One row per series from here on.
    own = F.max(F.when(F.col(series) == target, F.col("_n"))).over(Window.partitionBy(F.lit(1)))
    enough = cover.withColumn("_own", own).where((F.col(series) != target) & (F.col("_n") >= F.col("_own") * share))
    ranked = enough.orderBy(F.col("_n").desc(), series).limit(1).select(series)
    donor = df.join(ranked, series, "left_semi").select(g.ts, *[F.col(c).alias(f"_d_{c}") for c in cols])
    return mine.join(donor, g.ts, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}")) for c in cols}).select(*df.columns)


def peer_columns(df: DataFrame, prices: DataFrame, peers: Sequence[str], ts: str = "ts") -> DataFrame:
    """``other_coins_<peer>_price`` columns for exactly the given peers: missing ones are filled from the
    price table, others dropped."""
    wanted = [f"other_coins_{p}_price" for p in peers]
    extra = [c for c in df.columns if c.startswith("other_coins_") and c not in wanted]
    missing = [p for p in peers if f"other_coins_{p}_price" not in df.columns]
    out = df.drop(*extra)
    if missing:
        block = pivot_peers(prices, missing, ["price"], ts).withColumnsRenamed({f"{p}_price": f"other_coins_{p}_price" for p in missing})
        out = out.join(block, ts, "left")
    return out
