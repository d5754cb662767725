"""Projections, filters and row repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalars import clip, soft_truncate
from barloom.operators.blocks import Grid, bounded
from barloom.session import join_staged

# Column groups by name.
CATEGORIES = {
    "coin": ("coin_",), "long_short": ("long_short",), "other_coins": ("other_coins",), "stock": ("stock",),
    "economic": ("economic",), "sentiment_lc": ("sentiment_lc",), "sentiment_btc_fgi": ("sentiment_btc_fgi",),
    "on_chain": ("on_chain",), "trading": ("trading_",), "manual": ("manual",),
}
PRICE_SUFFIXES = ("price", "open", "high", "low")


def by_category(columns: Sequence[str]) -> dict[str, list[str]]:
    """Column groups by name prefix; the prefix lists above carry the meaning of a column."""
    return {cat: [c for c in columns if c.startswith(p)] for cat, p in CATEGORIES.items()}


def price_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.endswith(PRICE_SUFFIXES)]


def align_schema(df: DataFrame, expected: Sequence[str], keys: Sequence[str], supply: DataFrame | None = None) -> DataFrame:
    """Exactly the expected columns: others are dropped, missing ones come from ``supply`` or are null."""
    missing = [c for c in expected if c not in df.columns]
    given = [c for c in missing if supply is not None and c in supply.columns]
    if given:
        df = df.join(supply.select(*keys, *given), list(keys), "left")
    return df.select(*keys, *[
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in expected if c not in keys])


def order_columns(df: DataFrame, keys: Sequence[str], canonical: Sequence[str]) -> DataFrame:
    """Keys, then the canonical columns in their order, then the others by name."""
    known = [c for c in canonical if c in df.columns]
    rest = sorted(c for c in df.columns if c not in (*keys, *known))
    return df.select(*keys, *known, *rest)


def selected_features(df: DataFrame, keys: Sequence[str], selected: dict[str, Sequence[str]], encoded: bool) -> DataFrame:
    """Union of the features selected per target; missing ones become 0. Before encoding, ``manual``
    columns are kept when a selected (encoded) name contains theirs."""
    wanted = list(dict.fromkeys(f for fs in selected.values() for f in fs))
    if encoded:
        return df.select(*keys, *[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in wanted])
    raw = [c for c in df.columns if c.startswith("manual") and any(c in f for f in wanted)]
    plain = [f for f in wanted if not f.startswith("manual")]
    return df.select(*keys, *[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in plain], *raw)


def mirror_targets(df: DataFrame, names: Sequence[str] = ("price", "return", "acceleration", "jerk")) -> DataFrame:
    """Copy ``coin_*`` to ``target_*``."""
    return df.withColumns({f"target_{n}": F.col(f"coin_{n}") for n in names})


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative values become null."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def standardized_flags(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column whether it looks standardized: mean * 100 <= std."""
    return df.groupBy(*keys).agg(*[
        (F.avg(c) * 100 <= F.stddev_samp(c)).alias(f"_std_{c}") for c in cols])


def null_negative_prices(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Negative prices become null, except in columns that look standardized."""
    flagged = join_staged(df, standardized_flags(df, keys, cols), keys)
    return flagged.withColumns({
        c: F.when((F.col(c) >= 0) | F.coalesce(F.col(f"_std_{c}"), F.lit(False)), F.col(c)) for c in cols
    }).select(*df.columns)


def flat_flags(df: DataFrame, g: Grid, cols: Sequence[str], relative: bool = True) -> DataFrame:
    """``_flat_<c>``: change, its difference and second difference are all 0 (four equal values in a row).

    ``relative`` uses relative change, which a 0 price leaves undefined.
    """
    def exprs(w) -> dict[str, Column]:
        out = {}
        for c in cols:
            p = [F.col(c)] + [F.lag(c, k).over(w) for k in (1, 2, 3)]
            if relative:
                r = [F.try_divide(p[k] - p[k + 1], p[k + 1]) for k in range(3)]
            else:
                r = [p[k] - p[k + 1] for k in range(3)]
            out[f"_flat_{c}"] = F.coalesce((r[0] == 0) & (r[0] - r[1] == 0) & (r[0] - r[1] - (r[1] - r[2]) == 0), F.lit(False))
        return out
    return bounded(df, g, exprs, back=3)


def null_flat_runs(df: DataFrame, g: Grid, cols: Sequence[str], derived: dict[str, Sequence[str]] | None = None, least: int = 3) -> DataFrame:
    """Flat rows become null (with the derivatives of the column) where a column has more than ``least`` of them."""
    flags = flat_flags(df, g, cols)
    counts = flags.groupBy(*g.keys).agg(*[F.count_if(f"_flat_{c}").alias(f"_n_{c}") for c in cols])
    both = join_staged(flags, counts, g.keys)
    out = {}
    for c in cols:
        drop = F.col(f"_flat_{c}") & (F.col(f"_n_{c}") > least)
        for target in [c, *(derived or {}).get(c, [])]:
            out[target] = F.when(~drop, F.col(target))
    return both.withColumns(out).select(*df.columns)


def drop_flat_runs(df: DataFrame, g: Grid, col: str) -> DataFrame:
    """Source variant: rows with flat absolute changes are dropped."""
    return flat_flags(df, g, [col], relative=False).where(~F.col(f"_flat_{col}")).select(*df.columns)


def clip_to(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Hard clip to ``<c>_low`` and ``<c>_high`` of the thresholds row of the series."""
    return join_staged(df, thresholds, keys).withColumns({
        c: clip(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")) for c in cols}).select(*df.columns)


def soft_clip_to(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], cols: Sequence[str], keep: float = 0.25) -> DataFrame:
    """Beyond the thresholds a share of the excess is kept."""
    return join_staged(df, thresholds, keys).withColumns({
        c: soft_truncate(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"), keep) for c in cols}).select(*df.columns)


def fix_high_low(df: DataFrame) -> DataFrame:
    return df.withColumns({"high": F.greatest("high", "price", "open"), "low": F.least("low", "price", "open")})


def fix_open_gap(df: DataFrame, g: Grid, share: float = 0.04) -> DataFrame:
    """An open further than ``share`` of the price from the previous close becomes that close."""
    def exprs(w) -> dict[str, Column]:
        before = F.lag("price").over(w)
        return {"open": F.when(F.abs(F.col("open") - before) > share * F.col("price"), before).otherwise(F.col("open"))}
    return bounded(df, g, exprs, back=1).select(*df.columns)


def split_unused(df: DataFrame, keys: Sequence[str], ts: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the last target bar of the series that have a price, and rows newer than it."""
    last = df.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.max(ts).alias("_last"))
    both = join_staged(df, last, keys, "left")
    used = both.where(F.col(target).isNotNull()).select(*df.columns)
    unused = both.where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).select(*df.columns)
    return used, unused


def clip_to_seen(df: DataFrame, train: DataFrame, keys: Sequence[str], forecast: str, seen: str) -> DataFrame:
    """Forecasts clipped to the range of returns seen in training."""
    span = train.groupBy(*keys).agg(F.min(seen).alias("_lo"), F.max(seen).alias("_hi"))
    return join_staged(df, span, keys).withColumn(forecast, clip(F.col(forecast), F.col("_lo"), F.col("_hi"))).select(*df.columns)


def zscore_filter(df: DataFrame, keys: Sequence[str], col: str, limit: float = 2.1) -> DataFrame:
    """Rows within ``limit`` population deviations of the mean."""
    m = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return join_staged(df, m, keys).where(F.abs(F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))) < limit).select(*df.columns)


def valid_forecasts(df: DataFrame, keys: Sequence[str], forecast: str) -> DataFrame:
    """Per key whether forecasts vary: at most 20 % zeros, 33 to 67 % positive."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(
        share(F.col(forecast) == 0).alias("zero_share"), share(F.col(forecast) > 0).alias("positive_share"),
    ).withColumn("valid", (F.col("zero_share") <= 0.2) & F.col("positive_share").between(0.33, 0.67))
