"""Data-quality checks. Each returns rows with the series, what was checked, a value and ``failed``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.time import epoch_seconds
from barloom.operators.blocks import Grid
from barloom.operators.project import flat_flags
from barloom.session import join_staged


def per_column(df: DataFrame, keys: Sequence[str], values: dict[str, Column], failed: dict[str, Column]) -> DataFrame:
    """One aggregation for all columns, then one row per key and column: ``values[c]`` and ``failed[c]``
    (an expression over the aggregated value ``F.col(c)``)."""
    wide = df.groupBy(*keys).agg(*[v.alias(c) for c, v in values.items()])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                      F.coalesce(failed[c], F.lit(False)).alias("failed")) for c in values]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.*")


def stale(df: DataFrame, g: Grid, now: dt.datetime, bars: int = 12) -> DataFrame:
    """Last timestamp older than ``bars`` bars before ``now``."""
    age = (F.lit(int(now.replace(tzinfo=dt.timezone.utc).timestamp())) - epoch_seconds(g.ts)) / g.step
    return df.groupBy(*g.keys).agg(F.min(age).alias("value")).withColumn("failed", F.col("value") > bars)


def column_presence(df: DataFrame, expected: Sequence[str], mode: str) -> DataFrame:
    """``missing``: expected columns the table lacks; ``unexpected``: columns nobody expects. One row per
    wrong column with the number of rows concerned."""
    wrong = [c for c in expected if c not in df.columns] if mode == "missing" else [c for c in df.columns if c not in expected]
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.explode(F.array([F.lit(c) for c in wrong]).cast("array<string>")).alias("column"), "value").withColumn("failed", F.lit(True))


def duplicate_columns(names: Sequence[str], df: DataFrame) -> DataFrame:
    """Column names that occur more than once in ``names``, the header of the source ``df`` was read from."""
    twice = sorted({c for c in names if list(names).count(c) > 1})
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.explode(F.array([F.lit(c) for c in twice]).cast("array<string>")).alias("column"), "value").withColumn("failed", F.lit(True))


def too_many_columns(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("value", F.lit(len(df.columns))).withColumn("failed", F.col("value") > limit)


def missing_rows(df: DataFrame, g: Grid) -> DataFrame:
    """Bars missing between the first and last one: the span against the distinct bars."""
    p = F.floor(epoch_seconds(g.ts) / g.step)
    return df.groupBy(*g.keys, p.alias("_p")).agg(F.lit(1)).groupBy(*g.keys).agg(
        (F.max("_p") - F.min("_p") + 1 - F.count(F.lit(1))).alias("value")).withColumn("failed", F.col("value") > 0)


def null_ratio(df: DataFrame, keys: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """Null share per column against its limit."""
    return per_column(df, keys, {c: F.avg(F.col(c).isNull().cast("double")) for c in limits},
                      {c: F.col(c) > limit for c, limit in limits.items()})


def duplicates(df: DataFrame, keys: Sequence[str], subset: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each value combination of ``subset``."""
    return df.groupBy(*dict.fromkeys([*keys, *subset])).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum(F.col("_n") - 1).alias("value")).withColumn("failed", F.col("value") > 0)


def above_max(df: DataFrame, keys: Sequence[str], limits: dict[str, float]) -> DataFrame:
    return per_column(df, keys, {c: F.max(c) for c in limits}, {c: F.col(c) > v for c, v in limits.items()})


def below_min(df: DataFrame, keys: Sequence[str], limits: dict[str, float]) -> DataFrame:
    return per_column(df, keys, {c: F.min(c) for c in limits}, {c: F.col(c) < v for c, v in limits.items()})


def unexpected_values(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Values outside the allowed set, with their count."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where(
        ~F.col("value").isin(list(ok))).withColumn("column", F.lit(c)) for c, ok in allowed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("failed", F.lit(True))


def negatives(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Number of negative values per column."""
    return per_column(df, keys, {c: F.count_if(F.col(c) < 0) for c in cols}, {c: F.col(c) > 0 for c in cols})


def _scale(c: str) -> Column:
    return F.avg(c) * 100 <= F.stddev_samp(c)


def standardized(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns whose mean x 100 does not exceed their deviation."""
    return per_column(df, keys, {c: _scale(c) for c in cols}, {c: F.col(c) for c in cols})


def negative_prices(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Negative values in price columns that do not look standardized."""
    count = lambda c: F.when(F.coalesce(_scale(c), F.lit(False)), 0).otherwise(F.count_if(F.col(c) < 0))
    return per_column(df, keys, {c: count(c) for c in cols}, {c: F.col(c) > 0 for c in cols})


def flat_prices(df: DataFrame, g: Grid, cols: Sequence[str], limit: int = 5) -> DataFrame:
    """More than ``limit`` flat rows among the known values of a column."""
    long = df.unpivot([*g.keys, g.ts], list(cols), "column", "_x").where(F.col("_x").isNotNull())
    by_column = Grid(keys=(*g.keys, "column"), ts=g.ts, step=g.step, block=g.block, dense=False)
    return flat_flags(long, by_column, ["_x"]).groupBy(*g.keys, "column").agg(
        F.count_if("_flat__x").alias("value")).withColumn("failed", F.col("value") > limit)


def extreme_values(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Number of values outside ``<c>_low`` .. ``<c>_high`` of the series."""
    outside = lambda c: F.count_if((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")))
    return per_column(join_staged(df, thresholds, keys), keys, {c: outside(c) for c in cols}, {c: F.col(c) > 0 for c in cols})


def short_length(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Fewer than 95 % of the expected rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("value")).withColumn("failed", F.col("value") < 0.95 * expected)


# Enabled checks of a table; a rule set overrides single entries.
DEFAULT_RULES = {"max": {}, "min": {}, "null_ratio": {}, "non_negative": [], "expected_rows": None, "now": None, "stale_bars": 12}


def report(df: DataFrame, g: Grid, rules: dict, overrides: dict | None = None) -> DataFrame:
    """All row checks of a table in one aggregation, one row per series and check.

    Checks that need order or keys (gaps, duplicates) come from counts per ``(series, bar)``, which are
    aggregated before the shuffle like everything else.
    """
    r = {**DEFAULT_RULES, **rules, **(overrides or {})}
    cols = sorted({*r["max"], *r["min"], *r["null_ratio"], *r["non_negative"]})
    bar = F.floor(epoch_seconds(g.ts) / g.step)
    first = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        first += [F.count(c).alias(f"_k_{c}"), F.max(c).alias(f"_x_{c}"), F.min(c).alias(f"_m_{c}"), F.count_if(F.col(c) < 0).alias(f"_g_{c}")]
    bars = df.groupBy(*g.keys, bar.alias("_p")).agg(*first)
    second = [F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_bars"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi")]
    for c in cols:
        second += [F.sum(f"_k_{c}").alias(f"_k_{c}"), F.max(f"_x_{c}").alias(f"_x_{c}"), F.min(f"_m_{c}").alias(f"_m_{c}"), F.sum(f"_g_{c}").alias(f"_g_{c}")]
    total = bars.groupBy(*g.keys).agg(*second)

    def any_of(flags: list[Column]) -> Column:
        out = F.lit(False)
        for f in flags:
            out = out | F.coalesce(f, F.lit(False))
        return out

    checks = {
        "missing_rows": F.col("_hi") - F.col("_lo") + 1 > F.col("_bars"),
        "duplicate_keys": F.col("_n") > F.col("_bars"),
        "above_max": any_of([F.col(f"_x_{c}") > v for c, v in r["max"].items()]),
        "below_min": any_of([F.col(f"_m_{c}") < v for c, v in r["min"].items()]),
        "null_ratio": any_of([1 - F.col(f"_k_{c}") / F.col("_n") > v for c, v in r["null_ratio"].items()]),
        "negative_values": any_of([F.col(f"_g_{c}") > 0 for c in r["non_negative"]]),
    }
    if r["expected_rows"] is not None:
        checks["short_length"] = F.col("_n") < 0.95 * r["expected_rows"]
    if r["now"] is not None:
        now = int(r["now"].replace(tzinfo=dt.timezone.utc).timestamp()) // g.step
        checks["stale"] = F.lit(now) - F.col("_hi") > r["stale_bars"]
    cells = [F.struct(F.lit(n).alias("check"), f.alias("failed")) for n, f in checks.items()]
    return total.select(*g.keys, F.explode(F.array(*cells)).alias("_r")).select(*g.keys, "_r.*")


def needs_repair(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series whether any check failed."""
    return checks.groupBy(*keys).agg(F.bool_or("failed").alias("needs_repair"))


def null_in_last_bar(df: DataFrame, g: Grid, cols: Sequence[str], session_cols: Sequence[str], in_session: Column) -> DataFrame:
    """Columns that are null in the newest bar of a series; ``session_cols`` only count in market hours."""
    last = df.groupBy(*g.keys).agg(F.max_by(F.struct(g.ts, *cols), F.col(g.ts)).alias("_l")).select(*g.keys, "_l.*")
    cells = [F.struct(F.lit(c).alias("column"), (F.col(c).isNull() & (in_session if c in session_cols else F.lit(True))).alias("failed")) for c in cols]
    return last.select(*g.keys, g.ts, F.explode(F.array(*cells)).alias("_r")).where("_r.failed").select(*g.keys, g.ts, "_r.column")


def split_integrity(val: DataFrame, test: DataFrame, opt: DataFrame, g: Grid) -> DataFrame:
    """Validation and test rows do not overlap, follow each other by one bar, and test equals optimized."""
    keys = [*g.keys, g.ts]
    tagged = val.select(*keys, F.lit(1).alias("_v"), F.lit(0).alias("_t"), F.lit(0).alias("_o")).unionByName(
        test.select(*keys, F.lit(0).alias("_v"), F.lit(1).alias("_t"), F.lit(0).alias("_o"))).unionByName(
        opt.select(*keys, F.lit(0).alias("_v"), F.lit(0).alias("_t"), F.lit(1).alias("_o")))
    rows = tagged.groupBy(*keys).agg(F.max("_v").alias("v"), F.max("_t").alias("t"), F.max("_o").alias("o"))
    at = lambda side: F.when(F.col(side) == 1, epoch_seconds(g.ts))
    return rows.groupBy(*g.keys).agg(
        F.count_if((F.col("v") == 1) & ((F.col("t") == 1) | (F.col("o") == 1))).alias("overlap"),
        ((F.min(at("t")) - F.max(at("v"))) / g.step).alias("gap_bars"),
        F.count_if(F.col("t") != F.col("o")).alias("test_differs"),
    ).withColumn("failed", (F.col("overlap") > 0) | (F.col("gap_bars") != 1) | (F.col("test_differs") > 0))


def feature_list_checks(selected: DataFrame, available: Sequence[str], limit: int) -> DataFrame:
    """Selected features ``(target, feature)``: too many, listed twice, or not in the data."""
    known = F.col("feature").isin(list(available))
    return selected.groupBy("target").agg(
        (F.count(F.lit(1)) > limit).alias("too_many"),
        (F.count(F.lit(1)) > F.count_distinct("feature")).alias("repeated"),
        F.count_if(~known).alias("absent"))


def frames_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tolerance: float) -> DataFrame:
    """Per column sum|a-b| / sum|a| over common keys, and whether it is within the tolerance."""
    both = a.alias("a").join(b.alias("b"), list(keys))
    wide = both.agg(*[F.try_divide(F.sum(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))), F.sum(F.abs(F.col(f"a.{c}")))).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "error").withColumn("equal", F.coalesce(F.col("error") <= tolerance, F.lit(False)))


def same_forecasts(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str, col: str, tolerance: float = 1e-9) -> DataFrame:
    """Per series whether two runs gave the same rows and the same forecasts."""
    both = a.alias("a").join(b.alias("b"), [*keys, ts], "full_outer")
    x, y = F.col(f"a.{col}"), F.col(f"b.{col}")
    differs = ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("different")).withColumn(
        "consistent", F.col("different") == 0)
