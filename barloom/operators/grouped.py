"""Features of many columns of a panel, built group by group on one numbering.

A panel with hundreds of columns and a dozen look-backs gives thousands of features, too many for one plan. Here rows are placed
in blocks once, with the earlier rows their look-backs need, and written as a table bucketed by series and block. Every group of
columns reads its own columns of that table, computes its features without a shuffle of rows, and is written bucketed alike, so that the
groups meet again without a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from barloom.operators.blocks import Grid, frame, position
from barloom.operators.windows import fill_both
from barloom.session import fresh_path, stage

LEVELS = ("return", "acceleration", "jerk")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` files by ``keys`` and read it back; later windows and joins on them do not shuffle it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", fresh_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved: the files stay, the name is not needed any more  # noqa: B018
    spark.sql(f"DROP TABLE {table}")
    return out


@dataclass(frozen=True)
class Numbered:
    """Rows in blocks: ``_blk`` block a row is seen in, ``_pos`` position in the series, ``_own`` marks the block it belongs to."""

    rows: DataFrame
    g: Grid
    size: int
    buckets: int

    @property
    def by_block(self) -> list[str]:
        return [*self.g.keys, "_blk"]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by_block).orderBy("_pos")


def numbered(df: DataFrame, g: Grid, cols: Sequence[str], back: int, spans: Sequence[int] = (), buckets: int | None = None) -> Numbered:
    """Place the rows of a panel once. ``cols`` are filled forward, backward, then with 0; each block also holds the ``back`` rows before it."""
    filled = stage(fill_both(stage(df.select(*g.keys, g.ts, *cols)), g, cols).fillna(0.0, list(cols)))
    # d ** -offset has to stay far from overflow inside a block
    size = min([g.block, *[max(1, int(200 / -math.log10(1 - 2 / (s + 1)))) for s in spans if s > 1]])
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = position(filled, g).withColumn("_home", F.floor(F.col("_pos") / size))
    seen = F.sequence(F.floor((F.col("_pos") - 1) / size), F.floor((F.col("_pos") + back) / size))  # the row after a block as well: a first row takes the deviation of the second
    spread = placed.withColumn("_blk", F.explode(seen)).withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home")
    return Numbered(bucketed(spread, [*g.keys, "_blk"], buckets, "numbered"), g, size, buckets)


def _decayed(ends: Column, d: float) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * d + e)


def _carries(num: Numbered, cols: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """One row per block: per column the first value of the series, and per column and span the average at the end of the block before."""
    decay = {s: 1 - 2 / (s + 1) for s in spans if s > 1}
    r = (F.col("_pos") - F.col("_blk") * num.size).cast("double")
    last = num.size - 1
    totals = num.rows.where("_own").groupBy(*num.by_block).agg(
        F.min(r).alias("_r0"), *[F.min_by(c, "_pos").alias(f"_f_{c}") for c in cols],
        *[F.sum((1 - d) * F.col(c) * F.pow(F.lit(d), last - r)).alias(f"_t_{c}_{s}") for c in cols for s, d in decay.items()])
    series = Window.partitionBy(*num.g.keys).orderBy("_blk")
    ahead = totals.withColumn("_first", F.lag(F.lit(1)).over(series).isNull())
    out = []
    for c in cols:
        out.append(F.first(f"_f_{c}").over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_f_{c}"))
        for s, d in decay.items():
            # in a series' first block the average starts at the first value, moved back to the start of the block
            start = F.when(F.col("_first"), F.col(f"_f_{c}") * F.pow(F.lit(d), -F.col("_r0")))
            end = F.col(f"_t_{c}_{s}") + F.coalesce(start * d**num.size, F.lit(0.0))
            reach = max(1, math.ceil(60 / (-num.size * math.log10(d))))  # terms below 1e-60 are far under double precision
            ends = F.collect_list(end).over(series.rowsBetween(-reach, -1))
            past = _decayed(ends, d**num.size)
            out.append(F.coalesce(start, past).alias(f"_e_{c}_{s}"))
    return stage(ahead.select(*num.by_block, *out), "carries")


def _looks(num: Numbered, cols: Sequence[str], lags: Sequence[int], windows: Sequence[int], spans: Sequence[int]) -> DataFrame:
    """Lags (before the first row: the first value), rolling statistics and exponential averages of ``cols``."""
    w, own = num.window(), F.col("_own")
    r = (F.col("_pos") - F.col("_blk") * num.size).cast("double")
    rows = num.rows.select(*num.by_block, num.g.ts, "_pos", "_own", *cols).join(_carries(num, cols, spans), num.by_block)
    out: dict[str, Column] = {}
    for c in cols:
        out |= {f"{c}_lag_{k}": F.coalesce(F.lag(c, k).over(w), F.col(f"_f_{c}")) for k in lags}
        for n in windows:
            f = frame(w, n)
            # a deviation needs two rows: the first row takes that of the second, later ones have it
            out |= {f"{c}_rolling_{n}_{s}": fn(c).over(f) for s, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))}
            out[f"{c}_rolling_{n}_std"] = F.coalesce(F.stddev_samp(c).over(f), F.stddev_samp(c).over(w.rowsBetween(0, 1)), F.lit(0.0))
            out[f"{c}_rolling_{n}_range"] = F.max(c).over(f) - F.min(c).over(f)
        for s in spans:
            d = 1 - 2 / (s + 1)
            run = F.sum(F.when(own, (1 - d) * F.col(c) * F.pow(F.lit(d), -r))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            out[f"{c}_ema_{s}"] = F.pow(F.lit(d), r) * (run + d * F.col(f"_e_{c}_{s}")) if s > 1 else F.col(c)
    wide = rows.select(*num.by_block, num.g.ts, "_pos", "_own", *cols, *[e.alias(n) for n, e in out.items()])
    return wide.where("_own").drop("_own")


def _derived(num: Numbered, kinds: Mapping[str, str]) -> DataFrame:
    """Return, acceleration and jerk of each column, nulls left in place."""
    w = num.window()

    def change(c: str, k: int) -> Column:
        now, before = F.lag(c, k).over(w) if k else F.col(c), F.lag(c, k + 1).over(w)
        return now - before if kinds[c] == "diff" else F.try_divide(now - before, before)

    out = {}
    for c in kinds:
        a, b, d = (change(c, k) for k in range(3))
        out |= {f"{c}_return": a, f"{c}_acceleration": a - b, f"{c}_jerk": (a - b) - (b - d)}
    rows = num.rows.select(*num.by_block, "_pos", "_own", *kinds)
    return rows.select(*num.by_block, "_pos", "_own", *[e.alias(n) for n, e in out.items()]).where("_own").drop("_own")


def _filled(num: Numbered, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls filled forward, then backward, then with 0; only one row per block leaves its task."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_pos"))
    totals = df.groupBy(*num.by_block).agg(*[f(c, known(c)).alias(f"_{s}_{c}") for c in cols for s, f in (("l", F.max_by), ("n", F.min_by))])
    series = Window.partitionBy(*num.g.keys).orderBy("_blk")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*num.g.keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = stage(totals.select(
        *num.by_block, *[F.last(f"_l_{c}", True).over(before).alias(f"_l_{c}") for c in cols], *[F.last(f"_n_{c}", True).over(after).alias(f"_n_{c}") for c in cols]), "fills")
    up = num.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*num.by_block).orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.join(carry, num.by_block)
    fill = lambda c: F.coalesce(F.last(c, True).over(up), F.col(f"_l_{c}"), F.last(c, True).over(down), F.col(f"_n_{c}"), F.lit(0.0))
    return rows.select(*num.by_block, "_pos", *[fill(c).alias(c) for c in cols])


@contextmanager
def _by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by series and block may meet by (series, block, position) without being dealt out anew; the setting is put back."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _met(num: Numbered, tables: Sequence[DataFrame]) -> DataFrame:
    """Columns of tables that hold the same rows."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop(num.g.ts), [*num.by_block, "_pos"])
    return out


def column_features(
    df: DataFrame, g: Grid, kinds: Mapping[str, str], lags: Sequence[int], windows: Sequence[int], spans: Sequence[int], width: int = 8, buckets: int | None = None,
) -> DataFrame:
    """Every feature of every column of ``kinds`` (column: ``diff`` or ``pct``, how its first derivative is taken).

    Per column: the column, ``_return``, ``_acceleration``, ``_jerk``, ``_lag_k``, ``_rolling_n_{mean,std,min,max,range}`` and ``_ema_s``. Columns
    are filled forward, backward, then with 0 first, and so are the derivatives (a change from 0 has none). ``width`` columns form a group.
    """
    bad = {c: k for c, k in kinds.items() if k not in ("diff", "pct")}
    if bad:
        raise ValueError(f"kinds must be diff or pct: {bad}")
    if not kinds:
        return df.select(*g.keys, g.ts)
    num = numbered(df, g, list(kinds), max([3, *lags, *[n - 1 for n in windows]]), spans, buckets)
    names = list(kinds)
    made = []
    with _by_some_keys(df.sparkSession):
        for i in range(0, len(names), width):
            group = names[i:i + width]
            raw = bucketed(_derived(num, {c: kinds[c] for c in group}), num.by_block, num.buckets, "derived")
            steps = _filled(num, raw, [f"{c}_{level}" for c in group for level in LEVELS])
            made.append(bucketed(_met(num, [_looks(num, group, lags, windows, spans), steps]), num.by_block, num.buckets, "group"))
        return stage(_met(num, made).drop("_blk", "_pos"), "features")
