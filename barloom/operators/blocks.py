"""Blocked evaluation of ordered operators on a panel.

A panel holds many series, each a sequence of rows on a time grid with unique ``(series, ts)`` keys.
``Window.partitionBy(series)`` would put a whole series on one task, so every ordered operator here
works on *blocks*: at most ``block`` consecutive rows of one series. A block is the unit of shuffle,
which keeps tasks even when a single series holds most of the data.

* ``bounded``  - lags and row frames of known reach: each block also receives a halo of the rows it needs.
* ``running``  - unbounded prefixes (fills, cumulative sums): local window plus one carry per block.
* ``ema``      - linear recursions: scaled prefix sums inside a block plus one carry per block.

Carries are one row per block, so the per-series window over them sees rows/block rows only.
Series keys must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.time import epoch_seconds


@dataclass(frozen=True)
class Grid:
    """Shape of a panel: series keys, time column, bar length in seconds and rows per block.

    ``dense`` says that no bar is missing between the first and last one of each series, so a row's
    position follows from its time and needs no counting pass.
    """

    keys: tuple[str, ...] = ("series",)
    ts: str = "ts"
    step: int = 3600
    block: int = 4096
    dense: bool = True
    ties: tuple[str, ...] = field(default=())

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)


def position(df: DataFrame, g: Grid, name: str = "_pos") -> DataFrame:
    """Add the row position inside the series (consecutive integers in time order)."""
    if g.dense:
        return df.withColumn(name, F.floor(epoch_seconds(g.ts) / F.lit(g.step)))
    based = df.withColumn("_tb", F.floor(epoch_seconds(g.ts) / F.lit(g.step * g.block)))
    by_block = g.key_list + ["_tb"]
    before = Window.partitionBy(*g.keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = based.groupBy(*by_block).agg(F.count(F.lit(1)).alias("_n")).select(
        *by_block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = F.row_number().over(Window.partitionBy(*by_block).orderBy(g.ts, *g.ties))
    return (
        based.withColumn("_rn", local)
        .join(offsets, by_block)
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_tb", "_rn", "_off")
    )


def row_numbers(df: DataFrame, g: Grid, rn: str = "rn", n: str | None = None) -> DataFrame:
    """1-based row number of each row in its series, and on request the series' row count.

    Counts per time block give the offsets, so no task sorts a whole series.
    """
    based = df.withColumn("_tb", F.floor(epoch_seconds(g.ts) / F.lit(g.step * g.block)))
    by_block = g.key_list + ["_tb"]
    before = Window.partitionBy(*g.keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if n:
        carry.append(F.sum("_n").over(Window.partitionBy(*g.keys)).alias(n))
    offsets = based.groupBy(*by_block).agg(F.count(F.lit(1)).alias("_n")).select(*by_block, *carry)
    local = F.row_number().over(Window.partitionBy(*by_block).orderBy(g.ts, *g.ties))
    return (
        based.withColumn(rn, local)
        .join(offsets, by_block)
        .withColumn(rn, F.col("_off") + F.col(rn))
        .drop("_tb", "_off")
    )


def bounded(
    df: DataFrame,
    g: Grid,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows after a row.

    ``exprs`` receives the ordered window; all columns share one shuffle and one sort. Rows near a
    block border are copied to the neighbour block as halo and dropped after evaluation.
    """
    size = max(g.block, back, ahead)
    placed = position(df, g).withColumn("_home", F.floor(F.col("_pos") / F.lit(size)))
    offset = F.col("_pos") - F.col("_home") * size
    homes = [F.col("_home")]
    if back:
        homes.append(F.when(offset >= size - back, F.col("_home") + 1))
    if ahead:
        homes.append(F.when(offset < ahead, F.col("_home") - 1))
    spread = placed.withColumn("_blk", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*g.keys, "_blk").orderBy("_pos")
    added = exprs(w)
    kept = [F.col(c) for c in df.columns if c not in added]
    return (
        spread.select(*kept, "_blk", "_home", *[c.alias(n) for n, c in added.items()])
        .where(F.col("_blk") == F.col("_home"))
        .drop("_blk", "_home")
    )


# Running kinds: the block total, how totals carry over, the value inside the block, and how both join.
# {v} value, {k} position of a known value, {t} total, {l} local value, {c} carry.
# "next" runs over the reversed order: a frame that ends at UNBOUNDED FOLLOWING would be evaluated anew
# for every row, one that starts at UNBOUNDED PRECEDING grows by one row at a time.
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_RUNNING = {
    "last": ("max_by({v}, {k})", "last({t}, true)", _BEFORE, "last({v}, true)", _UPTO, "coalesce({l}, {c})"),
    "last_before": ("max_by({v}, {k})", "last({t}, true)", _BEFORE, "last({v}, true)", _BEFORE, "coalesce({l}, {c})"),
    "next": ("min_by({v}, {k})", "last({t}, true)", f"DESC {_BEFORE}", "last({v}, true)", f"DESC {_UPTO}", "coalesce({l}, {c})"),
    "opening": ("min_by({v}, _pos)", "first({t})", _BEFORE, "first({v})", _UPTO, "coalesce({c}, {l})"),
    "sum": ("sum({v})", "sum({t})", _BEFORE, "sum({v})", _UPTO, "coalesce({l} + {c}, {l}, {c})"),
    "count": ("count({v})", "sum({t})", _BEFORE, "count({v})", _UPTO, "{l} + coalesce({c}, 0)"),
    "min": ("min({v})", "min({t})", _BEFORE, "min({v})", _UPTO, "least({l}, {c})"),
    "max": ("max({v})", "max({t})", _BEFORE, "max({v})", _UPTO, "greatest({l}, {c})"),
}


def _quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def running(df: DataFrame, g: Grid, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add unbounded prefix columns: ``{name: (kind, value)}``.

    ``last``        last non-null value up to the row      ``last_before``  the same, row excluded
    ``next``        first non-null value from the row on   ``opening``      value of the series' first row (not null)
    ``sum/count/min/max``  running aggregate

    The input is read twice (block totals, block rows): pass a table, see ``session.stage``.
    """
    names = list(specs)
    parts = [_RUNNING[specs[n][0]] for n in names]
    word = [{"v": f"_v{i}", "k": f"CASE WHEN _v{i} IS NOT NULL THEN _pos END", "t": f"_t{i}", "l": f"_l{i}", "c": f"_c{i}"}
            for i in range(len(names))]
    placed = position(df, g).withColumns({
        "_blk": F.floor(F.col("_pos") / F.lit(g.block)), **{f"_v{i}": specs[n][1] for i, n in enumerate(names)}})
    keys = _quoted(g.keys)
    by_block = [*keys, "_blk"]
    series = f"PARTITION BY {', '.join(keys)} ORDER BY _blk"
    block = f"PARTITION BY {', '.join(by_block)} ORDER BY _pos"
    totals = placed.groupBy(*g.keys, "_blk").agg(*[F.expr(p[0].format(**w)).alias(w["t"]) for p, w in zip(parts, word)])
    carries = totals.selectExpr(*by_block, *[f"{p[1].format(**w)} OVER ({series} {p[2]}) AS {w['c']}" for p, w in zip(parts, word)])
    keep = _quoted(c for c in df.columns if c not in specs)
    rows = placed.selectExpr(*keep, "_blk", *[f"{p[3].format(**w)} OVER ({block} {p[4]}) AS {w['l']}" for p, w in zip(parts, word)])
    return rows.join(carries, g.key_list + ["_blk"]).selectExpr(
        *keep, *[f"{p[5].format(**w)} AS `{n}`" for n, p, w in zip(names, parts, word)])


def ema(df: DataFrame, g: Grid, specs: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add exponential averages ``{name: (x, alpha)}``: y_0 = x_0, y_t = (1-alpha) y_{t-1} + alpha x_t.

    ``x`` must be free of nulls. Inside a block, with r the offset of a row and d = 1-alpha,
    y = d^r * sum(alpha * x * d^-r) + d^(r+1) * (value at the end of the previous block): a running sum
    instead of a loop. The block is short enough that d^-r stays far from overflow. The carry is the
    same recursion over block ends with decay d^size; terms below 1e-60 of the value are left out, far
    under double precision.
    """
    passed = {n: x for n, (x, a) in specs.items() if a >= 1}
    work = {n: s for n, s in specs.items() if s[1] < 1}
    if passed:
        df = df.withColumns(passed)
    if not work:
        return df
    names = list(work)
    decay = [1 - work[n][1] for n in names]
    size = min([g.block] + [max(1, int(200 / -math.log10(d))) for d in decay])
    placed = position(df, g).withColumn("_blk", F.floor(F.col("_pos") / F.lit(size)))
    placed = placed.withColumns({
        "_r": (F.col("_pos") - F.col("_blk") * size).cast("double"), **{f"_x{i}": work[n][0].cast("double") for i, n in enumerate(names)}})
    keys = _quoted(g.keys)
    by_block = [*keys, "_blk"]
    series = f"PARTITION BY {', '.join(keys)} ORDER BY _blk"

    total = [F.min("_r").alias("_r0")]
    for i, d in enumerate(decay):
        total.append(F.expr(f"sum({1 - d!r}D * _x{i} * power({d!r}D, {size - 1} - _r))").alias(f"_t{i}"))
        total.append(F.min_by(f"_x{i}", "_pos").alias(f"_f{i}"))
    sums = placed.groupBy(*g.keys, "_blk").agg(*total).selectExpr("*", f"lag(1) OVER ({series}) IS NULL AS _first")
    # In a series' first block the carry is x_0, moved back to the block start.
    sums = sums.selectExpr("*", *[f"CASE WHEN _first THEN _f{i} * power({d!r}D, -_r0) END AS _s{i}" for i, d in enumerate(decay)])
    sums = sums.selectExpr("*", *[f"_t{i} + coalesce(_s{i} * {d**size!r}D, 0D) AS _e{i}" for i, d in enumerate(decay)])
    carry = []
    for i, d in enumerate(decay):
        reach = max(1, math.ceil(60 / (-size * math.log10(d))))
        if reach == 1:
            past = f"lag(_e{i}) OVER ({series})"
        else:
            past = (f"aggregate(collect_list(_e{i}) OVER ({series} ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), "
                    f"0D, (acc, e) -> acc * {d**size!r}D + e)")
        carry.append(f"coalesce(_s{i}, {past}) AS _c{i}")
    carries = sums.selectExpr(*by_block, *carry)

    block = f"PARTITION BY {', '.join(by_block)} ORDER BY _pos {_UPTO}"
    keep = _quoted(c for c in df.columns if c not in work)
    local = placed.selectExpr(*keep, "_blk", "_r", *[
        f"sum({1 - d!r}D * _x{i} * power({d!r}D, -_r)) OVER ({block}) AS _l{i}" for i, d in enumerate(decay)])
    return local.join(carries, g.key_list + ["_blk"]).selectExpr(*keep, *[
        f"power({d!r}D, _r) * (_l{i} + {d!r}D * _c{i}) AS `{n}`" for i, (n, d) in enumerate(zip(names, decay))])


def pct_change(x: Column, w: WindowSpec, lag: int = 1) -> Column:
    prev = F.lag(x, lag).over(w)
    return F.try_divide(x - prev, prev)


def diff(x: Column, w: WindowSpec, lag: int = 1) -> Column:
    return x - F.lag(x, lag).over(w)


def frame(w: WindowSpec, rows: int) -> WindowSpec:
    """The last ``rows`` rows, current one included."""
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def full(x: Column, w: WindowSpec, rows: int, value: Column) -> Column:
    """``value`` once the frame holds ``rows`` non-null inputs, else null."""
    return F.when(F.count(x).over(frame(w, rows)) == rows, value)


def columns_with(df: DataFrame, prefixes: Iterable[str] = (), suffixes: Iterable[str] = ()) -> list[str]:
    """Columns whose name starts with one of ``prefixes`` or ends with one of ``suffixes``."""
    p, s = tuple(prefixes), tuple(suffixes)
    return [c for c in df.columns if (p and c.startswith(p)) or (s and c.endswith(s))]
