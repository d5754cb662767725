"""Window features on a panel: lags, rolling statistics, indicators, fills, shifts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.operators.blocks import Grid, bounded, diff, ema, frame, full, pct_change, position, running
from barloom.session import stage


def back_fill(df: DataFrame, g: Grid, cols: Sequence[str]) -> DataFrame:
    """Each null takes the next known value of its series. Later values leak into earlier rows."""
    return running(df, g, {c: ("next", F.col(c)) for c in cols})


def forward_fill(df: DataFrame, g: Grid, cols: Sequence[str]) -> DataFrame:
    """Each null takes the last known value of its series."""
    return running(df, g, {c: ("last", F.col(c)) for c in cols})


def fill_both(df: DataFrame, g: Grid, cols: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, in one pass."""
    filled = running(df, g, {f"_f_{c}": ("last", F.col(c)) for c in cols} | {f"_b_{c}": ("next", F.col(c)) for c in cols})
    return filled.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}).select(*df.columns)


def rolling_exprs(
    w: WindowSpec, cols: Sequence[str], windows: Sequence[int], name: Callable[[str, str, int], str], fill: bool,
) -> dict[str, Column]:
    out = {}
    for c in cols:
        # Only row one lacks a deviation, and row two has the same value for every window.
        two = F.stddev_samp(c).over(w.rowsBetween(0, 1))
        for n in windows:
            f = frame(w, n)
            std = F.stddev_samp(c).over(f)
            out[name(c, "mean", n)] = F.avg(c).over(f)
            out[name(c, "std", n)] = F.coalesce(std, two) if fill else std
            out[name(c, "min", n)] = F.min(c).over(f)
            out[name(c, "max", n)] = F.max(c).over(f)
            out[name(c, "range", n)] = F.max(c).over(f) - F.min(c).over(f)
    return out


def rolling_stats(
    df: DataFrame, g: Grid, cols: Sequence[str], windows: Sequence[int],
    name: Callable[[str, str, int], str] = lambda c, s, w: f"{c}_{s}_{w}", fill: bool = True,
) -> DataFrame:
    """Mean, sample deviation, min, max and range over the last w rows, from the first row on.

    The deviation of a series' first row does not exist; with ``fill`` it takes the next one that does. Only a column with nulls can lack
    more than that one; its deviations are filled backward by a pass of their own.
    """
    out = bounded(df, g, lambda w: rolling_exprs(w, cols, windows, name, fill), back=max(windows) - 1, ahead=1 if fill else 0)
    if not fill:
        return out
    holes = df.agg(*[F.count_if(F.col(c).isNull()) for c in cols]).first()
    filled = [name(c, "std", n) for c, k in zip(cols, holes, strict=True) if k for n in windows]
    return back_fill(stage(out), g, filled) if filled else out


def ema_features(
    df: DataFrame, g: Grid, cols: Sequence[str], spans: Sequence[int],
    name: Callable[[str, int], str] = lambda c, w: f"{c}_ema_{w}",
) -> DataFrame:
    """Exponential averages with alpha = 2 / (span + 1), started at the first value."""
    return ema(df, g, {name(c, w): (F.col(c), 2 / (w + 1)) for c in cols for w in spans})


def lag_features(
    df: DataFrame, g: Grid, cols: Sequence[str], lags: Sequence[int],
    name: Callable[[str, int], str] = lambda c, k: f"{c}_lag_{k}", fill: bool = True,
) -> DataFrame:
    """Each column at each lag, one shuffle for all; with ``fill`` the first rows are filled backward."""
    names = {name(c, k): (c, k) for c in cols for k in lags}
    out = bounded(df, g, lambda w: {n: F.lag(c, k).over(w) for n, (c, k) in names.items()}, back=max(lags))
    return back_fill(stage(out), g, list(names)) if fill else out


def derivatives(
    df: DataFrame, g: Grid, diff_cols: Sequence[str], pct_cols: Sequence[str],
    acceleration: bool = True, jerk: bool = True, hold_zero: Sequence[str] = (),
) -> DataFrame:
    """First, second and third derivative columns; nulls are filled forward, then backward.

    ``diff_cols`` use differences, ``pct_cols`` relative changes. Columns in ``hold_zero`` keep their
    last non-zero derivative (slow sources that repeat values between publications).
    """
    filled = running(df, g, {f"_p_{c}": ("last", F.col(c)) for c in pct_cols}) if pct_cols else df

    def level_one(w: WindowSpec, c: str, k: int) -> Column:
        at = lambda n, j: F.lag(n, j).over(w) if j else F.col(n)
        if c in pct_cols:
            return F.try_divide(at(f"_p_{c}", k) - at(f"_p_{c}", k + 1), at(f"_p_{c}", k + 1))
        return at(c, k) - at(c, k + 1)

    def exprs(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in [*diff_cols, *pct_cols]:
            d = [level_one(w, c, k) for k in range(3)]
            out[f"{c}_return"] = d[0]
            if acceleration:
                out[f"{c}_acceleration"] = d[0] - d[1]
            if acceleration and jerk:
                out[f"{c}_jerk"] = (d[0] - d[1]) - (d[1] - d[2])
        return out

    plain = stage(bounded(filled, g, exprs, back=3).drop(*[f"_p_{c}" for c in pct_cols]))
    added = [c for c in plain.columns if c not in df.columns]
    held = [c for c in added if any(c.startswith(f"{h}_") for h in hold_zero)]
    if held:
        plain = running(plain, g, {c: ("last", F.when(F.col(c) != 0, F.col(c))) for c in held}).fillna(0.0, held)
    return fill_both(stage(plain) if held else plain, g, [c for c in added if c not in held])


def future_rows(df: DataFrame, g: Grid, n: int) -> DataFrame:
    """The next ``n`` bars after the last one of each series."""
    last = df.groupBy(*g.keys).agg(F.max(g.ts).alias("_last"))
    return last.select(
        *g.keys,
        F.explode(F.expr(f"transform(sequence(1, {n}), k -> timestampadd(SECOND, k * {g.step}, _last))")).alias(g.ts),
    )


def shift_with_forecast_row(df: DataFrame, g: Grid, cols: Sequence[str], lag: int = 1) -> DataFrame:
    """Features moved ``lag`` bars forward, with ``lag`` future bars per series to hold the newest ones."""
    longer = df.unionByName(future_rows(df, g, lag), allowMissingColumns=True)
    moved = bounded(longer, g, lambda w: {c: F.lag(c, lag).over(w) for c in cols}, back=lag)
    return back_fill(stage(moved), g, cols)


def cum_exprs(w: WindowSpec, ret: str, windows: Sequence[int]) -> dict[str, Column]:
    log = F.ln(1 + F.col(ret))
    return {f"cum_ret_{n}": full(log, w, n, F.exp(F.sum(log).over(frame(w, n))) - 1) for n in windows}


def log_cum_return(df: DataFrame, g: Grid, ret: str, windows: Sequence[int]) -> DataFrame:
    """Compound return over the last w rows, null until w returns are known."""
    return bounded(df, g, lambda w: cum_exprs(w, ret, windows), back=max(windows) - 1)


def macd(df: DataFrame, g: Grid, windows: Sequence[int], price: str = "price") -> DataFrame:
    """Fast average minus slow average (twice the span)."""
    spans = sorted({s for w in windows for s in (w, 2 * w)})
    out = ema(df, g, {f"_ema{s}": (F.col(price), 2 / (s + 1)) for s in spans})
    return out.withColumns({f"macd_{w}": F.col(f"_ema{w}") - F.col(f"_ema{2 * w}") for w in windows}).drop(
        *[f"_ema{s}" for s in spans])


def rsi_specs(windows: Sequence[int], change: str = "_chg") -> dict[str, tuple[Column, float]]:
    """Averages of gains and losses to feed ``ema``."""
    specs = {}
    for w in windows:
        specs[f"_up{w}"] = (F.greatest(F.col(change), F.lit(0.0)), 1 / w)
        specs[f"_dn{w}"] = (F.greatest(-F.col(change), F.lit(0.0)), 1 / w)
    return specs


def rsi_value(w: int) -> Column:
    return F.when(F.col(f"_dn{w}") == 0, 100.0).otherwise(100.0 - 100.0 / (1 + F.try_divide(f"_up{w}", f"_dn{w}")))


def rsi(df: DataFrame, g: Grid, windows: Sequence[int], price: str = "price") -> DataFrame:
    """Relative strength index with Wilder averages (alpha = 1/w) of gains and losses, from row one on.

    No loss so far gives 100, as a price that never moved.
    """
    moved = stage(bounded(df, g, lambda w: {"_chg": F.coalesce(diff(F.col(price), w), F.lit(0.0))}, back=1))
    specs = rsi_specs(windows)
    return ema(moved, g, specs).withColumns({f"rsi_{w}": rsi_value(w) for w in windows}).drop("_chg", *specs)


def roc_exprs(w: WindowSpec, windows: Sequence[int], price: str) -> dict[str, Column]:
    return {f"roc_{n}": F.coalesce(pct_change(F.col(price), w, n) * 100, F.lit(0.0)) for n in windows}


def roc(df: DataFrame, g: Grid, windows: Sequence[int], price: str = "price") -> DataFrame:
    """Percent change over w rows, 0 in the first w rows."""
    return bounded(df, g, lambda w: roc_exprs(w, windows, price), back=max(windows))


def ema_distance(df: DataFrame, g: Grid, windows: Sequence[int], price: str = "price") -> DataFrame:
    """EMA and the relative distance of the price to it."""
    out = ema(df, g, {f"ema_{w}": (F.col(price), 2 / (w + 1)) for w in windows})
    return out.withColumns({
        f"price_ema_{w}_diff": F.try_divide(F.col(price) - F.col(f"ema_{w}"), F.col(price)) for w in windows
    })


def bollinger_exprs(w: WindowSpec, windows: Sequence[int], price: str) -> dict[str, Column]:
    out = {}
    for n in windows:
        mean, dev = F.avg(price).over(frame(w, n)), F.stddev_pop(price).over(frame(w, n))
        out[f"price_high_bb_{n}_diff"] = F.try_divide(F.col(price) - (mean + 2 * dev), F.col(price))
        out[f"price_low_bb_{n}_diff"] = F.try_divide(F.col(price) - (mean - 2 * dev), F.col(price))
    return out


def bollinger_distance(df: DataFrame, g: Grid, windows: Sequence[int], price: str = "price") -> DataFrame:
    """Relative distance of the price to mean + and - 2 population deviations, from row one on."""
    return bounded(df, g, lambda w: bollinger_exprs(w, windows, price), back=max(windows) - 1)


# Shares of the price range at the Fibonacci levels, from low to high.
FIB_SHARES = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]


def fib_group(price: Column, low: Column, high: Column) -> dict[str, Column]:
    """Group 1..6 of the price between the levels, and the distances to the level above and below."""
    level = [low + s * (high - low) for s in FIB_SHARES]
    group = upper = lower = None
    for k in range(5, 0, -1):
        hit = price < level[k]
        if k == 5:
            group = F.when(hit, 5).otherwise(6)
            upper = F.when(hit, level[5]).otherwise(level[6])
            lower = F.when(hit, level[4]).otherwise(level[5])
        else:
            group = F.when(hit, k).otherwise(group)
            upper = F.when(hit, level[k]).otherwise(upper)
            lower = F.when(hit, level[k - 1]).otherwise(lower)
    return {"fib_group": group, "fib_upper_level_diff": upper - price, "fib_lower_level_diff": price - lower}


def rolling_extremes(df: DataFrame, g: Grid, rows: int, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Minimum or maximum of the last ``rows`` rows: ``{name: ("min" | "max", column)}``.

    A row frame is evaluated anew for every row, which costs ``rows`` steps each. For long windows the
    series is cut into sections of ``rows`` rows: the extreme is that of the section up to the row and
    of the previous section from ``rows - 1`` rows back to its end. Both grow row by row.
    """
    if rows <= 64:
        return bounded(df, g, lambda w: {
            n: (F.min if kind == "min" else F.max)(c).over(frame(w, rows)) for n, (kind, c) in specs.items()}, back=rows - 1)
    placed = position(df, g, "_p").withColumn("_sec", F.floor(F.col("_p") / rows))
    keys = ", ".join(f"`{k}`" for k in (*g.keys, "_sec"))
    grow = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ends = placed.selectExpr("*", *[
        f"{kind}(`{c}`) OVER (PARTITION BY {keys} ORDER BY _p {way} {grow}) AS `_{side}_{n}`"
        for n, (kind, c) in specs.items() for side, way in (("head", ""), ("tail", "DESC"))])
    full_back = bounded(ends.drop("_sec"), g, lambda w: {
        **{f"_old_{n}": F.lag(f"_tail_{n}", rows - 1).over(w) for n in specs},
        **{f"_start_{n}": F.min(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if kind == "min"
           else F.max(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n, (kind, c) in specs.items()},
    }, back=rows - 1)
    # Rows with less than ``rows`` predecessors have no tail; their frame starts with the series.
    pick = lambda n, kind: (F.least if kind == "min" else F.greatest)(f"_head_{n}", f"_old_{n}")
    out = full_back.withColumns({
        n: F.when(F.col(f"_old_{n}").isNull(), F.col(f"_start_{n}")).otherwise(pick(n, kind)) for n, (kind, _) in specs.items()})
    return out.select(*df.columns, *specs)


def rolling_fib(df: DataFrame, g: Grid, rows: int) -> DataFrame:
    """Fibonacci group of the price inside the low/high range of the last ``rows`` bars."""
    ranged = rolling_extremes(df, g, rows, {"_lo": ("min", "low"), "_hi": ("max", "high")})
    return ranged.withColumns(fib_group(F.col("price"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def heikin_ashi(df: DataFrame, g: Grid) -> DataFrame:
    """Heikin-Ashi candles. The open is half the previous (open + price): an average with alpha 1/2."""
    priced = df.withColumn("ha_price", ha_price())
    fed = stage(bounded(priced, g, lambda w: {"_in": ha_input(w)}, back=1))
    return with_ha_parts(ema(fed, g, {"ha_open": (F.col("_in"), 0.5)}).drop("_in"))


def ha_price() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("price")) / 4


def ha_input(w: WindowSpec) -> Column:
    return F.coalesce(F.lag(ha_price()).over(w), (F.col("open") + F.col("price")) / 2)


def with_ha_parts(df: DataFrame) -> DataFrame:
    """High, low, body and wicks from ``ha_open`` and ``ha_price``."""
    out = df.withColumns({
        "ha_high": F.greatest("ha_open", "ha_price", "high"),
        "ha_low": F.least("ha_open", "ha_price", "low"),
        "ha_top_price": F.greatest("ha_price", "ha_open"),
        "ha_bot_price": F.least("ha_price", "ha_open"),
    })
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) - F.col(b), F.col("ha_open")), F.lit(0.0))
    return out.withColumns({
        "ha_candle_body": share("ha_top_price", "ha_bot_price"),
        "ha_top_wick": share("ha_high", "ha_top_price"),
        "ha_bot_wick": share("ha_bot_price", "ha_low"),
    })


# Codes of the Heikin-Ashi candle classes and of the trend states.
HA_CODES = {
    "strong_bull_ha_candle": 0, "strong_bear_ha_candle": 1, "undefined_bull_ha_candle": 2,
    "undefined_bear_ha_candle": 3, "indecision_bull_ha_candle": 4, "indecision_bear_ha_candle": 5,
}
TREND_NAMES = {0: "bull_trend", 1: "bear_trend", 2: "indecision"}


def trend_state(df: DataFrame, g: Grid, code: str = "ha_code") -> DataFrame:
    """Trend state 0 bull, 1 bear, 2 undecided from the candle codes.

    Most code pairs force one state whatever the state was; the state only depends on the last such
    pair and on whether a first code 5 (ends a bull trend) or a first code 4 (ends a bear trend) came
    after it. So the machine is three carried positions, not a loop.
    """
    placed = position(df, g, "_p")
    coded = stage(bounded(placed, g, lambda w: {"_prev": F.lag(code).over(w)}, back=1))
    c, prev = F.col(code), F.col("_prev")
    twice = F.coalesce(c == prev, F.lit(False))
    forced = (
        F.when(prev.isNull(), 0)  # a series starts in a bull trend
        .when((c == 0) | ((c == 2) & twice), 0)
        .when((c == 1) | ((c == 3) & twice), 1)
        .when(((c == 4) | (c == 5)) & twice, 2)
    )
    out = running(coded, g, {
        "_force": ("last", F.when(forced.isNotNull(), F.struct(F.col("_p").alias("at"), forced.alias("state")))),
        "_five": ("last", F.when((c == 5) & ~twice & prev.isNotNull(), F.col("_p"))),
        "_four": ("last", F.when((c == 4) & ~twice & prev.isNotNull(), F.col("_p"))),
    })
    since = lambda event: F.coalesce(F.col(event) > F.col("_force.at"), F.lit(False))
    state = (
        F.when((F.col("_force.state") == 0) & since("_five"), 2)
        .when((F.col("_force.state") == 1) & since("_four"), 2)
        .otherwise(F.col("_force.state"))
    )
    return out.withColumn("trend", state).drop("_p", "_prev", "_force", "_five", "_four")


def interpolate(df: DataFrame, g: Grid, cols: Sequence[str]) -> DataFrame:
    """Linear by row position, forward only: leading nulls stay, trailing nulls take the last value."""
    placed = position(df, g, "_p")
    specs = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_p"))
        specs[f"_ap_{c}"], specs[f"_av_{c}"] = ("last", at), ("last", F.col(c).cast("double"))
        specs[f"_zp_{c}"], specs[f"_zv_{c}"] = ("next", at), ("next", F.col(c).cast("double"))
    out = running(placed, g, specs)
    line = {}
    for c in cols:
        ap, av, zp, zv = (F.col(f"_{n}_{c}") for n in ("ap", "av", "zp", "zv"))
        line[c] = F.coalesce(F.col(c), av + F.try_divide(zv - av, (zp - ap).cast("double")) * (F.col("_p") - ap), av)
    return out.withColumns(line).select(*df.columns)


def leading_fill(df: DataFrame, g: Grid, mids: dict[str, Column]) -> DataFrame:
    """Rows before a column's first known value take the given middle; later nulls are filled backward,
    then forward. A column that is all null takes the middle in every row but the last, which then
    takes its neighbour's."""
    specs = {}
    for c in mids:
        specs[f"_n_{c}"], specs[f"_l_{c}"] = ("next", F.col(c)), ("last", F.col(c))
    out = running(df, g, specs)
    return out.withColumns({
        c: F.when(F.col(f"_l_{c}").isNull(), F.coalesce(F.col(c), mid)).otherwise(F.coalesce(F.col(f"_n_{c}"), F.col(f"_l_{c}")))
        for c, mid in mids.items()
    }).select(*df.columns)


def cumulative_return(df: DataFrame, g: Grid, ret: str, name: str = "cum_ret") -> DataFrame:
    """Running product of (1 + r) minus 1, as a sum of logs with the sign and zeros carried beside it."""
    growth = 1 + F.col(ret)
    out = running(df, g, {
        "_log": ("sum", F.when(growth != 0, F.ln(F.abs(growth)))),
        "_neg": ("count", F.when(growth < 0, 1)),
        "_zero": ("count", F.when(growth == 0, 1)),
    })
    size = F.exp(F.coalesce("_log", F.lit(0.0))) * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return out.withColumn(name, F.when(F.col("_zero") > 0, -1.0).otherwise(size - 1)).drop("_log", "_neg", "_zero")


def publication_shift(df: DataFrame, g: Grid, shifts: dict[str, int], max_shift: int = 12) -> DataFrame:
    """Each column moved by its own number of bars (at most ``max_shift``), then filled backward."""
    capped = {c: min(n, max_shift) for c, n in shifts.items() if n > 0}
    moved = bounded(df, g, lambda w: {c: F.lag(c, n).over(w) for c, n in capped.items()}, back=max(capped.values()))
    return back_fill(stage(moved), g, list(capped))


def session_shift(df: DataFrame, keys: Sequence[str], probe: str, cols: Sequence[str]) -> DataFrame:
    """Days whose last print came before 19:00 although rows go past 19:xx are moved late by the gap.

    Half-hour rows; a day of a series holds at most 48 rows, so the day is the unit of work.
    """
    day = F.window("ts", "1 day")["start"]
    w = Window.partitionBy(*keys, "_day")
    timed = df.withColumn("_day", day).withColumn("_rn", F.row_number().over(w.orderBy("ts")))
    last_print = F.max(F.when(F.col(probe).isNotNull(), F.col("ts"))).over(w)
    gap = (19 - F.hour(last_print)) * 2 + F.floor((30 - F.minute(last_print)) / 30)
    needed = (F.hour(last_print) < 19) & (F.hour(F.max("ts").over(w)) > 19)
    timed = timed.withColumn("_gap", F.when(needed, gap).otherwise(0).cast("int"))
    rows = F.collect_list(F.struct(*[F.col(c) for c in cols])).over(w.orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    source = F.when(F.col("_rn") > F.col("_gap"), F.get(rows, F.col("_rn") - F.col("_gap") - 1))
    return timed.withColumn("_src", source).withColumns({c: F.col(f"_src.{c}") for c in cols}).select(*df.columns)


def naive_last_value(df: DataFrame, g: Grid, target: str, back: int) -> DataFrame:
    """Forecast: the target ``back`` bars ago."""
    out = bounded(df, g, lambda w: {"forecast": F.lag(target, back).over(w)}, back=back)
    return back_fill(stage(out), g, ["forecast"])


def naive_weighted_ma(
    df: DataFrame, g: Grid, target: str, period: int, weighted: bool = True, newest_first: bool = False,
) -> DataFrame:
    """Forecast: weighted mean of the previous ``period`` targets.

    Weights are equal or 1 - p/period. As in the known definition the oldest row has the largest
    weight; ``newest_first`` turns that round.
    """
    weights = [1 - p / period if weighted else 1.0 for p in range(period)]
    if newest_first:
        weights.reverse()

    def exprs(w: WindowSpec) -> dict[str, Column]:
        terms = [F.lag(target, period - p).over(w) * weights[p] for p in range(period)]
        return {"forecast": sum(terms[1:], terms[0]) / sum(weights)}
    return back_fill(stage(bounded(df, g, exprs, back=period)), g, ["forecast"])


def sliding_sequences(df: DataFrame, g: Grid, cols: Sequence[str], target: str, length: int) -> DataFrame:
    """Blocks of the previous ``length`` feature rows with the target of the row; full blocks only."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        past = w.rowsBetween(-length, -1)
        return {"sequence": F.collect_list(F.array(*cols)).over(past), "_y": F.col(target)}
    return bounded(df, g, exprs, back=length).where(F.size("sequence") == length).select(
        *g.keys, g.ts, "sequence", F.col("_y").alias("target"))


def fractional_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Ascending rank with ties averaged; nulls get no rank. ``keys`` bound the group (one feature list)."""
    w = Window.partitionBy(*keys, F.col(value).isNull())
    rank = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, value)) - 1) / 2
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))


def cumulative_share(df: DataFrame, keys: Sequence[str], item: str, weight: str) -> DataFrame:
    """Running share of the total, largest weight first. ``keys`` bound the group (one feature list)."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(F.col(weight).desc(), item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("share", F.try_divide(F.sum(weight).over(run), F.sum(weight).over(w)))


def running_next(df: DataFrame, g: Grid, names: dict[str, str]) -> DataFrame:
    """Columns ``{new: source}`` with the next known value of the source, the last one at the end."""
    specs = {}
    for n, c in names.items():
        specs[f"_nx_{n}"], specs[f"_lt_{n}"] = ("next", F.col(c)), ("last", F.col(c))
    out = running(df, g, specs)
    return out.withColumns({n: F.coalesce(f"_nx_{n}", f"_lt_{n}") for n in names}).drop(*specs)
