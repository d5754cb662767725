"""Window queries (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import ha_candle_code
from barloom.operators import windows as win
from barloom.operators.bars import gap_fill, with_derivatives
from barloom.operators.blocks import Grid
from barloom.plans.base import (
    DENSE, GRID_, HALF, HOUR, RET, SIX, USER_DENSE, W, half_bars, hour_dense, hour_grid, hour_returns, sql_grid,
    user_dense,
)
from barloom.plans.registry import query
from barloom.session import join_staged, stage

# Windows of an hourly panel, in bars.
WINDOWS = [6, 12, 24]


def ema_sql(alphas: dict[str, tuple[str, float]], source: str, prefix: str = DENSE, keep: str = "", out: str = "em") -> str:
    """CTE chain whose table ``out`` holds exponential averages as explicit sums over all earlier rows."""
    values = ", ".join(f"{v} AS x_{n}" for n, (v, _) in alphas.items())
    cols = ", ".join(
        f"sum(CASE WHEN b.rn = 1 THEN 1.0 ELSE {a!r} END * pow({1 - a!r}, a.rn - b.rn) * b.x_{n}) AS {n}"
        for n, (_, a) in alphas.items()
    )
    group = ", ".join(["a.series", "a.ts"] + [f"a.{k}" for k in keep.split()])
    keeps = "".join(f", {k}" for k in keep.split())
    return (
        f"{prefix}, {out}_n AS (SELECT series, ts{keeps}, {values}, row_number() OVER ({W}) AS rn FROM {source}), "
        f"{out} AS (SELECT {group}, {cols} FROM {out}_n a JOIN {out}_n b ON a.series = b.series AND b.rn <= a.rn GROUP BY {group})"
    )


def ff(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def bf(c: str) -> str:
    return f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def roll(f: str, c: str, n: int) -> str:
    return f"{f}({c}) OVER ({W} ROWS {n - 1} PRECEDING)"


def lagged(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({W})"


@query("returns", "series:s ts:t ret:d", f"""{GRID_}, f AS (SELECT series, ts, last_value(price IGNORE NULLS) OVER ({W}) AS p FROM grid)
SELECT series, ts, p / lag(p) OVER ({W}) - 1 AS ret FROM f""")
def _(spark, d):
    return with_derivatives(hour_grid(spark, d), HOUR).withColumnRenamed("return", "ret")


_roll = {f"{s}_{w}": (s, w) for w in WINDOWS for s in ("mean", "std", "min", "max", "range")}


@query("rolling_stats", "series:s ts:t " + " ".join(f"{n}:d" for n in _roll), f"""{USER_DENSE},
r AS (SELECT series, ts, {", ".join(
    {"mean": f"avg(price) OVER ({W} ROWS {w - 1} PRECEDING)", "std": f"stddev_samp(price) OVER ({W} ROWS {w - 1} PRECEDING)",
     "min": f"min(price) OVER ({W} ROWS {w - 1} PRECEDING)", "max": f"max(price) OVER ({W} ROWS {w - 1} PRECEDING)",
     "range": f"max(price) OVER ({W} ROWS {w - 1} PRECEDING) - min(price) OVER ({W} ROWS {w - 1} PRECEDING)"}[s] + f" AS {n}"
    for n, (s, w) in _roll.items())} FROM udense)
SELECT * REPLACE ({", ".join(f"first_value({n} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {n}" for n in _roll if n.startswith("std"))}) FROM r""")
def _(spark, d):
    return win.rolling_stats(user_dense(spark, d), SIX, ["price"], WINDOWS, name=lambda c, s, w: f"{s}_{w}")


@query("ema_features", "series:s ts:t " + " ".join(f"ema_{w}:d" for w in WINDOWS),
       ema_sql({f"ema_{w}": ("price", 2 / (w + 1)) for w in WINDOWS}, "udense", USER_DENSE) + " SELECT * FROM em")
def _(spark, d):
    return win.ema_features(user_dense(spark, d), SIX, ["price"], WINDOWS, name=lambda c, w: f"ema_{w}")


# Lags of the hourly feature set and windows of the indicators.
LAGS = [1, 2, 3, 5, 11, 23, 167, 719]
IND = [10, 20, 30]

_der = [f"{c}_{s}" for c in ("volume", "price") for s in ("return", "acceleration", "jerk")]


@query("derivatives", "series:s ts:t " + " ".join(f"{c}:d" for c in _der), f"""{DENSE},
a AS (SELECT series, ts, volume - {lagged("volume")} AS volume_return, price / {lagged("price")} - 1 AS price_return FROM dense),
b AS (SELECT *, volume_return - {lagged("volume_return")} AS volume_acceleration, price_return - {lagged("price_return")} AS price_acceleration FROM a),
c AS (SELECT *, volume_acceleration - {lagged("volume_acceleration")} AS volume_jerk,
 price_acceleration - {lagged("price_acceleration")} AS price_jerk FROM b)
SELECT series, ts, {", ".join(f"coalesce({ff(c)}, {bf(c)}) AS {c}" for c in _der)} FROM c""")
def _(spark, d):
    return win.derivatives(hour_dense(spark, d), HOUR, ["volume"], ["price"])


@query("lag_features", "series:s ts:t " + " ".join(f"price_lag_{k}:d" for k in LAGS), f"""{DENSE},
a AS (SELECT series, ts, {", ".join(f"{lagged('price', k)} AS price_lag_{k}" for k in LAGS)} FROM dense)
SELECT series, ts, {", ".join(f"{bf(f'price_lag_{k}')} AS price_lag_{k}" for k in LAGS)} FROM a""")
def _(spark, d):
    return win.lag_features(hour_dense(spark, d), HOUR, ["price"], LAGS)


@query("feature_shift_with_forecast_row", "series:s ts:t price:d volume:d", f"""{DENSE},
u AS (SELECT series, ts, price, volume FROM dense UNION ALL SELECT series, max(ts) + INTERVAL 1 HOUR, NULL, NULL FROM dense GROUP BY series),
a AS (SELECT series, ts, {lagged("price")} AS price, {lagged("volume")} AS volume FROM u)
SELECT series, ts, {bf("price")} AS price, {bf("volume")} AS volume FROM a""")
def _(spark, d):
    return win.shift_with_forecast_row(hour_dense(spark, d).select("series", "ts", "price", "volume"), HOUR, ["price", "volume"])


@query("log_cum_return", "series:s ts:t " + " ".join(f"cum_ret_{w}:d" for w in IND), f"""{RET}
SELECT series, ts, {", ".join(f'CASE WHEN {roll("count", chr(34) + "return" + chr(34), w)} = {w} THEN exp({roll("sum", "ln(1 + " + chr(34) + "return" + chr(34) + ")", w)}) - 1 END AS cum_ret_{w}' for w in IND)} FROM rets""")
def _(spark, d):
    return win.log_cum_return(hour_returns(spark, d), HOUR, "return", IND)


@query("macd", "series:s ts:t " + " ".join(f"macd_{w}:d" for w in IND),
       ema_sql({f"e{s}": ("price", 2 / (s + 1)) for s in (10, 20, 30, 40, 60)}, "dense")
       + " SELECT series, ts, e10 - e20 AS macd_10, e20 - e40 AS macd_20, e30 - e60 AS macd_30 FROM em")
def _(spark, d):
    return win.macd(hour_dense(spark, d), HOUR, IND)


@query("rsi", "series:s ts:t " + " ".join(f"rsi_{w}:d" for w in IND),
       ema_sql({f"{s}{w}": (f"greatest({sign}coalesce(chg, 0), 0)", 1 / w) for w in IND for s, sign in (("up", ""), ("dn", "-"))},
               "chg", f"{DENSE}, chg AS (SELECT series, ts, price - {lagged('price')} AS chg FROM dense)")
       + " SELECT series, ts, " + ", ".join(f"CASE WHEN dn{w} = 0 THEN 100 ELSE 100 - 100 / (1 + up{w} / dn{w}) END AS rsi_{w}" for w in IND) + " FROM em")
def _(spark, d):
    return win.rsi(hour_dense(spark, d), HOUR, IND)


@query("roc", "series:s ts:t " + " ".join(f"roc_{w}:d" for w in IND),
       f"{DENSE} SELECT series, ts, " + ", ".join(f"coalesce((price - {lagged('price', w)}) / {lagged('price', w)} * 100, 0) AS roc_{w}" for w in IND) + " FROM dense")
def _(spark, d):
    return win.roc(hour_dense(spark, d), HOUR, IND)


@query("ema_distance", "series:s ts:t " + " ".join(f"ema_{w}:d price_ema_{w}_diff:d" for w in IND),
       ema_sql({f"ema_{w}": ("price", 2 / (w + 1)) for w in IND}, "dense", keep="price")
       + " SELECT *, " + ", ".join(f"(price - ema_{w}) / price AS price_ema_{w}_diff" for w in IND) + " FROM em")
def _(spark, d):
    return win.ema_distance(hour_dense(spark, d), HOUR, IND)


_bb = [f"price_{s}_bb_{w}_diff" for w in IND for s in ("high", "low")]


@query("bollinger_distance", "series:s ts:t " + " ".join(f"{c}:d" for c in _bb),
       f"{DENSE} SELECT series, ts, " + ", ".join(
           f"(price - ({roll('avg', 'price', w)} {sg} 2 * {roll('stddev_pop', 'price', w)})) / price AS price_{s}_bb_{w}_diff"
           for w in IND for s, sg in (("high", "+"), ("low", "-"))) + " FROM dense")
def _(spark, d):
    return win.bollinger_distance(hour_dense(spark, d), HOUR, IND)


_fib_lv = [f"(lo + {s} * (hi - lo))" for s in win.FIB_SHARES]
FIB_SQL = f"""SELECT *, CASE {" ".join(f"WHEN price < {_fib_lv[k]} THEN {k}" for k in range(1, 6))} ELSE 6 END AS fib_group FROM (SELECT *,
 {roll("min", "low", 744)} AS lo, {roll("max", "high", 744)} AS hi FROM dense)"""


@query("rolling_fib", "series:s ts:t fib_group:i fib_upper_level_diff:d fib_lower_level_diff:d", f"""{DENSE}, f AS ({FIB_SQL})
SELECT series, ts, fib_group, CASE fib_group {" ".join(f"WHEN {k} THEN {_fib_lv[k]}" for k in range(1, 7))} END - price AS fib_upper_level_diff,
 price - CASE fib_group {" ".join(f"WHEN {k} THEN {_fib_lv[k - 1]}" for k in range(1, 7))} END AS fib_lower_level_diff FROM f""")
def _(spark, d):
    return win.rolling_fib(hour_dense(spark, d), HOUR, 24 * 31)


_ha = ["ha_price", "ha_open", "ha_high", "ha_low", "ha_top_price", "ha_bot_price", "ha_candle_body", "ha_top_wick", "ha_bot_wick"]
HA_SQL = (
    ema_sql({"ha_open": ("x", 0.5)}, "hain",
            f"{DENSE}, hp AS (SELECT *, (open + high + low + price) / 4 AS ha_price FROM dense), "
            f"hain AS (SELECT *, coalesce({lagged('ha_price')}, (open + price) / 2) AS x FROM hp)", keep="open high low price ha_price")
    + """, ha AS (SELECT *, (ha_top_price - ha_bot_price) / ha_open AS ha_candle_body, (ha_high - ha_top_price) / ha_open AS ha_top_wick,
 (ha_bot_price - ha_low) / ha_open AS ha_bot_wick FROM (SELECT *, greatest(ha_open, ha_price, high) AS ha_high, least(ha_open, ha_price, low) AS ha_low,
 greatest(ha_open, ha_price) AS ha_top_price, least(ha_open, ha_price) AS ha_bot_price FROM em) x)"""
)
_fuzz = 1e-9
HA_TYPE_SQL = HA_SQL + """, hat AS (SELECT *, ha_candle_body + ha_top_wick + ha_bot_wick AS tot FROM ha),
hac AS (SELECT *, CASE WHEN ha_price >= ha_open THEN
 CASE WHEN ha_bot_wick <= 0.05 * tot AND ha_candle_body >= 0.5 * tot THEN 0 WHEN ha_top_wick >= 0.38 * tot AND ha_bot_wick >= 0.38 * tot THEN 4 ELSE 2 END
 ELSE CASE WHEN ha_top_wick <= 0.05 * tot AND ha_candle_body >= 0.5 * tot THEN 1 WHEN ha_top_wick >= 0.38 * tot AND ha_bot_wick >= 0.38 * tot THEN 5 ELSE 3 END END AS ha_code FROM hat)"""
# The state machine row by row, as a recursive table.
TREND_SQL = HA_TYPE_SQL.replace("WITH bars", "WITH RECURSIVE bars", 1) + f""", code AS (SELECT series, ts, ha_code AS c, lag(ha_code) OVER ({W}) AS p, row_number() OVER ({W}) AS rn FROM hac),
tr AS (SELECT series, ts, rn, 0 AS state FROM code WHERE rn = 1 UNION ALL
 SELECT n.series, n.ts, n.rn, CASE
  WHEN t.state = 0 THEN CASE WHEN c = 1 OR (c = 3 AND p = 3) THEN 1 WHEN (c = 4 AND p = 4) OR c = 5 THEN 2 ELSE 0 END
  WHEN t.state = 1 THEN CASE WHEN c = 0 OR (c = 2 AND p = 2) THEN 0 WHEN (c = 5 AND p = 5) OR c = 4 THEN 2 ELSE 1 END
  ELSE CASE WHEN c = 0 OR (c = 2 AND p = 2) THEN 0 WHEN c = 1 OR (c = 3 AND p = 3) THEN 1 ELSE 2 END END
 FROM tr t JOIN code n ON n.series = t.series AND n.rn = t.rn + 1)"""


@query("heikin_ashi", "series:s ts:t " + " ".join(f"{c}:d" for c in _ha), HA_SQL + " SELECT * FROM ha")
def _(spark, d):
    return win.heikin_ashi(hour_dense(spark, d), HOUR)


@query("trend_state", "series:s ts:t trend:i", TREND_SQL + " SELECT series, ts, state AS trend FROM tr")
def _(spark, d):
    candles = stage(win.heikin_ashi(hour_dense(spark, d), HOUR).select("series", "ts", ha_candle_code().alias("ha_code")))
    return win.trend_state(candles, HOUR)


@query("ffill", "series:s ts:t price:d high:d", f"{GRID_} SELECT series, ts, {ff('price')} AS price, {ff('high')} AS high FROM grid")
def _(spark, d):
    return win.forward_fill(hour_grid(spark, d), HOUR, ["price", "high"])


@query("bfill", "series:s ts:t price:d low:d", f"{GRID_} SELECT series, ts, {bf('price')} AS price, {bf('low')} AS low FROM grid")
def _(spark, d):
    return win.back_fill(hour_grid(spark, d), HOUR, ["price", "low"])


def interpolate_sql(source: str, c: str, out: str) -> str:
    return f"""SELECT * EXCLUDE (a_rn, a_x, z_rn, z_x, rn), CASE WHEN {c} IS NOT NULL THEN {c} WHEN z_rn IS NULL THEN a_x ELSE a_x + (z_x - a_x) * (rn - a_rn) / (z_rn - a_rn) END AS {out}
FROM (SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER ({W}) AS a_rn, last_value({c} IGNORE NULLS) OVER ({W}) AS a_x,
 first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z_rn,
 first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z_x
 FROM (SELECT *, row_number() OVER ({W}) AS rn FROM {source}))"""


@query("interpolate_linear", "series:s ts:t price:d", f"{GRID_} SELECT series, ts, p2 AS price FROM ({interpolate_sql('grid', 'price', 'p2')})")
def _(spark, d):
    return win.interpolate(hour_grid(spark, d), HOUR, ["price"])


@query("leading_fill_mid_threshold", "series:s ts:t price:d", f"""{GRID_}, thin AS (SELECT series, ts, CASE WHEN high > 100 THEN price END AS x FROM grid),
mid AS (SELECT series, avg(x) AS m FROM thin GROUP BY series),
f AS (SELECT t.*, {ff("x")} AS l, {bf("x")} AS n, m FROM thin t JOIN mid USING (series))
SELECT series, ts, CASE WHEN l IS NULL THEN coalesce(x, m) ELSE coalesce(n, l) END AS price FROM f""")
def _(spark, d):
    thin = hour_grid(spark, d).select("series", "ts", F.when(F.col("high") > 100, F.col("price")).alias("x"))
    mid = thin.groupBy("series").agg(F.avg("x").alias("m"))
    return win.leading_fill(join_staged(thin, mid, ["series"]), HOUR, {"x": F.col("m")}).withColumnRenamed("x", "price")


@query("cumulative_return", "series:s ts:t cum_ret:d", f"""{RET}, g AS (SELECT series, ts, 0.001 * coalesce("return", 0) AS r FROM rets)
SELECT series, ts, exp(sum(ln(1 + r)) OVER ({W})) - 1 AS cum_ret FROM g""")
def _(spark, d):
    small = hour_returns(spark, d).select("series", "ts", (0.001 * F.coalesce("return", F.lit(0.0))).alias("r"))
    return win.cumulative_return(small, HOUR, "r")


SHIFTS = {"price": 1, "volume": 3, "high": 20}


@query("publication_shift", "series:s ts:t price:d volume:d high:d", f"""{DENSE}, a AS (SELECT series, ts, {lagged("price", 1)} AS price, {lagged("volume", 3)} AS volume, {lagged("high", 12)} AS high FROM dense)
SELECT series, ts, {bf("price")} AS price, {bf("volume")} AS volume, {bf("high")} AS high FROM a""")
def _(spark, d):
    return win.publication_shift(hour_dense(spark, d), HOUR, SHIFTS, max_shift=12)


SESSION_SQL = f"""{HALF}, halfgrid AS ({sql_grid('half', 1800)}),
prints AS (SELECT series, ts, CASE WHEN high > 90 THEN price END AS price FROM halfgrid),
d AS (SELECT *, row_number() OVER (PARTITION BY series, date_trunc('day', ts) ORDER BY ts) AS rn,
 max(CASE WHEN price IS NOT NULL THEN ts END) OVER (PARTITION BY series, date_trunc('day', ts)) AS lp, max(ts) OVER (PARTITION BY series, date_trunc('day', ts)) AS le FROM prints),
s AS (SELECT *, CASE WHEN hour(lp) < 19 AND hour(le) > 19 THEN (19 - hour(lp)) * 2 + CAST(floor((30 - minute(lp)) / 30) AS INT) ELSE 0 END AS gap FROM d)"""


@query("session_shift", "series:s ts:t price:d", f"""{SESSION_SQL}
SELECT a.series, a.ts, b.price FROM s a LEFT JOIN s b ON b.series = a.series AND date_trunc('day', b.ts) = date_trunc('day', a.ts) AND b.rn = a.rn - a.gap""")
def _(spark, d):
    half = gap_fill(half_bars(spark, d), Grid(step=1800))
    prints = half.select("series", "ts", F.when(F.col("high") > 90, F.col("price")).alias("price"))
    return win.session_shift(prints, ["series"], "price", ["price"])


@query("naive_last_value", "series:s ts:t forecast:d", f"""{RET}, a AS (SELECT series, ts, {lagged('"return"', 3)} AS f FROM rets)
SELECT series, ts, {bf("f")} AS forecast FROM a""")
def _(spark, d):
    return win.naive_last_value(hour_returns(spark, d), HOUR, "return", 3)


@query("sliding_sequences", "series:s ts:t k:i x:d v:d target:d", f"""{DENSE}
SELECT a.series, a.ts, 4 - CAST(date_diff('hour', b.ts, a.ts) AS BIGINT) AS k, b.price AS x, b.volume AS v, a.price AS target
FROM dense a JOIN dense b ON b.series = a.series AND b.ts >= a.ts - INTERVAL 4 HOUR AND b.ts < a.ts
JOIN (SELECT series, min(ts) AS lo FROM dense GROUP BY series) m ON m.series = a.series AND a.ts >= m.lo + INTERVAL 4 HOUR""")
def _(spark, d):
    seq = win.sliding_sequences(hour_dense(spark, d), HOUR, ["price", "volume"], "price", 4)
    return seq.select("series", "ts", F.posexplode("sequence").alias("k", "row"), "target").select(
        "series", "ts", "k", F.col("row")[0].alias("x"), F.col("row")[1].alias("v"), "target")


_mw = [1 - p / 5 for p in range(5)]


@query("naive_weighted_ma", "series:s ts:t forecast:d", f"""{RET}, a AS (SELECT series, ts, ({" + ".join(f'{_mw[p]!r} * ' + lagged(chr(34) + "return" + chr(34), 5 - p) for p in range(5))}) / {sum(_mw)!r} AS f FROM rets)
SELECT series, ts, {bf("f")} AS forecast FROM a""")
def _(spark, d):
    return win.naive_weighted_ma(hour_returns(spark, d), HOUR, "return", 5)


# One small list per series: how strongly each bar column moves with the price.
_CORR_COLS = ["open", "high", "low", "volume", "ticks"]
SCORES_SQL = f"{DENSE}, scores AS (" + " UNION ALL ".join(
    f"SELECT series, '{c}' AS feature, abs(corr(price, {c})) AS score FROM dense GROUP BY series" for c in _CORR_COLS) + ")"


def column_scores(spark, d):
    wide = hour_dense(spark, d).groupBy("series").agg(*[F.abs(F.corr("price", c)).alias(c) for c in _CORR_COLS])
    return wide.unpivot(["series"], _CORR_COLS, "feature", "score")


@query("cumulative_share", "series:s feature:s share:d", f"""{SCORES_SQL}
SELECT series, feature, sum(score) OVER (PARTITION BY series ORDER BY score DESC, feature ROWS UNBOUNDED PRECEDING) / sum(score) OVER (PARTITION BY series) AS share FROM scores""")
def _(spark, d):
    return win.cumulative_share(column_scores(spark, d), ["series"], "feature", "score")


@query("fractional_rank", "series:s feature:s rank:d", f"""{SCORES_SQL}, r AS (SELECT series, feature, CASE WHEN feature <> 'open' THEN round(score, 1) END AS x FROM scores)
SELECT a.series, a.feature, CASE WHEN a.x IS NOT NULL THEN (SELECT count(*) FILTER (b.x < a.x) + (count(*) FILTER (b.x = a.x) + 1) / 2.0 FROM r b WHERE b.series = a.series) END AS rank FROM r a""")
def _(spark, d):
    s = column_scores(spark, d).withColumn("x", F.when(F.col("feature") != "open", F.round("score", 1)))
    return win.fractional_rank(s, ["series"], "x")
