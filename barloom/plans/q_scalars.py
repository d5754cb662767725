"""Scalar function queries (survey section 2.8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions import scalars as sc
from barloom.functions.holidays import FIXED_DATES, NTH_WEEKDAYS, is_holiday
from barloom.functions.time import epoch_micros, epoch_millis_to_ts, epoch_seconds, from_epoch
from barloom.operators import windows as win
from barloom.operators.aggregate import band_thresholds
from barloom.operators.blocks import bounded
from barloom.plans.base import BARS, DAYS, HALF, HOUR, RET, W, day_bars, half_bars, hour_bars, hour_dense, hour_returns
from barloom.plans.q_windows import HA_TYPE_SQL
from barloom.plans.registry import query
from barloom.session import join_staged
from barloom.sources.tables import table

SHAPE_SQL = """ln(1 + volume) AS log_volume, abs(price - open) / open AS candle_body, abs(high - low) / open AS candle_range,
 (high - greatest(price, open)) / open AS candle_top_wick, (least(price, open) - low) / open AS candle_bot_wick"""


@query("math_scalars", "series:s ts:t log_volume:d candle_body:d candle_range:d candle_top_wick:d candle_bot_wick:d",
       f"{BARS} SELECT series, ts, {SHAPE_SQL} FROM bars")
def _(spark, d):
    return hour_bars(spark, d).withColumns(sc.candle_shape())


@query("cyclic_time", "series:s ts:t hod_sin:d dow_sin:d dom_sin:d hod_cos:d day_cos:d dam_cos:d", f"""{BARS} SELECT series, ts,
 sin(2 * pi() * hour(ts) / 24) AS hod_sin, cos(2 * pi() * hour(ts) / 24) AS hod_cos,
 sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos,
 sin(2 * pi() * day(ts) / 31) AS dom_sin, cos(2 * pi() * day(ts) / 31) AS dam_cos FROM bars""")
def _(spark, d):
    return hour_bars(spark, d).withColumns(sc.cyclic_time("ts"))


@query("calendar_parts", "series:s ts:t hour:i weekday:i day:i", f"""{BARS} SELECT series, ts, hour(ts) AS hour,
 isodow(ts) - 1 AS weekday, day(ts) AS day FROM bars""")
def _(spark, d):
    return hour_bars(spark, d).withColumns(sc.calendar_parts("ts"))


def _holiday_dates(first: int, last: int) -> str:
    """The same calendar, listed day by day, as a SQL list."""
    days = set()
    for y in range(first, last + 1):
        for m, dom, since in FIXED_DATES:
            if y >= since:
                day = dt.date(y, m, dom)
                days.add(day)
                if day.weekday() == 5:
                    days.add(day - dt.timedelta(days=1))
                if day.weekday() == 6:
                    days.add(day + dt.timedelta(days=1))
        for m, wd, nth, since in NTH_WEEKDAYS:
            if y >= since:
                hits = [day for k in range(31) for day in [dt.date(y, m, 1) + dt.timedelta(days=k)]
                        if day.month == m and day.weekday() == wd]
                days.add(hits[nth - 1] if nth > 0 else hits[-1])
    return ", ".join(f"DATE '{x}'" for x in sorted(days))


HOLIDAYS = _holiday_dates(1991, 2026)


@query("holiday_flag", "series:s ts:t is_holiday:b", f"{DAYS} SELECT series, ts, CAST(ts AS DATE) IN ({HOLIDAYS}) AS is_holiday FROM days")
def _(spark, d):
    return day_bars(spark, d).withColumn("is_holiday", is_holiday("ts"))


@query("market_hours", "series:s ts:t market_open:b", f"""{HALF} SELECT series, ts, isodow(ts) <= 5 AND
 CAST(ts AS TIME) BETWEEN TIME '13:30:00' AND TIME '19:30:00' AND CAST(ts AS DATE) NOT IN ({HOLIDAYS}) AS market_open FROM half""")
def _(spark, d):
    return half_bars(spark, d).withColumn("market_open", sc.is_market_time("ts") & ~is_holiday("ts"))


@query("partition_keys", "year_month:s year_bimester:s year_quarter:s n:i", """SELECT year(l_shipdate) || '_' || month(l_shipdate) AS year_month,
 year(l_shipdate) || '_' || CAST(ceil(month(l_shipdate) / 2.0) AS INT) AS year_bimester, year(l_shipdate) || '_' || quarter(l_shipdate) AS year_quarter,
 count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, d):
    keys = sc.partition_keys("l_shipdate")
    return table(spark, d, "lineitem").groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))


BAND_SQL = f"""{RET}, th AS (SELECT series, {", ".join(f'avg({c}) - 1.96 * stddev_samp({c}) AS {n}_low, avg({c}) + 1.96 * stddev_samp({c}) AS {n}_high'
    for n, c in (("return", '"return"'), ("acceleration", "acceleration"), ("jerk", "jerk")))} FROM rets GROUP BY series)"""


def _band_case(n: str) -> str:
    c = f'"{n}"'
    return (f"CASE WHEN {c} IS NULL THEN '{n}_no_outlier' WHEN {c} <= {n}_low THEN '{n}_low_outlier' "
            f"WHEN {c} <= {n}_high THEN '{n}_no_outlier' ELSE '{n}_top_outlier' END AS {n}_outlier")


@query("band_class", "series:s ts:t return_outlier:s acceleration_outlier:s jerk_outlier:s",
       f"{BAND_SQL} SELECT r.series, r.ts, {', '.join(_band_case(n) for n in ('return', 'acceleration', 'jerk'))} FROM rets r JOIN th USING (series)")
def _(spark, d):
    names = ["return", "acceleration", "jerk"]
    rets = hour_returns(spark, d)
    both = join_staged(rets, band_thresholds(rets, ["series"], names, 1.96), ["series"])
    return both.withColumns({
        f"{n}_outlier": sc.band_class(F.col(n), F.col(f"{n}_low"), F.col(f"{n}_high"), n) for n in names})


def _pair(bull: str, bear: str) -> str:
    return f"CASE WHEN \"return\" >= 0 THEN '{bull}' ELSE '{bear}' END"


CANDLE_SQL = f"""CASE WHEN candle_body >= 0.78 * tot THEN {_pair('strong_bull_candle', 'strong_bear_candle')}
 WHEN candle_body >= 0.5 * tot THEN {_pair('bull_candle', 'bear_candle')}
 WHEN candle_bot_wick >= 0.6 * tot THEN {_pair('hammer_candle', 'hanging_man_candle')}
 WHEN candle_top_wick >= 0.6 * tot THEN {_pair('inverted_hammer_candle', 'shooting_star_candle')}
 WHEN candle_top_wick >= 0.38 * tot AND candle_bot_wick >= 0.38 * tot THEN {_pair('indecision_bull_candle', 'indecision_bear_candle')}
 ELSE {_pair('undefined_bull_candle', 'undefined_bear_candle')} END"""


@query("candle_type", "series:s ts:t candle_type:s", f"""{RET} SELECT series, ts, {CANDLE_SQL} AS candle_type
 FROM (SELECT *, candle_body + candle_top_wick + candle_bot_wick AS tot FROM (SELECT *, {SHAPE_SQL} FROM rets))""")
def _(spark, d):
    shaped = hour_returns(spark, d).withColumns(sc.candle_shape())
    return shaped.withColumn("candle_type", sc.candle_type(
        F.col("candle_body"), F.col("candle_top_wick"), F.col("candle_bot_wick"), F.col("return")))


@query("ha_candle_type", "series:s ts:t ha_candle_type:s", HA_TYPE_SQL + " SELECT series, ts, CASE ha_code "
       + " ".join(f"WHEN {v} THEN '{k}'" for k, v in win.HA_CODES.items()) + " END AS ha_candle_type FROM hac")
def _(spark, d):
    names = {v: k for k, v in win.HA_CODES.items()}
    return win.heikin_ashi(hour_dense(spark, d), HOUR).withColumn("ha_candle_type", sc.value_map(sc.ha_candle_code(), names))


# Independent form of the normal distribution: its power series, each term through the gamma function.
def cdf_sql(x: str) -> str:
    return (f"CASE WHEN {x} = 0 THEN 0.5 ELSE 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), "
            f"lambda i: exp((2 * i + 1) * ln(abs({x})) - (lgamma(2 * i + 3) - (i + 1) * ln(2) - lgamma(i + 2))))) END")


@query("normal_cdf", "event_id:i z:d p:d", f"SELECT event_id, z, {cdf_sql('z')} AS p FROM (SELECT event_id, (value - 100) / 60 AS z FROM events)")
def _(spark, d):
    z = table(spark, d, "events").select("event_id", ((F.col("value") - 100) / 60).alias("z"))
    return z.withColumn("p", sc.normal_cdf(F.col("z")))


# Names of the order states.
STATES = {"O": "open", "F": "filled", "P": "pending"}


@query("value_map", "o_orderkey:i state:s", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' END AS state FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.value_map(F.col("o_orderstatus"), STATES).alias("state"))


@query("epoch_convert", "event_id:i ms:i s:i from_ms:t from_s:t", """SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s,
 date_trunc('second', ts) AS from_ms, date_trunc('second', ts) AS from_s FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(epoch_micros("ts") / 1000).alias("ms"), epoch_seconds("ts").alias("s"))
    whole = F.floor(F.col("ms") / 1000) * 1000
    return e.select("*", epoch_millis_to_ts(whole).alias("from_ms"), from_epoch(F.col("s")).alias("from_s"))


@query("name_parse", "symbol:s coin:s stable:s column_name:s n:i", """SELECT symbol, left(symbol, len(symbol) - 4) AS coin, right(symbol, 4) AS stable,
 'stock_' || lower(left(symbol, len(symbol) - 4)) || '_price' AS column_name, count(*) AS n FROM (SELECT upper(event_type) || 'USDC' AS symbol FROM events) GROUP BY ALL""")
def _(spark, d):
    symbols = table(spark, d, "events").groupBy(F.concat(F.upper("event_type"), F.lit("USDC")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    coin = F.expr("substring(symbol, 1, length(symbol) - 4)")
    return symbols.select("symbol", coin.alias("coin"), F.right("symbol", F.lit(4)).alias("stable"),
                          F.concat(F.lit("stock_"), F.lower(coin), F.lit("_price")).alias("column_name"), "n")


@query("exposure_curve", "series:s ts:t exposure:d exposure_adj:d leverage:d", f"""{RET}, c AS (SELECT series, ts, 1 / (1 + exp(-abs(coalesce("return", 0)))) AS c FROM rets),
e AS (SELECT *, CASE WHEN c > 0.55 THEN greatest(0.5, least(ln(100 * c - 49) / ln(41) + 0.1, 1)) ELSE 0 END AS exposure FROM c)
SELECT series, ts, exposure, coalesce(exposure - lag(exposure) OVER ({W}), 0) AS exposure_adj, CASE WHEN c > 0.9 THEN 3.0 ELSE 1.0 END AS leverage FROM e""")
def _(spark, d):
    c = hour_returns(spark, d).select("series", "ts", (1 / (1 + F.exp(-F.abs(F.coalesce("return", F.lit(0.0)))))).alias("c"))
    e = c.withColumn("exposure", sc.exposure(F.col("c"), F.col("c") > 0.55)).withColumn("leverage", F.when(F.col("c") > 0.9, 3.0).otherwise(1.0))
    return bounded(e, HOUR, lambda w: {"exposure_adj": F.coalesce(F.col("exposure") - F.lag("exposure").over(w), F.lit(0.0))}, back=1)
