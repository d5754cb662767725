"""Data-quality and repair queries (survey section 2.9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions.scalars import is_market_time
from barloom.functions.time import epoch_seconds
from barloom.operators import aggregate as ag, clean, quality as dq, windows as win
from barloom.plans.base import BARS, DENSE, GAPPY, GRID_, HOUR, RET, hour_bars, hour_dense, hour_grid, hour_returns, sql_grid, stage_table
from barloom.plans.q_windows import bf, ema_sql, ff, interpolate_sql, lagged
from barloom.plans.registry import query
from barloom.session import stage
from barloom.sources.tables import table

NOW = dt.datetime(2024, 1, 31, 6, 0, 0)

# Bars with defects at fixed hours: negative, spiked, null and flat prices, highs below the price, repeated rows.
_D = {
    "price": "CASE WHEN h % 97 = 0 THEN -price WHEN h % 89 = 0 THEN price * 20 WHEN ticks = 1 AND h % 5 = 0 THEN NULL WHEN h % 24 BETWEEN 3 AND 8 AND h % 7 < 6 THEN 33.0 ELSE price END",
    "open": "open", "high": "CASE WHEN h % 41 = 0 THEN low ELSE high END", "low": "low", "volume": "CASE WHEN h % 31 = 0 THEN NULL ELSE volume END",
}
DIRTY = f"""{BARS}, hb AS (SELECT *, epoch(ts)::BIGINT // 3600 AS h FROM bars), d1 AS (SELECT series, ts, {", ".join(f"{e} AS {c}" for c, e in _D.items())}, h FROM hb),
dirty AS (SELECT series, ts, price, open, high, low, volume, 1 AS load FROM d1 UNION ALL SELECT series, ts, price + 1, open, high, low, volume, 2 FROM d1 WHERE h % 53 = 0)"""
CELLS = ["price", "open", "high", "low", "volume"]


@stage_table
def dirty(spark, d):
    b = hour_bars(spark, d).withColumn("h", F.floor(epoch_seconds("ts") / 3600))
    one = b.select("series", "ts", *[F.expr(e).alias(c) for c, e in _D.items()], "h")
    first = one.withColumn("load", F.lit(1))
    again = one.where("h % 53 = 0").withColumn("price", F.col("price") + 1).withColumn("load", F.lit(2))
    return first.unionByName(again).drop("h")


@query("dq_stale", "series:s value:d failed:b", f"{BARS} SELECT series, date_diff('hour', max(ts), TIMESTAMP '2024-01-31 06:00:00') AS value, date_diff('hour', max(ts), TIMESTAMP '2024-01-31 06:00:00') > 12 AS failed FROM bars GROUP BY 1")
def _(spark, d):
    return dq.stale(hour_bars(spark, d), HOUR, NOW)


@query("dq_missing_columns", "column:s value:i failed:b", """SELECT unnest(['stock_NDX_price', 'ta_volume']) AS "column", count(*) AS value, true AS failed FROM lineitem""")
def _(spark, d):
    return dq.column_presence(table(spark, d, "lineitem"), ["l_tax", "stock_NDX_price", "l_discount", "ta_volume"], "missing")


@query("dq_unexpected_columns", "column:s value:i failed:b", """SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS "column", count(*) AS value, true AS failed FROM orders""")
def _(spark, d):
    return dq.column_presence(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "unexpected")


@query("dq_missing_rows", "series:s value:i failed:b", f"{BARS} SELECT series, date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS value, date_diff('hour', min(ts), max(ts)) + 1 > count(*) AS failed FROM bars GROUP BY 1")
def _(spark, d):
    return dq.missing_rows(dirty(spark, d), HOUR)


_LIM = {"price": 0.02, "open": 0.0, "volume": 0.05}


@query("dq_null_ratio", "series:s column:s value:d failed:b", f"{DIRTY} " + " UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS value, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) > {v} AS failed FROM dirty GROUP BY 1""" for c, v in _LIM.items()))
def _(spark, d):
    return dq.null_ratio(dirty(spark, d), ["series"], _LIM)


@query("dq_duplicate_keys", "series:s value:i failed:b", f"{DIRTY} SELECT series, count(*) - count(DISTINCT ts) AS value, count(*) > count(DISTINCT ts) AS failed FROM dirty GROUP BY 1")
def _(spark, d):
    return dq.duplicates(dirty(spark, d), ["series"], ["ts"])


@query("dq_duplicate_rows", "o_orderpriority:s value:i failed:b", "SELECT o_orderpriority, count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS value, count(*) > count(DISTINCT (o_custkey, o_orderstatus)) AS failed FROM orders GROUP BY 1")
def _(spark, d):
    return dq.duplicates(table(spark, d, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderstatus"])


@query("dq_duplicate_columns", "column:s value:i failed:b", """SELECT unnest(['nationkey', 'name']) AS "column", count(*) AS value, true AS failed FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    header = [x.split("_")[1] for x in [*c.columns, *n.columns]]
    return dq.duplicate_columns(header, c.join(n, F.col("c_nationkey") == F.col("n_nationkey")))


_MAX, _MIN = {"price": 400.0, "volume": 1e6}, {"price": 0.0, "low": 0.01}


def _bounds_sql(f: str, op: str, lim: dict) -> str:
    return f"{DIRTY} " + " UNION ALL ".join(f"""SELECT series, '{c}' AS "column", {f}({c}) AS value, {f}({c}) {op} {v} AS failed FROM dirty GROUP BY 1""" for c, v in lim.items())


@query("dq_above_max", "series:s column:s value:d failed:b", _bounds_sql("max", ">", _MAX))
def _(spark, d):
    return dq.above_max(dirty(spark, d), ["series"], _MAX)


@query("dq_below_min", "series:s column:s value:d failed:b", _bounds_sql("min", "<", _MIN))
def _(spark, d):
    return dq.below_min(dirty(spark, d), ["series"], _MIN)


@query("dq_unexpected_values", "column:s value:s n:i failed:b", """SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n, true AS failed FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY ALL
 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), true FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3, 4) GROUP BY ALL""")
def _(spark, d):
    return dq.unexpected_values(table(spark, d, "lineitem"), {"l_returnflag": ["A", "N"], "l_linenumber": ["1", "2", "3", "4"]})


def _sql_cols(expr: str, fail: str, cols=("price", "volume"), source: str = "dirty", prefix: str = DIRTY) -> str:
    return f"{prefix} " + " UNION ALL ".join(
        f"""SELECT series, '{c}' AS "column", {expr.format(c=c)} AS value, {fail.format(c=c)} AS failed FROM {source} GROUP BY 1""" for c in cols)


@query("dq_negative_values", "series:s column:s value:i failed:b", _sql_cols("count(*) FILTER ({c} < 0)", "count(*) FILTER ({c} < 0) > 0"))
def _(spark, d):
    return dq.negatives(dirty(spark, d), ["series"], ["price", "volume"])


@query("dq_standardized", "series:s column:s failed:b", _sql_cols("0", "coalesce(avg({c}) * 100 <= stddev_samp({c}), false)", ("price", "acceleration"), "rets", RET))
def _(spark, d):
    return dq.standardized(hour_returns(spark, d), ["series"], ["price", "acceleration"])


_NEG = "CASE WHEN coalesce(avg({c}) * 100 <= stddev_samp({c}), false) THEN 0 ELSE count(*) FILTER ({c} < 0) END"


@query("dq_negative_prices", "series:s column:s value:i failed:b", _sql_cols(_NEG, f"{_NEG} > 0", ("price", "low")))
def _(spark, d):
    return dq.negative_prices(dirty(spark, d), ["series"], ["price", "low"])


FLAT_DIRTY = f"""{DIRTY}, u AS (SELECT series, ts, arg_max(price, load) FILTER (true) AS price FROM (SELECT series, ts, price, load FROM dirty WHERE load = 1) GROUP BY 1, 2), k AS (SELECT * FROM u WHERE price IS NOT NULL),
fr AS (SELECT *, price / {lagged("price")} - 1 AS r FROM k), fa AS (SELECT *, r - {lagged("r")} AS a FROM fr), fj AS (SELECT *, a - {lagged("a")} AS j FROM fa)"""


@query("dq_flat_prices", "series:s column:s value:i failed:b", f"""{FLAT_DIRTY} SELECT series, 'price' AS "column", count(*) FILTER (r = 0 AND a = 0 AND j = 0) AS value, count(*) FILTER (r = 0 AND a = 0 AND j = 0) > 5 AS failed FROM fj GROUP BY 1""")
def _(spark, d):
    return dq.flat_prices(dirty(spark, d).where("load = 1"), GAPPY, ["price"])


_OUT = "count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c})"
_TH = """, th AS (SELECT series, 0 AS lo_price, avg(price) + 9.5 * stddev_samp(price) AS hi_price, avg(volume) - 4 * stddev_samp(volume) AS lo_volume, avg(volume) + 4 * stddev_samp(volume) AS hi_volume FROM dirty GROUP BY 1), dj AS (SELECT * FROM dirty JOIN th USING (series))"""


@query("dq_extreme_values", "series:s column:s value:i failed:b", _sql_cols(_OUT, f"{_OUT} > 0", ("price", "volume"), "dj", DIRTY + _TH))
def _(spark, d):
    x = dirty(spark, d)
    return dq.extreme_values(x, ag.outlier_thresholds(x, ["series"], ["price", "volume"], ["price"]), ["series"], ["price", "volume"])


@query("dq_excess_features", "rows:i value:i failed:b", "SELECT count(*) AS rows, 11 AS value, true AS failed FROM lineitem")
def _(spark, d):
    return dq.too_many_columns(table(spark, d, "lineitem"), 10)


@query("dq_short_length", "series:s value:i failed:b", f"{BARS} SELECT series, count(*) AS value, count(*) < 0.95 * 712 AS failed FROM bars GROUP BY 1")
def _(spark, d):
    return dq.short_length(hour_bars(spark, d), ["series"], 712)


RULES = {"max": {"price": 400.0}, "min": {"low": 0.0}, "null_ratio": {"price": 0.02, "volume": 0.5}, "non_negative": ["price"], "expected_rows": 700, "now": NOW}


@query("dq_report", "series:s check:s failed:b", f"""{DIRTY}, r AS (SELECT series, count(*) AS n, count(DISTINCT ts) AS b, date_diff('hour', min(ts), max(ts)) + 1 AS span, max(ts) AS hi, max(price) AS x, min(low) AS m,
 avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END) AS np, avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0 END) AS nv, count(*) FILTER (price < 0) AS g FROM dirty GROUP BY 1)
SELECT series, unnest(['missing_rows', 'duplicate_keys', 'above_max', 'below_min', 'null_ratio', 'negative_values', 'short_length', 'stale']) AS "check",
 unnest([span > b, n > b, x > 500, m < 0, np > 0.02 OR nv > 0.5, g > 0, n < 0.95 * 700, date_diff('hour', hi, TIMESTAMP '2024-01-31 06:00:00') > 12]) AS failed FROM r""")
def _(spark, d):
    return dq.report(dirty(spark, d), HOUR, RULES, {"max": {"price": 500.0}})


@query("repair_table", "series:s ts:t price:d open:d volume:d high:d", f"""{DIRTY}, f AS (SELECT series, ts, arg_min(price, load) AS price0 FROM dirty GROUP BY 1, 2), f1 AS (SELECT series, ts, max(price) FILTER (load = 1) AS price, max(open) AS open, max(volume) AS volume FROM dirty GROUP BY 1, 2),
g AS ({sql_grid('f1')}) SELECT g.series, g.ts, coalesce(g.price, x.price) AS price, coalesce(g.open, x.open) AS open, coalesce(g.volume, x.volume) AS volume, x.high AS high FROM g LEFT JOIN (SELECT series, ts, price, open, volume, CASE WHEN ticks > 1 THEN high END AS high FROM bars) x USING (series, ts)""")
def _(spark, d):
    backup = hour_bars(spark, d).select("series", "ts", "price", "open", "volume", F.when(F.col("ticks") > 1, F.col("high")).alias("high"))
    broken = dirty(spark, d).select("series", "ts", "price", "open", "volume", "load", F.lit(1.0).alias("junk"))
    failed = ["duplicate_keys", "unexpected_columns", "missing_columns", "missing_rows", "null_ratio"]
    return clean.repair(broken, HOUR, failed, "load", ["price", "open", "volume", "high"], backup)


@query("repair_peer_columns", "series:s ts:t volume:d other_coins_error_price:d other_coins_view_price:d", f"""{BARS}, thin AS (SELECT series, ts, CASE WHEN series = 'click' AND hour(ts) < 12 THEN NULL ELSE volume END AS volume FROM bars WHERE series <> 'purchase' OR day(ts) < 20),
c AS (SELECT series, count(*) AS n FROM thin WHERE series <> 'click' AND ts IN (SELECT ts FROM thin WHERE series = 'click') GROUP BY 1 HAVING count(*) >= 0.9 * (SELECT count(*) FROM thin WHERE series = 'click') ORDER BY n DESC, series LIMIT 1)
SELECT t.series, t.ts, coalesce(t.volume, o.volume) AS volume, e.price AS other_coins_error_price, v.price AS other_coins_view_price FROM thin t LEFT JOIN (SELECT thin.ts, thin.volume FROM thin JOIN c USING (series)) o ON o.ts = t.ts
LEFT JOIN bars e ON e.ts = t.ts AND e.series = 'error' LEFT JOIN bars v ON v.ts = t.ts AND v.series = 'view' WHERE t.series = 'click'""")
def _(spark, d):
    b = hour_bars(spark, d)
    thin = b.where("series <> 'purchase' or day(ts) < 20").select(
        "series", "ts", F.when(~((F.col("series") == "click") & (F.hour("ts") < 12)), F.col("volume")).alias("volume"),
        F.lit(0.0).alias("other_coins_old_price"), F.lit(None).cast("double").alias("spare"))
    filled = clean.donor_columns(stage(thin), HOUR, ["volume"], "click", 0.9)
    return clean.peer_columns(filled, b, ["error", "view"])


FILL_SQL = f"""{GRID_}, fs AS (SELECT series, ts, price, CASE WHEN hour(ts) % 6 = 0 OR ts < TIMESTAMP '2024-01-01 05:00:00' THEN NULL ELSE volume END AS volume, CASE WHEN high > 100 THEN high END AS mood,
 CASE WHEN ticks > 3 THEN 'busy' WHEN ticks > 1 THEN 'calm' END AS class FROM grid),
st AS (SELECT series, quantile_cont(volume, 0.5) AS med, avg(mood) AS mid FROM fs GROUP BY 1), mo AS (SELECT series, class AS mode FROM (SELECT series, class, count(*) AS n FROM fs WHERE class IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, class) = 1),
ip AS ({interpolate_sql('fs', 'volume', 'vi')})
SELECT series, ts, coalesce({ff('price')}, {bf('price')}) AS price, coalesce(vi, med) AS volume, CASE WHEN {ff('mood')} IS NULL THEN coalesce(mood, mid) ELSE coalesce({bf('mood')}, {ff('mood')}) END AS mood, coalesce(class, mode) AS class FROM ip JOIN st USING (series) JOIN mo USING (series)"""


@query("fill_nulls", "series:s ts:t price:d volume:d mood:d class:s", FILL_SQL)
def _(spark, d):
    lost = (F.hour("ts") % 6 == 0) | F.expr("ts < timestamp_ntz'2024-01-01 05:00:00'")
    f = hour_grid(spark, d).select(
        "series", "ts", "price", F.when(~lost, F.col("volume")).alias("volume"), F.when(F.col("high") > 100, F.col("high")).alias("mood"),
        F.when(F.col("ticks") > 3, "busy").when(F.col("ticks") > 1, "calm").alias("class"))
    mid = f.groupBy("series").agg(F.avg("mood").alias("lo"), F.avg("mood").alias("hi"))
    return clean.fill_nulls(stage(f.join(mid, "series")), HOUR, ["price"], {"mood": ("lo", "hi")}, ["volume"], ["class"])


def band_sql(prefix: str, source: str, c: str, out: str, keep: str) -> str:
    """Band outlier correction of one column: table ``out`` with the corrected column."""
    t = f"b_{c}"
    k = "".join(f", {x}" for x in keep.split())
    chain = (f"{prefix}, {t}0 AS (SELECT series, ts{k}, CASE WHEN {c} >= lo_{c} AND {c} <= hi_{c} THEN {c} END AS x0 FROM {source}), "
             f"{t}1 AS ({interpolate_sql(f'{t}0', 'x0', 'x1')}), {t}2 AS (SELECT *, {bf('x1')} AS x2 FROM {t}1)")
    e = ema_sql({f"e_{c}": ("x2", 2 / 11)}, f"{t}2", chain, keep=f"{keep} x1", out=f"{t}em")
    return (f"{e}, {t}3 AS (SELECT *, CASE WHEN NOT coalesce(abs(x1 - e_{c}) > 7 * stddev_samp(x1 - e_{c}) OVER (PARTITION BY series), false) THEN x1 END AS x3 FROM {t}em), "
            f"{out} AS (SELECT * EXCLUDE (x1, x3, {f'e_{c}'}) FROM ({interpolate_sql(f'{t}3', 'x3', f'new_{c}')}))")


_SPIKE = f"""{GRID_}, sp AS (SELECT series, ts, CASE WHEN epoch(ts)::BIGINT // 3600 % 89 = 0 THEN price * 20 WHEN price < 120 THEN price END AS price FROM grid),
spt AS (SELECT sp.*, 0 AS lo_price, hi AS hi_price FROM sp JOIN (SELECT series, avg(price) + 9.5 * stddev_samp(price) AS hi FROM sp GROUP BY 1) USING (series))"""


@query("ema_band_outliers", "series:s ts:t price:d", band_sql(_SPIKE, "spt", "price", "done", "") + " SELECT series, ts, new_price AS price FROM done")
def _(spark, d):
    spike = F.floor(epoch_seconds("ts") / 3600) % 89 == 0
    x = stage(hour_grid(spark, d).select("series", "ts", F.when(spike, F.col("price") * 20).when(F.col("price") < 120, F.col("price")).alias("price")))
    return clean.band_outliers(x, HOUR, ["price"], ag.outlier_thresholds(x, ["series"], ["price"], ["price"]))


# The whole cleaning as one chain of tables.
_P = ["price", "open", "high", "low"]


def _clean_sql() -> str:
    sql = f"""{DIRTY}, nn AS (SELECT series, ts, load, {", ".join(f"CASE WHEN {c} >= 0 THEN {c} END AS {c}" for c in CELLS)} FROM dirty),
un AS (SELECT series, ts, {", ".join(CELLS)} FROM nn QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY load DESC) = 1)"""
    for c in _P:
        sql += f""", fr_{c} AS (SELECT series, ts, {c} / nullif({lagged(c)}, 0) - 1 AS r FROM un), fa_{c} AS (SELECT *, r - {lagged("r")} AS a FROM fr_{c}), fj_{c} AS (SELECT *, coalesce(r = 0 AND a = 0 AND a - {lagged("a")} = 0, false) AS m FROM fa_{c}),
fm_{c} AS (SELECT series, ts, m AND count(*) FILTER (m) OVER (PARTITION BY series) > 3 AS m FROM fj_{c})"""
    sql += f""", st AS (SELECT un.series, un.ts, {", ".join(f"CASE WHEN NOT fm_{c}.m THEN un.{c} END AS {c}" for c in _P)}, un.volume FROM un {" ".join(f"JOIN fm_{c} ON fm_{c}.series = un.series AND fm_{c}.ts = un.ts" for c in _P)}),
fu AS ({sql_grid('st')}), th AS (SELECT series, {", ".join(f"0 AS lo_{c}, avg({c}) + {10 if c == 'high' else 9.5} * stddev_samp({c}) AS hi_{c}" for c in _P)}, avg(volume) - 4 * stddev_samp(volume) AS lo_volume, avg(volume) + 4 * stddev_samp(volume) AS hi_volume FROM fu GROUP BY 1),
fj AS (SELECT * FROM fu JOIN th USING (series))"""
    for c in _P:
        sql = band_sql(sql, "fj", c, f"done_{c}", "")
    clip = lambda c, e: f"CASE WHEN {e} < lo_{c} THEN lo_{c} WHEN {e} > hi_{c} THEN hi_{c} ELSE {e} END AS {c}"
    sql += f""", bd AS (SELECT fj.* EXCLUDE ({", ".join(_P)}), {", ".join(f"done_{c}.new_{c} AS {c}" for c in _P)} FROM fj {" ".join(f"JOIN done_{c} ON done_{c}.series = fj.series AND done_{c}.ts = fj.ts" for c in _P)}),
op AS (SELECT * REPLACE (CASE WHEN abs(open - {lagged("price")}) > 0.04 * price THEN {lagged("price")} ELSE open END AS open) FROM bd),
cl AS (SELECT series, ts, {", ".join(clip(c, c) for c in CELLS)} FROM op), me AS (SELECT series, quantile_cont(volume, 0.5) AS med FROM cl GROUP BY 1),
ip AS ({interpolate_sql('cl', 'volume', 'vi')}), fi AS (SELECT series, ts, {", ".join(f"coalesce({ff(c)}, {bf(c)}) AS {c}" for c in _P)}, coalesce(vi, med) AS volume FROM ip JOIN me USING (series))
SELECT series, ts, price, open, greatest(high, price, open) AS high, least(low, price, open) AS low, volume FROM fi WHERE (series, ts) IN (SELECT (series, ts) FROM un) QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 600"""
    return sql


@query("clean_panel", "series:s ts:t price:d open:d high:d low:d volume:d", _clean_sql())
def _(spark, d):
    return clean.clean_panel(dirty(spark, d), HOUR, "load", _P, CELLS, 600)


@query("null_last_row_columns", "series:s ts:t column:s", f"""{BARS}, x AS (SELECT series, ts, CASE WHEN ticks > 2 THEN price END AS price, CASE WHEN ticks > 3 THEN volume END AS stock_NDX_price, open FROM bars),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) = 1) SELECT series, ts, 'price' AS "column" FROM l WHERE price IS NULL
 UNION ALL SELECT series, ts, 'stock_NDX_price' FROM l WHERE stock_NDX_price IS NULL AND isodow(ts) <= 5 AND CAST(ts AS TIME) BETWEEN TIME '13:30:00' AND TIME '19:30:00'""")
def _(spark, d):
    x = hour_bars(spark, d).select("series", "ts", F.when(F.col("ticks") > 2, F.col("price")).alias("price"), F.when(F.col("ticks") > 3, F.col("volume")).alias("stock_NDX_price"), "open")
    return dq.null_in_last_bar(x, HOUR, ["price", "stock_NDX_price", "open"], ["stock_NDX_price"], is_market_time("ts"))


@query("split_integrity", "series:s overlap:i gap_bars:d test_differs:i failed:b", f"""{DENSE}, v AS (SELECT series, ts FROM dense WHERE ts < TIMESTAMP '2024-01-20' OR (series = 'click' AND ts < TIMESTAMP '2024-01-22')), t AS (SELECT series, ts FROM dense WHERE ts >= TIMESTAMP '2024-01-20'),
o AS (SELECT series, ts FROM t WHERE NOT (series = 'view' AND day(ts) = 25))
SELECT series, (SELECT count(*) FROM v SEMI JOIN t USING (series, ts) WHERE v.series = s.series) AS overlap, date_diff('hour', (SELECT max(ts) FROM v WHERE v.series = s.series), (SELECT min(ts) FROM t WHERE t.series = s.series)) AS gap_bars,
 (SELECT count(*) FROM t ANTI JOIN o USING (series, ts) WHERE t.series = s.series) AS test_differs, series IN ('click', 'view') AS failed FROM (SELECT DISTINCT series FROM dense) s""")
def _(spark, d):
    b = hour_dense(spark, d)
    val = b.where("ts < timestamp_ntz'2024-01-20' or (series = 'click' and ts < timestamp_ntz'2024-01-22')")
    test = b.where("ts >= timestamp_ntz'2024-01-20'")
    return dq.split_integrity(val, test, test.where("not (series = 'view' and day(ts) = 25)"), HOUR)


@query("feature_list_checks", "target:s too_many:b repeated:b absent:i", """WITH s AS (SELECT l_returnflag AS target, 'f' || (l_partkey % 12) AS feature FROM lineitem UNION ALL SELECT 'X', 'f' || p_size FROM part GROUP BY p_size)
SELECT target, count(*) > 40 AS too_many, count(*) > count(DISTINCT feature) AS repeated, count(*) FILTER (feature NOT IN ('f0', 'f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8', 'f9')) AS absent FROM s GROUP BY 1""")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), F.concat(F.lit("f"), (F.col("l_partkey") % 12).cast("string")).alias("feature"))
    x = table(spark, d, "part").select("p_size").distinct().select(F.lit("X").alias("target"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("feature"))
    return dq.feature_list_checks(s.unionByName(x), [f"f{i}" for i in range(10)], 40)


@query("frames_equal_mape", "column:s error:d equal:b", f"""{BARS}, b AS (SELECT series, ts, price * 1.01 AS price, volume + 0.5 * (hour(ts) % 2) AS volume, high FROM bars WHERE ticks > 1)
SELECT unnest(['price', 'volume', 'high']) AS "column", unnest([e1, e2, e3]) AS error, unnest([e1 <= 0.005, e2 <= 0.005, e3 <= 0.005]) AS equal FROM (SELECT sum(abs(a.price - b.price)) / sum(abs(a.price)) AS e1, sum(abs(a.volume - b.volume)) / sum(abs(a.volume)) AS e2, sum(abs(a.high - b.high)) / sum(abs(a.high)) AS e3 FROM bars a JOIN b USING (series, ts))""")
def _(spark, d):
    a = hour_bars(spark, d)
    b = a.where("ticks > 1").withColumns({"price": F.col("price") * 1.01, "volume": F.col("volume") + 0.5 * (F.hour("ts") % 2)})
    return dq.frames_equal(a, b, ["series", "ts"], ["price", "volume", "high"], 0.005)


@query("forecast_consistency", "series:s n_rows:i different:i consistent:b", f"""{RET}
SELECT series, count(*) AS n_rows, count(*) FILTER (h = 5 AND series = 'view' ) AS different, count(*) FILTER (h = 5 AND series = 'view') = 0 AS consistent FROM (SELECT series, hour(ts) AS h FROM rets) GROUP BY 1""")
def _(spark, d):
    one = win.naive_last_value(hour_returns(spark, d), HOUR, "return", 3)
    two = win.naive_last_value(hour_returns(spark, d), HOUR, "return", 3)
    drift = (F.col("series") == "view") & (F.hour("ts") == 5)
    return dq.same_forecasts(one, two.withColumn("forecast", F.when(drift, F.col("forecast") + 1).otherwise(F.col("forecast"))), ["series"], "ts", "forecast")
