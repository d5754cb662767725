"""Aggregation queries (survey section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import candle_shape, candle_type
from barloom.functions.time import bucket_start, month_start, tie_order
from barloom.operators import aggregate as ag, sets
from barloom.operators.bars import resample, with_derivatives
from barloom.operators.blocks import Grid, bounded
from barloom.operators.joins import pivot_peers
from barloom.plans.base import (
    BARS, DENSE, GAPPY, HALF, HOUR, RET, USER, W, half_bars, hour_bars, hour_dense, hour_returns, user_bars,
)
from barloom.plans.q_joins import PAIR_SQL, PEERS, pairs
from barloom.plans.q_scalars import CANDLE_SQL, SHAPE_SQL
from barloom.plans.q_windows import lagged
from barloom.plans.registry import query
from barloom.session import stage
from barloom.sources.tables import table

_NAMES = {"open": "coin_open", "high": "coin_high", "low": "coin_low", "price": "coin_price", "volume": "ta_volume"}
RESAMPLE_SQL = f"""{HALF}, res AS (SELECT series, date_trunc('hour', ts) AS ts, arg_min(open, ts) AS coin_open, max(high) AS coin_high, min(low) AS coin_low,
 arg_max(price, ts) AS coin_price, sum(volume) AS ta_volume, avg(ticks) AS on_chain_rate, arg_min(ticks, ts) AS long_short_top, arg_min(price / open, ts) AS sentiment_lc_score FROM half GROUP BY 1, 2)"""


def resampled(spark, d):
    half = half_bars(spark, d).withColumns({
        "on_chain_rate": F.col("ticks"), "long_short_top": F.col("ticks"), "sentiment_lc_score": F.try_divide("price", "open"),
    }).withColumnsRenamed(_NAMES)
    return resample(half, 3600)


@query("resample_ohlcv", "series:s ts:t coin_open:d coin_high:d coin_low:d coin_price:d ta_volume:d on_chain_rate:d long_short_top:d sentiment_lc_score:d", f"{RESAMPLE_SQL} SELECT * FROM res")
def _(spark, d):
    return resampled(spark, d)


@query("resample_derivatives", "series:s ts:t return:d acceleration:d jerk:d ratio:d", f"""{RESAMPLE_SQL}, a AS (SELECT series, ts, coin_price / {lagged("coin_price")} - 1 AS "return", long_short_top / on_chain_rate AS ratio FROM res),
b AS (SELECT *, "return" - {lagged('"return"')} AS acceleration FROM a) SELECT *, acceleration - {lagged("acceleration")} AS jerk FROM b""")
def _(spark, d):
    out = with_derivatives(stage(resampled(spark, d)), GAPPY, "coin_price")
    return out.withColumn("ratio", F.try_divide("long_short_top", "on_chain_rate"))


@query("bucket_last", "user_id:i bucket:t balance:d", "SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, arg_max(value, (ts, event_id)) AS balance FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", bucket_start("ts", 1800).alias("bucket")).agg(F.max_by("value", tie_order("ts", "event_id")).alias("balance"))


@query("income_by_bucket", "asset:s type:i bucket:t total:d first:d", """SELECT event_type AS asset, user_id % 3 AS type, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket,
 sum(value) AS total, arg_min(value, (ts, event_id)) AS first FROM events GROUP BY 1, 2, 3""")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("asset"), (F.col("user_id") % 3).alias("type"), bucket_start("ts", 1800).alias("bucket")).agg(
        F.sum("value").alias("total"), F.min_by("value", tie_order("ts", "event_id")).alias("first"))


@query("fills_vwap", "symbol:s type:s side:s bucket:t avg_price:d4 quantity:d stop_price:d4", """SELECT l_suppkey AS symbol, l_returnflag AS type, l_linestatus AS side, date_trunc('month', l_shipdate) AS bucket,
 sum(l_extendedprice) / sum(l_quantity) AS avg_price, sum(l_quantity) AS quantity, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS stop_price FROM lineitem WHERE l_tax < 0.05 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    unit = F.try_divide("l_extendedprice", "l_quantity")
    fills = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("side"), "l_shipdate",
        F.when(F.col("l_tax") < 0.05, "FILLED").otherwise("CANCELED").alias("status"), unit.alias("price"),
        F.col("l_quantity").alias("quantity"), (unit * (1 - F.col("l_discount"))).alias("stop_price"))
    return ag.fills_vwap(fills, month_start("l_shipdate"))


@query("portfolio_valuation", "asset:s total_balance:d2 usd_price:d usd_amount:d2 kind:s", """WITH b AS (SELECT c_nationkey AS asset, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier),
t AS (SELECT CASE WHEN asset = 24 THEN 23 ELSE asset END AS asset, sum(balance) AS total_balance FROM b WHERE balance > 0 GROUP BY 1),
p AS (SELECT p_size - 1 AS asset, arg_max(p_retailprice, p_partkey) AS usd_price FROM part GROUP BY 1)
SELECT asset, total_balance, usd_price, total_balance * usd_price AS usd_amount, CASE WHEN total_balance >= 300000 THEN 'long' ELSE 'short' END AS kind FROM t JOIN p USING (asset) WHERE total_balance * usd_price > 10""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("asset"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("asset"), F.col("s_acctbal").alias("balance"))
    prices = table(spark, d, "part").groupBy((F.col("p_size") - 1).cast("string").alias("asset")).agg(F.max_by("p_retailprice", "p_partkey").alias("usd_price"))
    valued = ag.portfolio(c.unionByName(s), prices, {"24": "23"})
    return valued.withColumn("kind", F.when(F.col("total_balance") >= 300000, "long").otherwise("short"))


_COLS = ["open", "high", "low", "price", "volume", "ticks"]


@query("outlier_thresholds", "series:s column:s low:d high:d", f"{BARS} " + " UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", {"0" if c in _COLS[:4] else f"avg({c}) - 4 * stddev_samp({c})"} AS low, avg({c}) + {10 if c == "high" else 9.5 if c in _COLS[:4] else 4} * stddev_samp({c}) AS high FROM bars GROUP BY series""" for c in _COLS))
def _(spark, d):
    return ag.long_thresholds(ag.outlier_thresholds(hour_bars(spark, d), ["series"], _COLS, _COLS[:4]), ["series"], _COLS)


@query("return_band_thresholds", "series:s column:s low:d high:d", f"{RET} " + " UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", avg("{c}") - 1.96 * stddev_samp("{c}") AS low, avg("{c}") + 1.96 * stddev_samp("{c}") AS high FROM rets GROUP BY series""" for c in ("return", "acceleration", "jerk")))
def _(spark, d):
    names = ["return", "acceleration", "jerk"]
    return ag.long_thresholds(ag.band_thresholds(hour_returns(spark, d), ["series"], names), ["series"], names)


@query("imputer_statistics", "column:s number:d text:s", """SELECT 'l_quantity' AS "column", quantile_cont(l_quantity, 0.5) AS number, NULL AS text FROM lineitem
 UNION ALL SELECT 'l_extendedprice', quantile_cont(l_extendedprice, 0.5), NULL FROM lineitem
 UNION ALL (SELECT 'l_returnflag', NULL, l_returnflag FROM lineitem GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)""")
def _(spark, d):
    return ag.imputer_statistics(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


# Shares of the range at the seven levels, from the top.
FIB_LEVELS = [1.0, 0.786, 0.618, 0.5, 0.382, 0.236, 0.0]


@query("fib_levels", "series:s level:i price:d", f"""{BARS}, t AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 500),
m AS (SELECT series, min(low) AS lo, max(high) AS hi FROM t GROUP BY 1) {" UNION ALL ".join(f"SELECT series, {i} AS level, lo + {s} * (hi - lo) AS price FROM m" for i, s in enumerate(FIB_LEVELS))}""")
def _(spark, d):
    m = sets.tail_rows(hour_bars(spark, d), GAPPY, 500).groupBy("series").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    levels = F.array(*[F.col("lo") + s * (F.col("hi") - F.col("lo")) for s in FIB_LEVELS])
    return m.select("series", F.posexplode(levels).alias("level", "price"))


_FEATS = ["open", "high", "low", "volume", "ticks", "acceleration", "jerk"]


@query("target_feature_corr", "series:s feature:s score:d", f"""{RET}, s AS ({" UNION ALL ".join(f"SELECT series, '{c}' AS feature, abs(corr(\"return\", {c})) AS score FROM rets GROUP BY series" for c in _FEATS)})
SELECT * FROM s JOIN (SELECT series, quantile_cont(score, 0.3) AS q FROM s GROUP BY 1) USING (series) WHERE score > q""")
def _(spark, d):
    return ag.above_quantile(ag.correlations(hour_returns(spark, d), ["series"], "return", _FEATS), ["series"], 0.3)


_PAIRS = [(a, b) for i, a in enumerate(_FEATS) for b in _FEATS[i + 1:]]


@query("corr_matrix", "series:s a:s b:s score:d", f"{RET} " + " UNION ALL ".join(
    f"SELECT series, '{a}' AS a, '{b}' AS b, coalesce(abs(corr({a}, {b})) * 100, 100) AS score FROM rets GROUP BY series" for a, b in _PAIRS))
def _(spark, d):
    return ag.correlation_matrix(hour_returns(spark, d), ["series"], _FEATS)


_KINDS = ["return", "acceleration", "jerk"]
WIDE_SQL = f"{RET}, wide AS (SELECT ts, {', '.join(f'max({chr(34)}{k}{chr(34)}) FILTER (series = {chr(39)}{p}{chr(39)}) AS {p}_{k}' for p in PEERS for k in _KINDS)} FROM rets GROUP BY ts)"


def wide_returns(spark, d):
    """One row per hour with the return, acceleration and jerk of every series."""
    return pivot_peers(hour_returns(spark, d), PEERS, _KINDS)


@query("peer_corr_score", "series:s score:d rank:i", f"""{WIDE_SQL}, sh AS (SELECT *, {', '.join(f'lag({p}_{k}) OVER (ORDER BY ts) AS {p}_{k}_shifted' for p in PEERS for k in _KINDS)} FROM wide),
sc AS ({' UNION ALL '.join(f"SELECT '{p}' AS series, ({' + '.join(f'abs(corr({p}_{k}_shifted, {o}_{m}))' for k in _KINDS for o in PEERS if o != p for m in _KINDS)}) / {9 * (len(PEERS) - 1)} AS score FROM sh" for p in PEERS)})
SELECT *, row_number() OVER (ORDER BY score DESC, series) AS rank FROM sc""")
def _(spark, d):
    one = wide_returns(spark, d).withColumn("_all", F.lit(1))
    shifted = bounded(one, Grid(keys=("_all",)), lambda w: {f"{p}_{k}_shifted": F.lag(f"{p}_{k}").over(w) for p in PEERS for k in _KINDS}, back=1)
    return ag.peer_scores(shifted, PEERS, _KINDS)


@query("train_peers", "series:s peer:s score:d", f"""{WIDE_SQL}, m AS ({' UNION ALL '.join(f"SELECT '{a}' AS series, '{b}' AS peer, {'max(1.0)' if a == b else f'abs(corr({a}_return, {b}_return))'} AS score FROM wide" for a in PEERS for b in PEERS)})
SELECT * FROM m JOIN (SELECT series, least(0.6, quantile_cont(score, 0.25)) AS t FROM m GROUP BY 1) USING (series) WHERE score > t""")
def _(spark, d):
    wide = wide_returns(spark, d).withColumnsRenamed({f"{p}_return": p for p in PEERS})
    return ag.train_peers(ag.full_matrix(ag.correlation_matrix(wide, [], PEERS), PEERS))


MSD_SQL = f"""{PAIR_SQL}, msd AS (SELECT p.series, pos, avg(p.price) / any_value(m.p) AS price, avg(p.volume) / any_value(m.v) AS volume FROM pairs p
JOIN (SELECT series, avg(abs(price)) AS p, avg(abs(volume)) AS v FROM dense GROUP BY 1) m ON m.series = p.series GROUP BY p.series, pos)"""


def mean_snapshot_diff(spark, d):
    means = hour_dense(spark, d).groupBy("series").agg(F.avg(F.abs("price")).alias("_p"), F.avg(F.abs("volume")).alias("_v"))
    diffs = pairs(spark, d).groupBy("series", "pos").agg(F.avg("price").alias("price"), F.avg("volume").alias("volume"))
    return diffs.join(means, "series").withColumns({"price": F.try_divide("price", "_p"), "volume": F.try_divide("volume", "_v")}).drop("_p", "_v")


@query("mean_snapshot_diff", "series:s pos:i price:d volume:d", f"{MSD_SQL} SELECT * FROM msd")
def _(spark, d):
    return mean_snapshot_diff(spark, d)


@query("shift_detection", "series:s column:s shift:i", f"""{MSD_SQL}, l AS (SELECT series, pos, 'price' AS "column", price AS x FROM msd UNION ALL SELECT series, pos, 'volume', volume FROM msd)
SELECT * FROM (SELECT series, "column", max(pos) + 1 - min(pos) FILTER (x > 0.1) AS shift FROM l GROUP BY 1, 2) WHERE shift > 0""")
def _(spark, d):
    long = mean_snapshot_diff(spark, d).unpivot(["series", "pos"], ["price", "volume"], "column", "x")
    return long.groupBy("series", "column").agg(
        (F.max("pos") + 1 - F.min(F.when(F.col("x") > 0.1, F.col("pos")))).alias("shift")).where("shift > 0")


@query("forecast_scale", "series:s scale:d", f"""{RET}, f AS (SELECT series, "return" AS y, {lagged('"return"', 2)} AS p FROM rets) SELECT series, avg(abs(y)) / avg(abs(p)) AS scale FROM f GROUP BY 1""")
def _(spark, d):
    f = bounded(hour_returns(spark, d), HOUR, lambda w: {"p": F.lag("return", 2).over(w)}, back=2)
    return f.groupBy("series").agg(F.try_divide(F.avg(F.abs("return")), F.avg(F.abs("p"))).alias("scale"))


_CLASSES = ["strong_bull_candle", "strong_bear_candle", "bull_candle", "bear_candle", "hammer_candle", "hanging_man_candle", "doji_candle"]


@query("class_counts", "series:s " + " ".join(f"{c}:i" for c in _CLASSES), f"""{RET}, c AS (SELECT series, {CANDLE_SQL} AS k FROM (SELECT *, candle_body + candle_top_wick + candle_bot_wick AS tot FROM (SELECT *, {SHAPE_SQL} FROM rets)))
SELECT series, {", ".join(f"count(*) FILTER (k = '{c}') AS {c}" for c in _CLASSES)} FROM c GROUP BY series""")
def _(spark, d):
    shaped = hour_returns(spark, d).withColumns(candle_shape())
    typed = shaped.withColumn("k", candle_type(F.col("candle_body"), F.col("candle_top_wick"), F.col("candle_bot_wick"), F.col("return")))
    return ag.class_counts(typed, ["series"], "k", _CLASSES)


@query("crosstab_binary", "series:s night:b down:i up:i", f"""{RET} SELECT series, hour(ts) < 8 AS night, count(*) FILTER (NOT coalesce("return" >= 0, false)) AS down, count(*) FILTER ("return" >= 0) AS up FROM rets GROUP BY 1, 2""")
def _(spark, d):
    r = hour_returns(spark, d).withColumn("night", F.hour("ts") < 8)
    return ag.crosstab(r, ["series"], "night", F.coalesce(F.col("return") >= 0, F.lit(False)))


_DC = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey"]


@query("distinct_per_column", "column:s n:i", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM lineitem""" for c in _DC))
def _(spark, d):
    return ag.distinct_counts(table(spark, d, "lineitem"), _DC)


_QS = [0.7 + 0.29 * i / 28 for i in range(29)]


@query("series_quantiles", "series:s q:d value:d", f"""{BARS}, x AS (SELECT series, high / open - 1 AS r FROM bars) SELECT series, unnest([{", ".join(map(repr, _QS))}]) AS q, unnest(quantile_cont(r, [{", ".join(map(repr, _QS))}])) AS value FROM x GROUP BY series""")
def _(spark, d):
    x = hour_bars(spark, d).select("series", (F.try_divide("high", "open") - 1).alias("r"))
    qs = F.array(*[F.lit(q) for q in _QS])
    return ag.exact_quantiles(stage(x), ["series"], "r", _QS).select(
        "series", F.explode(F.arrays_zip(qs.alias("q"), F.col("quantiles").alias("value"))).alias("z")).select("series", "z.q", "z.value")


@query("tail_fraction_per_group", "series:s ts:t price:d", f"{USER} SELECT series, ts, price FROM ubars QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= floor(count(*) OVER (PARTITION BY series) * 0.3)")
def _(spark, d):
    return sets.tail_share(user_bars(spark, d), Grid(step=21600, dense=False), 0.3)
