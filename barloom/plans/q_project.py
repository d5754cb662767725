"""Projection and filter queries (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import finite
from barloom.operators import project as pj
from barloom.operators.aggregate import band_thresholds
from barloom.plans.base import BARS, DENSE, HOUR, RET, hour_bars, hour_dense, hour_returns, stage_table
from barloom.plans.q_windows import lagged
from barloom.plans.registry import query
from barloom.sources.tables import table

COIN = {"price": "coin_price", "open": "coin_open", "high": "coin_high", "low": "coin_low", "volume": "ta_volume"}


def coin_frame(spark, d):
    return hour_bars(spark, d).withColumnsRenamed(COIN)


@query("select_by_prefix", "series:s ts:t coin_price:d coin_open:d coin_high:d coin_low:d", f"{BARS} SELECT series, ts, price AS coin_price, open AS coin_open, high AS coin_high, low AS coin_low FROM bars")
def _(spark, d):
    df = coin_frame(spark, d)
    cols = [c for c in pj.by_category(df.columns)["coin"] if c in pj.price_columns(df.columns)]
    return df.select("series", "ts", *cols)


@query("align_schema", "series:s ts:t price:d peak:d extra:d", f"""{BARS} SELECT series, ts, price, CASE WHEN high > 80 THEN high END AS peak, NULL AS extra FROM bars""")
def _(spark, d):
    supply = hour_bars(spark, d).where("high > 80").select("series", "ts", F.col("high").alias("peak"))
    return pj.align_schema(hour_bars(spark, d), ["price", "peak", "extra"], ["series", "ts"], supply)


@query("order_columns", "position:i name:s filled:i", f"""{BARS} SELECT * FROM (SELECT 0 AS position, 'series' AS name, count(series) AS filled FROM bars
 UNION ALL SELECT 1, 'ts', count(ts) FROM bars UNION ALL SELECT 2, 'price', count(price) FROM bars UNION ALL SELECT 3, 'open', count(open) FROM bars
 UNION ALL SELECT 4, 'high', count(high) FROM bars UNION ALL SELECT 5, 'low', count(low) FROM bars UNION ALL SELECT 6, 'ticks', count(ticks) FROM bars
 UNION ALL SELECT 7, 'volume', count(volume) FROM bars)""")
def _(spark, d):
    df = pj.order_columns(hour_bars(spark, d), ["series", "ts"], ["price", "open", "high", "low"])
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    names = {c: i for i, c in enumerate(df.columns)}
    place = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return counts.unpivot([], list(names), "name", "filled").withColumn("position", place[F.col("name")])


SELECTED = {"return": ["price", "volume", "absent"], "jerk": ["volume", "low"]}


@query("project_selected_features", "series:s ts:t price:d volume:d absent:d low:d", f"{BARS} SELECT series, ts, price, volume, 0 AS absent, low FROM bars")
def _(spark, d):
    return pj.selected_features(hour_bars(spark, d), ["series", "ts"], SELECTED, encoded=True)


@query("mirror_targets", "series:s ts:t target_price:d target_return:d target_acceleration:d target_jerk:d", f"""{RET} SELECT series, ts, price AS target_price,
 "return" AS target_return, acceleration AS target_acceleration, jerk AS target_jerk FROM rets""")
def _(spark, d):
    rets = hour_returns(spark, d)
    return pj.mirror_targets(rets.withColumnsRenamed({n: f"coin_{n}" for n in ("price", "return", "acceleration", "jerk")}))


@query("null_negative_values", "c_custkey:i c_acctbal:d", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    return pj.null_negative(table(spark, d, "customer"), ["c_acctbal"])


@query("null_negative_prices", "c_custkey:i c_mktsegment:s c_acctbal:d centered:d", """WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS a FROM customer GROUP BY 1),
x AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_acctbal - a - 1 AS centered FROM customer JOIN m USING (c_mktsegment)),
s AS (SELECT c_mktsegment, avg(c_acctbal) * 100 <= stddev_samp(c_acctbal) AS s1, avg(centered) * 100 <= stddev_samp(centered) AS s2 FROM x GROUP BY 1)
SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 0 OR s1 THEN c_acctbal END AS c_acctbal, CASE WHEN centered >= 0 OR s2 THEN centered END AS centered FROM x JOIN s USING (c_mktsegment)""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    m = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    x = c.join(m, "c_mktsegment").withColumn("centered", F.col("c_acctbal") - F.col("a") - 1).drop("a")
    return pj.null_negative_prices(x, ["c_mktsegment"], ["c_acctbal", "centered"])


# Bars with long flat stretches: between 02:00 and 07:00 the price keeps its 02:00 value.
FLAT_SQL = f"""{DENSE}, flat AS (SELECT series, ts, CASE WHEN hour(ts) BETWEEN 2 AND 7 THEN first_value(price) OVER (PARTITION BY series, date_trunc('day', ts), hour(ts) BETWEEN 2 AND 7 ORDER BY ts) ELSE price END AS price, volume FROM dense),
fr AS (SELECT *, price / {lagged("price")} - 1 AS r, price - {lagged("price")} AS d1 FROM flat), fa AS (SELECT *, r - {lagged("r")} AS a, d1 - {lagged("d1")} AS d2 FROM fr),
fj AS (SELECT *, a - {lagged("a")} AS j, d2 - {lagged("d2")} AS d3 FROM fa), fm AS (SELECT *, coalesce(r = 0 AND a = 0 AND j = 0, false) AS m, coalesce(d1 = 0 AND d2 = 0 AND d3 = 0, false) AS m2 FROM fj)"""


@stage_table
def flat_bars(spark, d):
    dense = hour_dense(spark, d)
    night = F.hour("ts").between(2, 7)
    held = dense.where(night).groupBy("series", F.to_date("ts").alias("_d")).agg(F.min_by("price", "ts").alias("_held"))
    return dense.withColumn("_d", F.to_date("ts")).join(held, ["series", "_d"], "left").select(
        "series", "ts", F.when(night, F.col("_held")).otherwise(F.col("price")).alias("price"), "volume")


@query("null_flat_runs", "series:s ts:t price:d volume:d", f"{FLAT_SQL} SELECT series, ts, CASE WHEN NOT m OR count(*) FILTER (m) OVER (PARTITION BY series) <= 3 THEN price END AS price, volume FROM fm")
def _(spark, d):
    return pj.null_flat_runs(flat_bars(spark, d), HOUR, ["price"])


@query("drop_flat_runs", "series:s ts:t price:d volume:d", f"{FLAT_SQL} SELECT series, ts, price, volume FROM fm WHERE NOT m2")
def _(spark, d):
    return pj.drop_flat_runs(flat_bars(spark, d), HOUR, "price")


@query("inf_to_null", "event_id:i x:d", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value / (event_id % 5) END AS x FROM events")
def _(spark, d):
    rest = (F.col("event_id") % 5).cast("double")
    raw = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("value"), rest))
    return table(spark, d, "events").select("event_id", finite(raw).alias("x"))


_TH = "th AS (SELECT series, avg(price) - 1.96 * stddev_samp(price) AS lo, avg(price) + 1.96 * stddev_samp(price) AS hi FROM bars GROUP BY series)"


@query("clip_to_thresholds", "series:s ts:t price:d", f"{BARS}, {_TH} SELECT series, ts, CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END AS price FROM bars JOIN th USING (series)")
def _(spark, d):
    b = hour_bars(spark, d)
    return pj.clip_to(b, band_thresholds(b, ["series"], ["price"]), ["series"], ["price"])


@query("soft_truncate", "series:s ts:t price:d", f"{BARS}, {_TH} SELECT series, ts, CASE WHEN price > hi THEN hi + (price - hi) * 0.25 WHEN price < lo THEN lo - (lo - price) * 0.25 ELSE price END AS price FROM bars JOIN th USING (series)")
def _(spark, d):
    b = hour_bars(spark, d)
    return pj.soft_clip_to(b, band_thresholds(b, ["series"], ["price"]), ["series"], ["price"])


@query("fix_high_low", "series:s ts:t high:d low:d", f"""{BARS}, x AS (SELECT series, ts, open, price, CASE WHEN hour(ts) % 3 = 0 THEN high / 2 ELSE high END AS high, CASE WHEN hour(ts) % 4 = 0 THEN low * 2 ELSE low END AS low FROM bars)
SELECT series, ts, greatest(high, price, open) AS high, least(low, price, open) AS low FROM x""")
def _(spark, d):
    x = hour_bars(spark, d).withColumns({
        "high": F.when(F.hour("ts") % 3 == 0, F.col("high") / 2).otherwise(F.col("high")),
        "low": F.when(F.hour("ts") % 4 == 0, F.col("low") * 2).otherwise(F.col("low"))})
    return pj.fix_high_low(x)


@query("fix_open_gap", "series:s ts:t open:d", f"{DENSE} SELECT series, ts, CASE WHEN abs(open - {lagged('price')}) > 0.04 * price THEN {lagged('price')} ELSE open END AS open FROM dense")
def _(spark, d):
    return pj.fix_open_gap(hour_dense(spark, d), HOUR)


@query("split_unused_rows", "series:s ts:t price:d part:s", f"""{BARS}, x AS (SELECT series, ts, CASE WHEN ts < TIMESTAMP '2024-01-28' AND ticks > 1 THEN price END AS price FROM bars),
l AS (SELECT series, max(ts) AS last FROM x WHERE price IS NOT NULL GROUP BY 1)
SELECT series, ts, price, 'used' AS part FROM x WHERE price IS NOT NULL UNION ALL SELECT series, ts, price, 'unused' FROM x JOIN l USING (series) WHERE ts > last""")
def _(spark, d):
    keep = F.expr("ts < timestamp_ntz'2024-01-28'") & (F.col("ticks") > 1)
    used, unused = pj.split_unused(hour_bars(spark, d).select("series", "ts", F.when(keep, F.col("price")).alias("price")), ["series"], "ts", "price")
    return used.withColumn("part", F.lit("used")).unionByName(unused.withColumn("part", F.lit("unused")))


@query("clip_to_train_range", "series:s ts:t forecast:d", f"""{RET}, t AS (SELECT series, min("return") AS lo, max("return") AS hi FROM rets WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT series, ts, CASE WHEN "return" < lo THEN lo WHEN "return" > hi THEN hi ELSE "return" END AS forecast FROM rets JOIN t USING (series) WHERE ts >= TIMESTAMP '2024-01-10'""")
def _(spark, d):
    r = hour_returns(spark, d)
    train, test = r.where("ts < timestamp_ntz'2024-01-10'"), r.where("ts >= timestamp_ntz'2024-01-10'")
    return pj.clip_to_seen(test.withColumn("forecast", F.col("return")), train, ["series"], "forecast", "return")


@query("zscore_filter", "series:s ts:t price:d", f"{BARS}, m AS (SELECT series, avg(price) AS m, stddev_pop(price) AS s FROM bars GROUP BY 1) SELECT series, ts, price FROM bars JOIN m USING (series) WHERE abs((price - m) / s) < 2.1")
def _(spark, d):
    return pj.zscore_filter(hour_bars(spark, d), ["series"], "price")


@query("valid_forecast_gate", "series:s zero_share:d positive_share:d valid:b", f"""{RET}, s AS (SELECT series, avg(CASE WHEN "return" = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0 END) AS positive_share FROM rets GROUP BY 1)
SELECT *, zero_share <= 0.2 AND positive_share <= 0.67 AND positive_share >= 0.33 AS valid FROM s""")
def _(spark, d):
    return pj.valid_forecasts(hour_returns(spark, d), ["series"], "return")
