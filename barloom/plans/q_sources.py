"""Source and sink queries (survey section 2.1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions.time import bucket_start, epoch_seconds
from barloom.operators import aggregate as ag
from barloom.operators.blocks import Grid
from barloom.plans.base import BARS, DAYS, GAPPY, RET, USER, W, day_bars, hour_bars, hour_returns, user_bars
from barloom.plans.registry import query
from barloom.operators.quality import null_ratio
from barloom.session import fresh_path, stage
from barloom.sources import ingest, storage
from barloom.sources.tables import table


def _twice_loaded(spark, d, column: str) -> str:
    """Daily bars written in two loads; the second one revises the prices of 1998 and later."""
    path = fresh_path(spark, "days")
    days = day_bars(spark, d).select("series", "ts", "price", "ticks")
    storage.write_partitioned(days.withColumn("load", F.lit(1)), path, column)
    later = days.where(F.year("ts") >= 1998).withColumn("price", F.col("price") * 1.5)
    storage.write_partitioned(later.withColumn("load", F.lit(2)), path, column)
    return path


LATEST = f"{DAYS}, latest AS (SELECT series, ts, CASE WHEN year(ts) >= 1998 THEN price * 1.5 ELSE price END AS price, ticks FROM days)"


@query("scan_dedup_latest", "series:s ts:t price:d4 ticks:i", f"{LATEST} SELECT * FROM latest")
def _(spark, d):
    raw = spark.read.parquet(_twice_loaded(spark, d, "year_quarter"))
    return storage.latest_rows(raw, ["series", "ts"], "load", ["year_quarter"])


@query("scan_recent_partitions", "series:s ts:t price:d4 load:i", f"""{DAYS} SELECT series, ts, price, 1 AS load FROM days WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1998-04-01'
 UNION ALL SELECT series, ts, price * 1.5, 2 FROM days WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1998-04-01'""")
def _(spark, d):
    return storage.read_recent(spark, _twice_loaded(spark, d, "year_month"), "year_month", dt.date(1998, 3, 10))


@query("scan_extra_filters", "series:s ts:t price:d4 load:i", f"""{DAYS} SELECT series, ts, price, 1 AS load FROM days WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1998-07-01'
 AND series IN ('1-URGENT', '5-LOW') AND ticks >= 2""")
def _(spark, d):
    filters = [("series", "in", ["1-URGENT", "5-LOW"]), ("ticks", ">=", 2), ("load", "=", 1)]
    return storage.read_recent(spark, _twice_loaded(spark, d, "year_quarter"), "year_quarter", dt.date(1998, 5, 10), filters)


def _text(c):
    return F.col(c).cast("string")


@query("ingest_klines", "series:s ts:t open:d high:d low:d price:d volume:d", f"""{USER}, x AS (SELECT *, price - lag(price) OVER ({W}) AS r FROM (SELECT * REPLACE (floor(price / 40) * 40 AS price) FROM ubars)),
y AS (SELECT *, r - lag(r) OVER ({W}) AS a FROM x), z AS (SELECT *, a - lag(a) OVER ({W}) AS j FROM y),
k AS (SELECT * FROM z WHERE NOT coalesce(r = 0 AND a = 0 AND j = 0, false))
SELECT series, ts, open, high, low, price, volume FROM k QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) BETWEEN 2 AND 60""")
def _(spark, d):
    coarse = (F.floor(F.col("price") / 40) * 40).cast("double").cast("string")
    raw = user_bars(spark, d).select("series", F.array(
        (epoch_seconds("ts") * 1000).cast("string"), _text("open"), _text("high"), _text("low"), coarse, _text("volume"), F.lit("0")).alias("row"))
    return ingest.klines(stage(raw), Grid(step=21600, dense=False), 60)


_RATIO = "SELECT date_trunc('hour', ts) AS ts, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0 END) AS p FROM events {} GROUP BY 1"


@query("ingest_ratio", "ts:t long_short_global_long_perc:d long_short_global_long_short_ratio:d long_short_top_traders_long_perc:d long_short_top_traders_long_short_ratio:d long_short_top_global_ratio:d", f"""WITH g AS ({_RATIO.format('')}), t AS ({_RATIO.format("WHERE user_id < 60")}),
j AS (SELECT ts, g.p AS gp, g.p / nullif(1 - g.p, 0) AS gr, t.p AS tp, t.p / nullif(1 - t.p, 0) AS tr FROM g FULL OUTER JOIN t USING (ts))
SELECT ts, gp AS long_short_global_long_perc, gr AS long_short_global_long_short_ratio, tp AS long_short_top_traders_long_perc, tr AS long_short_top_traders_long_short_ratio, tr / nullif(gr, 0) AS long_short_top_global_ratio FROM j""")
def _(spark, d):
    def raw(e):
        p = e.groupBy(bucket_start("ts", 3600).alias("_h")).agg(F.avg(F.when(F.col("value") > 60, 1.0).otherwise(0.0)).alias("p"))
        return p.select(F.lit("XUSDC").alias("symbol"), _text("p").alias("longAccount"), (1 - F.col("p")).cast("string").alias("shortAccount"),
                        F.try_divide(F.col("p"), 1 - F.col("p")).cast("string").alias("longShortRatio"), (epoch_seconds("_h") * 1000).alias("timestamp"))
    e = table(spark, d, "events")
    return ingest.account_ratios(raw(e), raw(e.where("user_id < 60")))


_WIDEST = ["volume", "price", "high", "low", "ticks", "open"]  # the largest of all series at a time


@query("ingest_sentiment", "ts:t " + " ".join(f"sentiment_lc_{c}:d" for c in ingest.SOCIAL), f"""{BARS}, m AS (SELECT ts, {", ".join(f"max({c}) AS {c}" for c in _WIDEST)} FROM bars GROUP BY ts) SELECT ts, volume AS sentiment_lc_circulating_supply, price AS sentiment_lc_galaxy_score,
 high - low AS sentiment_lc_volatility, ticks AS sentiment_lc_alt_rank, open AS sentiment_lc_contributors_active, high AS sentiment_lc_posts_active, low AS sentiment_lc_interactions, price / high AS sentiment_lc_social_dominance FROM m""")
def _(spark, d):
    b = hour_bars(spark, d).groupBy("ts").agg(*[F.max(c).alias(c) for c in _WIDEST])
    raw = b.select(epoch_seconds("ts").cast("string").alias("time"), F.lit("x").alias("market_dominance"), *[c.cast("string").alias(n) for n, c in zip(ingest.SOCIAL, [
        F.col("volume"), F.col("price"), F.col("high") - F.col("low"), F.col("ticks"), F.col("open"), F.col("high"), F.col("low"), F.try_divide("price", "high")])])
    return ingest.sentiment(raw)


_DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS v, count(*) AS n, max(value) AS hi FROM events GROUP BY 1"


def _daily(spark, d):
    return table(spark, d, "events").groupBy(bucket_start("ts", 86400).alias("ts")).agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"))


@query("ingest_fear_greed", "ts:t sentiment_btc_fgi_btc_fgi:i sentiment_btc_fgi_btc_fgi_class:s", f"""SELECT ts, floor(v) AS sentiment_btc_fgi_btc_fgi, CASE WHEN v > 50 THEN 'Greed' ELSE 'Fear' END AS sentiment_btc_fgi_btc_fgi_class FROM ({_DAILY})""")
def _(spark, d):
    return ingest.fear_greed(_daily(spark, d).select(
        (epoch_seconds("ts") + 17).cast("string").alias("timestamp"), F.floor("v").cast("string").alias("value"),
        F.when(F.col("v") > 50, "Greed").otherwise("Fear").alias("value_classification"), F.lit("1").alias("time_until_update")))


@query("ingest_economic", "ts:t economic_treasury_yield:d4 economic_interest_rate:d4", f"""WITH x AS ({_DAILY}), a AS (SELECT ts, CASE WHEN day(ts) % 3 = 0 THEN 0 ELSE round(v, 4) END AS y FROM x), b AS (SELECT ts + INTERVAL 2 DAY AS ts, round(hi, 2) AS r FROM x)
SELECT ts, y AS economic_treasury_yield, r AS economic_interest_rate FROM a FULL OUTER JOIN b USING (ts) ORDER BY ts DESC LIMIT 25""")
def _(spark, d):
    x = _daily(spark, d)
    a = x.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.dayofmonth("ts") % 3 == 0, ".").otherwise(F.round("v", 4).cast("string")).alias("value"))
    b = x.select(F.date_format(F.expr("ts + interval '2' day"), "yyyy-MM-dd").alias("date"), F.round("hi", 2).cast("string").alias("value"))
    return ingest.economic(a, b, 25)


@query("ingest_on_chain", "ts:t on_chain_total_transactions:d on_chain_miners_revenue_usd:d", f"""{BARS}, a AS (SELECT ts, price FROM bars WHERE series = 'click'), b AS (SELECT ts + INTERVAL 10 MINUTE AS ts, volume FROM bars WHERE series = 'view'),
j AS (SELECT ts, price, volume FROM a FULL OUTER JOIN b USING (ts)) SELECT time_bucket(INTERVAL 3 HOUR, ts) AS ts, arg_min(price, ts) FILTER (price IS NOT NULL) AS on_chain_total_transactions,
 arg_min(volume, ts) FILTER (volume IS NOT NULL) AS on_chain_miners_revenue_usd FROM j GROUP BY 1 ORDER BY 1 DESC LIMIT 200""")
def _(spark, d):
    b = hour_bars(spark, d)
    a = b.where("series = 'click'").select(epoch_seconds("ts").alias("x"), F.col("price").alias("y"))
    v = b.where("series = 'view'").select((epoch_seconds("ts") + 600).alias("x"), F.col("volume").alias("y"))
    return ingest.on_chain({"total_transactions": a, "miners_revenue_usd": v}, 3 * 3600, 200)


@query("ingest_stock_close", "ts:t stock_click_price:d stock_view_price:d", """SELECT date_trunc('hour', ts + INTERVAL 5 HOUR) AS ts, arg_min(value, ts) FILTER (event_type = 'click') AS stock_click_price,
 arg_min(value, ts) FILTER (event_type = 'view') AS stock_view_price FROM events GROUP BY 1""")
def _(spark, d):
    raw = table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("close"), F.col("ts").alias("local"))
    return ingest.stock_closes(raw, ["click", "view"], "America/New_York", 3600)


def uniform_sql(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({' || {0} || '.join(parts).format(chr(39) + '|' + chr(39))}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("combined_panel", "series:s ts:t target:d price:d", f"""{RET}, j AS (SELECT r.series, r.ts, r."return" AS target, b.price FROM rets r JOIN bars b ON b.series = r.series AND b.ts = r.ts),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= floor(count(*) OVER (PARTITION BY series) * 0.75))
SELECT * FROM k WHERE {uniform_sql("series", STAMP, "''")} < 0.6""")
def _(spark, d):
    y = hour_returns(spark, d).select("series", "ts", F.col("return").alias("target"))
    x = hour_bars(spark, d).select("series", "ts", "price")
    return ingest.combined_panel(y, x, GAPPY, 0.75, 0.6)


@query("modeling_dataset", "series:s ts:t target:d price:d volume:d jerk:d", f"""{RET} SELECT r.series, r.ts, r."return" AS target, b.price, b.volume, r.jerk FROM rets r JOIN bars b ON b.series = r.series AND b.ts = r.ts
 WHERE b.ticks > 1 QUALIFY row_number() OVER (PARTITION BY r.series ORDER BY r.ts DESC) <= 150""")
def _(spark, d):
    r, b = hour_returns(spark, d), hour_bars(spark, d)
    frames = [r.select("series", "ts", F.col("return").alias("target")), b.select("series", "ts", "price"),
              b.where("ticks > 1").select("series", "ts", "volume"), r.select("series", "ts", "jerk")]
    return ingest.modeling_dataset(frames, GAPPY, 150)


@query("write_year_month", "series:s ts:t price:d4 year_month:s", f"{DAYS} SELECT series, ts, price, year(ts) || '_' || month(ts) AS year_month FROM days")
def _(spark, d):
    path = fresh_path(spark, "ym")
    storage.write_partitioned(day_bars(spark, d).select("series", "ts", "price"), path, "year_month", mode="overwrite")
    return spark.read.schema("series string, ts timestamp_ntz, price double, year_month string").parquet(path)


@query("write_overwrite_partitions", "series:s ts:t price:d4", f"{DAYS} SELECT series, ts, CASE WHEN year(ts) = 1997 THEN -price ELSE price END AS price FROM days WHERE NOT (year(ts) = 1997 AND ticks = 1 AND quarter(ts) = 2)")
def _(spark, d):
    path = fresh_path(spark, "ow")
    days = day_bars(spark, d).select("series", "ts", "price", "ticks")
    storage.write_partitioned(days, path, "year_quarter", mode="overwrite")
    redo = days.where((F.year("ts") == 1997) & ~((F.col("ticks") == 1) & (F.quarter("ts") == 2))).withColumn("price", -F.col("price"))
    storage.write_partitioned(redo, path, "year_quarter", mode="partitions")
    return spark.read.parquet(path)


@query("json_asset", "series:s low:d high:d", f"{BARS} SELECT series, avg(price) - 1.96 * stddev_samp(price) AS low, avg(price) + 1.96 * stddev_samp(price) AS high FROM bars GROUP BY series")
def _(spark, d):
    path = fresh_path(spark, "rules")
    storage.write_json(ag.band_thresholds(hour_bars(spark, d), ["series"], ["price"]), path)
    return storage.read_json(spark, path, "series string, price_low double, price_high double").withColumnsRenamed({"price_low": "low", "price_high": "high"})


@query("quality_gated_write", "series:s ts:t price:d attempt:i", f"{BARS} SELECT series, ts, price, 2 AS attempt FROM bars")
def _(spark, d):
    path, out = fresh_path(spark, "gated"), None
    for attempt, frame in enumerate([hour_bars(spark, d).withColumn("price", F.when(F.col("ticks") > 1, F.col("price"))), hour_bars(spark, d)], 1):
        report = null_ratio(frame, ["series"], {"price": 0.1})
        if storage.gated_write(frame.select("series", "ts", "price"), report, path, 1):
            out = spark.read.parquet(path).withColumn("attempt", F.lit(attempt))
    return out


def _backed_up(spark, d, last: dt.datetime | None):
    path = fresh_path(spark, "backup")
    b = hour_bars(spark, d).select("series", "ts", "price")
    first = storage.backup(b, path, last, True)
    skipped = storage.backup(b, path, first, True)
    return path, first, skipped


@query("backup_snapshot", "series:s ts:t price:d snapshot:s", f"{BARS} SELECT series, ts, price, strftime((SELECT max(ts) FROM bars), '%Y%m%d%H%M%S') AS snapshot FROM bars")
def _(spark, d):
    path, first, skipped = _backed_up(spark, d, None)
    if first != skipped:
        raise ValueError("a second snapshot within 48 hours was written")
    return spark.read.schema("series string, ts timestamp_ntz, price double, snapshot string").parquet(path)


@query("restore_snapshot", "series:s ts:t price:d", f"{BARS} SELECT series, ts, price FROM bars")
def _(spark, d):
    path, last, _ = _backed_up(spark, d, None)
    damaged = hour_bars(spark, d).select("series", "ts", F.lit(None).cast("double").alias("price"))
    return storage.restore(damaged, path, last)


@query("series_shapes", "series:s n_rows:i n_columns:i", f"{USER} SELECT series, count(*) AS n_rows, 7 AS n_columns FROM ubars GROUP BY series")
def _(spark, d):
    return storage.series_shapes(user_bars(spark, d), ["series"])
