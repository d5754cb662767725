"""Streaming queries (survey section 2.10). Inputs are replayed in time order, one run per chunk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions.time import epoch_seconds
from barloom.operators.blocks import bounded, frame
from barloom.plans.base import BARS, DENSE, GAPPY, HOUR, W, hour_bars, hour_dense, hour_returns
from barloom.plans.q_backtest import BT_SQL, SETS, certain_rows
from barloom.plans.q_features import LINEAR, LINEAR_COLS, linear_features, scored_sql, stored_model
from barloom.plans.q_windows import ema_sql
from barloom.plans.registry import query
from barloom.session import fresh_path, stage
from barloom.sources.tables import table, ticks
from barloom.streaming import streams as st

CUTS = ["2024-01-11", "2024-01-21"]


def _replay(spark, parts, run):
    """State partitions stay at most 8 here: the replayed inputs are small."""
    st.replay(spark, parts, run, min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def chunks(df):
    """Three consecutive time ranges."""
    a, b = (f"timestamp_ntz'{c}'" for c in CUTS)
    return [df.where(f"ts < {a}"), df.where(f"ts >= {a} and ts < {b}"), df.where(f"ts >= {b}")]


@query("stream_tumbling_bars", "series:s ts:t open:d high:d low:d price:d volume:d", f"{BARS} SELECT series, ts, open, high, low, price, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)")
def _(spark, d):
    out = fresh_path(spark, "bars")
    _replay(spark, chunks(ticks(spark, d)), lambda s, c: st.run_append(st.tumbling_bars(s, 3600, "24 hours"), out, c))
    return spark.read.parquet(out)


# The fetches overlap by two days; the first and the last have no outer end
REV_TIMES = ["ts < TIMESTAMP '2024-01-11'", "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-21'", "ts >= TIMESTAMP '2024-01-19'"]
REV_SQL = """SELECT event_type AS series, date_trunc('hour', ts) AS ts, sum(value) * {f} AS volume, max(value) * {f} AS high FROM events WHERE {when} GROUP BY 1, 2"""


@query("stream_late_revision", "series:s ts:t volume:d high:d", f"""WITH a AS ({REV_SQL.format(f='1.0', when=REV_TIMES[0])}), b AS ({REV_SQL.format(f='1.01', when=REV_TIMES[1])}), c AS ({REV_SQL.format(f='1.02', when=REV_TIMES[2])}),
a2 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) > 24 AS final FROM a), ab AS (SELECT series, ts, CASE WHEN final THEN a2.volume ELSE coalesce(b.volume, a2.volume) END AS volume, CASE WHEN final THEN a2.high ELSE coalesce(b.high, a2.high) END AS high FROM a2 FULL OUTER JOIN b USING (series, ts)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) > 24 AS final FROM ab) SELECT series, ts, CASE WHEN final THEN b2.volume ELSE coalesce(c.volume, b2.volume) END AS volume, CASE WHEN final THEN b2.high ELSE coalesce(c.high, b2.high) END AS high FROM b2 FULL OUTER JOIN c USING (series, ts)""")
def _(spark, d):
    b = hour_bars(spark, d)
    part = lambda f, when: b.where(when.replace("TIMESTAMP", "timestamp_ntz")).select(
        "series", "ts", (F.col("volume") * f).alias("volume"), (F.col("high") * f).alias("high"))
    fetches = [part(f, when) for f, when in zip((1.0, 1.01, 1.02), REV_TIMES, strict=True)]
    path = fresh_path(spark, "revised")
    _replay(spark, fetches, lambda s, c: st.run_batches(s, st.revise(path, GAPPY), c))
    return spark.read.parquet(path)


@query("stream_incremental_append", "series:s ts:t mean_6:d", f"{BARS} SELECT series, ts, avg(price) OVER ({W} ROWS 5 PRECEDING) AS mean_6 FROM bars")
def _(spark, d):
    path, out = fresh_path(spark, "stored"), fresh_path(spark, "features")
    build = lambda df: bounded(df, GAPPY, lambda w: {"mean_6": F.avg("price").over(frame(w, 6))}, back=5)
    _replay(spark, chunks(hour_bars(spark, d).select("series", "ts", "price")), lambda s, c: st.run_batches(s, st.append_features(path, out, GAPPY, 10, build), c))
    return spark.read.parquet(out)


@query("stream_dedup", "event_id:i ts:t value:d", "SELECT event_id, date_trunc('second', ts) AS ts, value FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    doubled = [c.unionByName(c.where("event_id % 3 = 0")) for c in chunks(e)]
    out = fresh_path(spark, "unique")
    _replay(spark, doubled, lambda s, c: st.run_append(st.dedup(s, ["event_id"], "30 days"), out, c))
    return spark.read.parquet(out).withColumn("ts", F.expr("cast(date_trunc('SECOND', ts) as timestamp_ntz)"))


LATE = 6 * 3600


def late_chunks(df):
    """The three time ranges, every fifth bar of the last hours of a range handed in with the next one."""
    parts = []
    for i, cut in enumerate([*CUTS, None]):
        own = chunks(df)[i]
        slow = F.lit(False) if cut is None else (F.col("ts") >= F.expr(f"timestamp_ntz'{cut}' - interval 5 hours")) & (F.hour("ts") % 5 == 0)
        parts.append((own.where(~slow), own.where(slow)))
    return [parts[0][0], parts[1][0].unionByName(parts[0][1]), parts[2][0].unionByName(parts[1][1])]


@query("stream_position_state", "series:s ts:t flow:s trading_signal:b", BT_SQL + " SELECT * FROM tab WHERE pid = 1")
def _(spark, d):
    """Late bars included."""
    rows = certain_rows(spark, d).where("pid = 1").select("series", "ts", "certainty", "kind", "open", "high", "low")
    folder, out = fresh_path(spark, "position"), fresh_path(spark, "positions")
    handle = st.carry_on(folder, out, HOUR, LATE, *st.position_step(HOUR, SETS[0]))
    _replay(spark, late_chunks(rows), lambda s, c: st.run_batches(s, handle, c))
    return spark.read.parquet(out)


@query("stream_ema_state", "series:s ts:t ema:d ha_open:d", ema_sql({"ema": ("price", 2 / 11), "ha_open": ("x", 0.5)}, "hain", f"{DENSE}, hain AS (SELECT *, coalesce((lag(open) OVER ({W}) + lag(high) OVER ({W}) + lag(low) OVER ({W}) + lag(price) OVER ({W})) / 4, (open + price) / 2) AS x FROM dense)") + " SELECT * FROM em")
def _(spark, d):
    """Late bars included."""
    rows = hour_dense(spark, d).select("series", "ts", "open", "high", "low", "price")
    folder, out = fresh_path(spark, "ema"), fresh_path(spark, "averages")
    handle = st.carry_on(folder, out, HOUR, LATE, *st.ema_step(HOUR, 2 / 11))
    _replay(spark, late_chunks(rows), lambda s, c: st.run_batches(s, handle, c))
    return spark.read.parquet(out)


@query("stream_snapshot_store", "series:s ts:t price:d snapshot:s", f"""{BARS}, c AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS k FROM bars)
SELECT series, ts, price, strftime(max(ts) OVER (PARTITION BY k), '%Y%m%d%H%M%S') AS snapshot FROM c WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY series, k ORDER BY ts DESC) <= 150""")
def _(spark, d):
    path = fresh_path(spark, "snapshots")
    rows = hour_bars(spark, d).select("series", "ts", "price")
    _replay(spark, chunks(rows), lambda s, c: st.run_batches(s, st.store_snapshot(path, GAPPY), c))
    return st.live_snapshots(spark, path, rows.schema, 2)


@query("stream_freshness", "series:s hours_old:d stale:b", """SELECT event_type AS series, epoch(TIMESTAMP '2024-01-31 06:00:00' - max(date_trunc('second', ts))) / 3600.0 AS hours_old, epoch(TIMESTAMP '2024-01-31 06:00:00' - max(date_trunc('second', ts))) / 3600.0 > 12 AS stale FROM events GROUP BY 1""")
def _(spark, d):
    path = fresh_path(spark, "seen")
    _replay(spark, chunks(ticks(spark, d)), lambda s, c: st.run_batches(
        st.last_seen(s), lambda batch, _: batch.write.mode("overwrite").parquet(path), c, "complete"))
    now = dt.datetime(2024, 1, 31, 6, 0, 0, tzinfo=dt.timezone.utc)
    age = (F.lit(int(now.timestamp())) - epoch_seconds("last_ts")) / 3600
    return spark.read.parquet(path).select("series", age.alias("hours_old"), (age > 12).alias("stale"))


@query("stream_score_latest", "series:s ts:t return_forecast:d certainty:d kind:s tp_price:d sl_price:d", scored_sql(CUTS[0], f"""
SELECT * EXCLUDE (k) FROM (SELECT *, CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 1 WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 2 ELSE 3 END AS k FROM rets) QUALIFY row_number() OVER (PARTITION BY series, k ORDER BY ts DESC) = 1"""))
def _(spark, d):
    store, out = stored_model(spark, d, CUTS[0]), fresh_path(spark, "scored")
    handle = st.score_newest(store, fresh_path(spark, "tails"), out, HOUR, LINEAR_COLS, 24, linear_features, LINEAR, SETS[0])
    _replay(spark, chunks(hour_returns(spark, d).select("series", "ts", *LINEAR_COLS)), lambda s, c: st.run_batches(s, handle, c))
    return spark.read.parquet(out)
