"""Join queries (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.time import bucket_start
from barloom.operators import joins
from barloom.operators.blocks import bounded
from barloom.plans.base import BARS, DENSE, HOUR, hour_bars, hour_dense
from barloom.plans.q_windows import bf, lagged
from barloom.plans.registry import query
from barloom.session import join_staged, stage
from barloom.sources.tables import table

# The series of the event table.
PEERS = ["click", "error", "purchase", "signup", "view"]
KEY = ["series", "ts"]

BIG_SQL = "big AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, max(value) AS peak, count(*) AS n FROM events WHERE value > 80 GROUP BY 1, 2)"


def big(spark, d):
    """Hours with a tick above 80."""
    return table(spark, d, "events").where("value > 80").groupBy(
        F.col("event_type").alias("series"), bucket_start("ts", 3600).alias("ts")).agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))


@query("align_full_outer", "series:s ts:t price:d peak:d", f"""{BARS}, {BIG_SQL}, late AS (SELECT series, ts + INTERVAL 1 HOUR AS ts, peak FROM big)
SELECT series, ts, price, peak FROM bars FULL OUTER JOIN late USING (series, ts)""")
def _(spark, d):
    late = big(spark, d).select("series", F.expr("ts + interval '1' hour").alias("ts"), "peak")
    return joins.align([hour_bars(spark, d), late], KEY, "full_outer")


@query("align_inner", "series:s ts:t price:d peak:d before:d", f"""{BARS}, {BIG_SQL} SELECT b.series, b.ts, b.price, g.peak, p.price AS before
FROM bars b JOIN big g USING (series, ts) JOIN bars p ON p.series = b.series AND p.ts = b.ts - INTERVAL 1 HOUR""")
def _(spark, d):
    b = hour_bars(spark, d)
    before = b.select("series", F.expr("ts + interval '1' hour").alias("ts"), F.col("price").alias("before"))
    return joins.align([b, big(spark, d), before], KEY)


@query("semi_join_index", "series:s ts:t price:d", f"{BARS}, {BIG_SQL} SELECT series, ts, price FROM bars b WHERE EXISTS (SELECT 1 FROM big g WHERE g.series = b.series AND g.ts = b.ts)")
def _(spark, d):
    return joins.align([hour_bars(spark, d), big(spark, d)], KEY, "left_semi")


@query("anti_join_index", "series:s ts:t price:d", f"{BARS}, {BIG_SQL} SELECT series, ts, price FROM bars b WHERE NOT EXISTS (SELECT 1 FROM big g WHERE g.series = b.series AND g.ts = b.ts)")
def _(spark, d):
    return joins.align([hour_bars(spark, d), big(spark, d)], KEY, "left_anti")


@query("coalesce_join", "series:s ts:t price:d volume:d peak:d", f"""{BARS}, {BIG_SQL}, a AS (SELECT series, ts, CASE WHEN ticks > 1 THEN price END AS price, volume FROM bars),
b AS (SELECT series, ts + INTERVAL 1 HOUR AS ts, peak AS price, peak FROM big)
SELECT series, ts, coalesce(a.price, b.price) AS price, volume, peak FROM a FULL OUTER JOIN b USING (series, ts)""")
def _(spark, d):
    a = hour_bars(spark, d).select("series", "ts", F.when(F.col("ticks") > 1, F.col("price")).alias("price"), "volume")
    b = big(spark, d).select("series", F.expr("ts + interval '1' hour").alias("ts"), F.col("peak").alias("price"), "peak")
    return joins.coalesce_join(a, b, KEY)


@query("pivot_peer_prices", "ts:t " + " ".join(f"{p}_{c}:d" for p in PEERS for c in ("price", "volume")), f"""{BARS} SELECT ts,
 {", ".join(f"max({c}) FILTER (series = '{p}') AS {p}_{c}" for p in PEERS for c in ("price", "volume"))} FROM bars GROUP BY ts""")
def _(spark, d):
    return joins.pivot_peers(hour_bars(spark, d), PEERS, ["price", "volume"])


@query("lookup_last_price", "user_id:i series:s amount:d usd_amount:d4", """WITH lp AS (SELECT event_type AS series, CASE WHEN event_type = 'view' THEN 1 ELSE arg_max(value, (ts, event_id)) END AS p FROM events GROUP BY event_type),
b AS (SELECT user_id, event_type AS series, sum(value) AS amount FROM events GROUP BY 1, 2) SELECT user_id, series, amount, amount * p AS usd_amount FROM b JOIN lp USING (series)""")
def _(spark, d):
    stable = F.col("series") == "view"
    prices = joins.last_prices(hour_bars(spark, d)).withColumn("last_price", F.when(stable, 1.0).otherwise(F.col("last_price")))
    held = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("series")).agg(F.sum("value").alias("amount"))
    return join_staged(held, prices, ["series"]).withColumn("usd_amount", F.col("amount") * F.col("last_price"))


GRID_OF_RULES = [{"threshold": t, "fee": f} for t in (0.5, 0.6, 0.7) for f in (-0.001, -0.0004)]


@query("parameter_cross_join", "series:s threshold:d fee:d n:i cost:d", f"""{BARS}, p AS (SELECT * FROM (VALUES {", ".join(f"({p['threshold']}, {p['fee']})" for p in GRID_OF_RULES)}) v(threshold, fee))
SELECT series, threshold, fee, count(*) AS n, sum(price * fee) AS cost FROM bars, p WHERE price / high > threshold GROUP BY ALL""")
def _(spark, d):
    rows = joins.with_parameters(hour_bars(spark, d), GRID_OF_RULES)
    return rows.where(F.try_divide("price", "high") > F.col("param.threshold")).groupBy(
        "series", F.col("param.threshold").alias("threshold"), F.col("param.fee").alias("fee")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("price") * F.col("param.fee")).alias("cost"))


# Snapshots: at each midnight the last 48 hours as then known; the newest three bars still show an older price.
SNAP_SQL = f"""{DENSE}, snaps AS (SELECT series, t AS snapshot_ts, ts, CASE date_diff('hour', ts, t) WHEN 0 THEN p3 WHEN 1 THEN p2 WHEN 2 THEN p1 ELSE price END AS price, volume FROM
 (SELECT *, date_trunc('day', ts - INTERVAL 1 SECOND) + to_days(CAST(k AS INT)) AS t FROM (SELECT *, {lagged("price", 1)} AS p1, {lagged("price", 2)} AS p2, {lagged("price", 3)} AS p3 FROM dense), (VALUES (1), (2)) v(k)))"""


def snapshots(spark, d):
    lagged_rows = bounded(hour_dense(spark, d), HOUR, lambda w: {f"_p{k}": F.lag("price", k).over(w) for k in (1, 2, 3)}, back=3)
    day = F.expr("cast(date_trunc('DAY', ts - interval '1' second) as timestamp_ntz)")
    rows = lagged_rows.withColumn("_day", day).withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumn("snapshot_ts", F.expr("_day + _k * interval '1' day"))
    age = F.timestamp_diff("HOUR", F.col("ts"), F.col("snapshot_ts"))
    seen = F.when(age == 0, F.col("_p3")).when(age == 1, F.col("_p2")).when(age == 2, F.col("_p1")).otherwise(F.col("price"))
    return stage(rows.select("series", "snapshot_ts", "ts", seen.alias("price"), "volume"))


PAIR_SQL = f"""{SNAP_SQL}, pairs AS (SELECT *, row_number() OVER (PARTITION BY series, snapshot_ts ORDER BY ts) - 1 AS pos FROM (SELECT o.series, o.snapshot_ts, o.ts, abs(o.price - n.price) AS price, abs(o.volume - n.volume) AS volume
FROM snaps o JOIN snaps n ON n.series = o.series AND n.ts = o.ts AND n.snapshot_ts = o.snapshot_ts + INTERVAL 1 DAY
QUALIFY row_number() OVER (PARTITION BY o.series, o.snapshot_ts ORDER BY o.ts DESC) <= 24))"""


def pairs(spark, d):
    return joins.snapshot_pairs(snapshots(spark, d), ["series"], 86400, ["price", "volume"], 24)


@query("snapshot_self_join", "series:s snapshot_ts:t ts:t pos:i price:d volume:d", f"{PAIR_SQL} SELECT * FROM pairs")
def _(spark, d):
    return pairs(spark, d)


@query("lagged_join", "series:s ts:t price:d peak:d", f"""{DENSE}, {BIG_SQL}, j AS (SELECT series, ts, price, peak FROM dense LEFT JOIN big USING (series, ts)),
l AS (SELECT series, ts, price, {lagged("peak")} AS p FROM j) SELECT series, ts, price, {bf("p")} AS peak FROM l""")
def _(spark, d):
    return joins.join_late(hour_dense(spark, d), big(spark, d).drop("n"), HOUR, ["peak"])
