"""Set, de-duplication, sort and limit queries (survey sections 2.6 and 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.time import bucket_start
from barloom.operators import sets
from barloom.operators.bars import gap_fill, missing_bars
from barloom.plans.base import BARS, DAYS, GAPPY, USER, W, day_bars, hour_bars, sql_grid, user_bars, SIX
from barloom.plans.q_windows import SCORES_SQL, column_scores
from barloom.plans.registry import query
from barloom.sources.tables import table


@query("sort_by_time", "series:s ts:t price:d", f"{BARS} SELECT series, ts, price FROM bars ORDER BY ts, series")
def _(spark, d):
    return hour_bars(spark, d).orderBy("ts", "series")


@query("tail_n_per_series", "series:s ts:t price:d", f"""{USER} SELECT series, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS rn FROM ubars) WHERE rn <= 24""")
def _(spark, d):
    return sets.tail_rows(user_bars(spark, d), SIX, 24)


@query("top_k_features", "series:s feature:s score:d rank:i", f"""{SCORES_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) AS rank FROM scores) WHERE rank <= 3""")
def _(spark, d):
    return sets.top_k(column_scores(spark, d), ["series"], [F.col("score").desc(), F.col("feature")], 3)


@query("top_peers", "l_suppkey:i volume:d2", "SELECT l_suppkey, sum(l_quantity) AS volume FROM lineitem GROUP BY l_suppkey ORDER BY volume DESC, l_suppkey LIMIT 8")
def _(spark, d):
    volume = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("volume"))
    return volume.orderBy(F.col("volume").desc(), "l_suppkey").limit(8)


@query("best_parameter_set", "series:s best:s metric:d", """SELECT l_returnflag || l_linestatus AS series, arg_max(CAST(l_linenumber AS VARCHAR), (m, -l_linenumber)) AS best, max(m) AS metric FROM
 (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("series"), "l_linenumber").agg(F.avg("l_discount").alias("m"))
    return m.groupBy("series").agg(
        F.max_by(F.col("l_linenumber").cast("string"), F.struct("m", -F.col("l_linenumber"))).alias("best"), F.max("m").alias("metric"))


@query("batch_dates", "series:s ts:t batch:i", f"{BARS} SELECT series, ts, (row_number() OVER ({W}) - 1) // 20 AS batch FROM bars")
def _(spark, d):
    return sets.batches(hour_bars(spark, d), GAPPY, 20)


@query("union_rows", "series:s ts:t price:d ticks:i source:s", f"""{BARS}, {DAYS[5:]} SELECT series, ts, price, NULL AS ticks, 'hour' AS source FROM bars
 UNION ALL SELECT series, ts, price, ticks, 'day' AS source FROM days""")
def _(spark, d):
    return sets.union_rows(hour_bars(spark, d).drop("ticks").withColumn("source", F.lit("hour")), day_bars(spark, d).withColumn("source", F.lit("day")))


def _hourly(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("series"), bucket_start("ts", 3600).alias("ts"), "event_id", F.col("value").alias("price"))


@query("dedup_first", "series:s ts:t price:d", "SELECT event_type AS series, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS price FROM events GROUP BY 1, 2")
def _(spark, d):
    return sets.dedup(_hourly(spark, d), ["series", "ts"], F.col("event_id"), "first")


@query("dedup_last", "series:s ts:t price:d", "SELECT event_type AS series, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS price FROM events GROUP BY 1, 2")
def _(spark, d):
    return sets.dedup(_hourly(spark, d), ["series", "ts"], F.col("event_id"), "last")


@query("missing_timestamps", "series:s ts:t", f"{USER}, g AS ({sql_grid('ubars', 21600)}) SELECT series, ts FROM g EXCEPT SELECT series, ts FROM ubars")
def _(spark, d):
    return missing_bars(user_bars(spark, d), SIX)


@query("gap_fill_grid", "series:s ts:t open:d price:d ticks:i", f"{USER}, g AS ({sql_grid('ubars', 21600)}) SELECT * FROM g")
def _(spark, d):
    return gap_fill(user_bars(spark, d), SIX)


@query("column_symmetric_diff", "name:s side:s filled:i", """SELECT 'c_mktsegment' AS name, 'left' AS side, count(c_mktsegment) AS filled FROM customer
 UNION ALL SELECT 's_suppkey', 'right', count(s_suppkey) FROM supplier UNION ALL SELECT 'c_custkey', 'left', count(c_custkey) FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer").withColumnsRenamed({"c_name": "name", "c_nationkey": "nationkey", "c_acctbal": "acctbal"})
    s = table(spark, d, "supplier").withColumnsRenamed({"s_name": "name", "s_nationkey": "nationkey", "s_acctbal": "acctbal"})
    left, right = sets.column_symmetric_diff(c, s)
    count = lambda f, cols, side: f.agg(*[F.count(x).alias(x) for x in cols]).unpivot([], cols, "name", "filled").withColumn("side", F.lit(side))
    return sets.union_rows(count(c, left, "left"), count(s, right, "right"))


_DAYS_OF = "SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = "


@query("key_symmetric_diff", "user_id:i day:t side:s", f"""WITH a AS ({_DAYS_OF} 'purchase'), b AS ({_DAYS_OF} 'signup')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(spark, d):
    days = table(spark, d, "events").select("user_id", bucket_start("ts", 86400).alias("day"), "event_type")
    return sets.key_symmetric_diff(days.where("event_type = 'purchase'"), days.where("event_type = 'signup'"), ["user_id", "day"])


@query("ordered_union_lists", "l_partkey:i position:i", """WITH t AS (SELECT l_partkey, sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1),
a AS (SELECT l_partkey, 0 AS l, row_number() OVER (ORDER BY q DESC, l_partkey) AS r FROM t QUALIFY r <= 50),
b AS (SELECT l_partkey, 1 AS l, row_number() OVER (ORDER BY p DESC, l_partkey) AS r FROM t QUALIFY r <= 50),
u AS (SELECT l_partkey, min((l, r)) AS spot FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT l_partkey, row_number() OVER (ORDER BY spot) AS position FROM u QUALIFY position <= 70""")
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    lists = []
    for c in ("q", "p"):
        top = t.orderBy(F.col(c).desc(), "l_partkey").limit(50)
        lists.append(sets.top_k(top, [], [F.col(c).desc(), F.col("l_partkey")], 50, "r"))
    return sets.ordered_union(lists, "l_partkey", "r", 70)


@query("overlap_merge", "series:s ts:t price:d volume:d", f"""{BARS}, old AS (SELECT series, ts, price, volume FROM bars WHERE ts < TIMESTAMP '2024-01-20'),
new AS (SELECT series, ts, price * 1.01 AS price, CASE WHEN ticks > 1 THEN volume END AS volume FROM bars WHERE ts >= TIMESTAMP '2024-01-15'),
o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) > 24 AS final FROM old)
SELECT series, ts, coalesce(CASE WHEN final THEN o.price END, n.price, o.price) AS price, coalesce(CASE WHEN final THEN o.volume END, n.volume, o.volume) AS volume
FROM o FULL OUTER JOIN new n USING (series, ts)""")
def _(spark, d):
    b = hour_bars(spark, d)
    old = b.where("ts < timestamp_ntz'2024-01-20'").select("series", "ts", "price", "volume")
    new = b.where("ts >= timestamp_ntz'2024-01-15'").select(
        "series", "ts", (F.col("price") * 1.01).alias("price"), F.when(F.col("ticks") > 1, F.col("volume")).alias("volume"))
    return sets.overlap_merge(old, new, GAPPY)
