"""Input frames shared by the catalog, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.bars import bars, dense_bars, gap_fill, with_derivatives
from barloom.operators.blocks import Grid
from barloom.session import stage
from barloom.sources.tables import table, ticks

HOUR = Grid(step=3600)
GAPPY = Grid(step=3600, dense=False)
SIX = Grid(step=6 * 3600)
DAY = Grid(step=86400)


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stage_table(build):
    """Stage tables of the catalog: written once per session and input folder, read by every query on it."""
    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, build.__name__)
        if key not in _TABLES:
            _TABLES[key] = stage(build(spark, d), build.__name__)
        return _TABLES[key]
    get.build = build
    return get


@stage_table
def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars per event type; empty hours have no row."""
    return bars(ticks(spark, d), 3600)


@stage_table
def half_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars(ticks(spark, d), 1800)


@stage_table
def hour_grid(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars on the full grid; empty hours hold nulls."""
    return gap_fill(hour_bars(spark, d), HOUR)


@stage_table
def hour_dense(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars on the full grid, filled."""
    return dense_bars(hour_bars(spark, d), HOUR)


@stage_table
def user_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars(ticks(spark, d, "user_id"), 6 * 3600)


@stage_table
def user_dense(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour bars per user, filled: many series, grows with the data."""
    return dense_bars(user_bars(spark, d), SIX)


@stage_table
def hour_returns(spark: SparkSession, d: str) -> DataFrame:
    """Filled hourly bars with return, acceleration and jerk."""
    return with_derivatives(hour_dense(spark, d), HOUR)


@stage_table
def day_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of order totals per order priority."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"),
    )
    return bars(o, 86400)


def sql_bars(by: str = "event_type", step: int = 3600) -> str:
    return f"""SELECT CAST({by} AS VARCHAR) AS series, time_bucket(INTERVAL '{step} seconds', ts, TIMESTAMP '1970-01-01') AS ts,
 arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS price,
 sum(value) AS volume, count(*) AS ticks FROM events GROUP BY 1, 2"""


DAY_BARS_SQL = """SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
 arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, sum(o_totalprice) AS volume, count(*) AS ticks
 FROM orders GROUP BY 1, 2"""


def sql_span(source: str, step: int = 3600) -> str:
    return f"""SELECT series, unnest(generate_series(lo, hi, INTERVAL '{step} seconds')) AS ts
 FROM (SELECT series, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY series)"""


def sql_grid(source: str, step: int = 3600) -> str:
    return f"SELECT s.series, s.ts, b.* EXCLUDE (series, ts) FROM ({sql_span(source, step)}) s LEFT JOIN {source} b ON b.series = s.series AND b.ts = s.ts"


DENSE_COLS = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}"
    for c in ("open", "high", "low", "price")
)

# CTE chains. Every query text starts from one of these.
BARS = f"WITH bars AS ({sql_bars()})"
HALF = f"WITH half AS ({sql_bars(step=1800)})"
GRID_ = f"{BARS}, grid AS ({sql_grid('bars')})"
DENSE = f"{GRID_}, dense AS (SELECT series, ts, {DENSE_COLS}, coalesce(volume, 0) AS volume, coalesce(ticks, 0) AS ticks FROM grid)"
USER = f"WITH ubars AS ({sql_bars('user_id', 21600)})"
USER_DENSE = (
    f"{USER}, ugrid AS ({sql_grid('ubars', 21600)}), "
    f"udense AS (SELECT series, ts, {DENSE_COLS}, coalesce(volume, 0) AS volume, coalesce(ticks, 0) AS ticks FROM ugrid)"
)
RET = (
    f"{DENSE}, r1 AS (SELECT *, price / lag(price) OVER w - 1 AS \"return\" FROM dense WINDOW w AS (PARTITION BY series ORDER BY ts)), "
    "r2 AS (SELECT *, \"return\" - lag(\"return\") OVER w AS acceleration FROM r1 WINDOW w AS (PARTITION BY series ORDER BY ts)), "
    "rets AS (SELECT *, acceleration - lag(acceleration) OVER w AS jerk FROM r2 WINDOW w AS (PARTITION BY series ORDER BY ts))"
)
DAYS = f"WITH days AS ({DAY_BARS_SQL})"
W = "PARTITION BY series ORDER BY ts"
