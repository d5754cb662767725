"""Tables at rest: partitioned Parquet, snapshots, JSON rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from barloom.functions.scalars import partition_keys
from barloom.operators.sets import dedup

_MONTHS = {"year_month": 1, "year_bimester": 2, "year_quarter": 3}


def recent_partitions(column: str, today: dt.date) -> list[str]:
    """Smallest list of partition values that covers about a month and a half before ``today``."""
    size = _MONTHS[column]
    per_year = 12 // size
    now = today.year * per_year + (today.month - 1) // size
    into = (today.month - 1) % size  # months of the current partition already passed
    wanted = [now]
    if size == 1:
        wanted += [now - 1] + ([now - 2] if today.day < 14 else [])
    elif into == 0 or (into == 1 and today.day < 14):
        wanted.append(now - 1)
    return [f"{p // per_year}_{p % per_year + 1}" for p in wanted]


def read_recent(spark: SparkSession, path: str, column: str | None, today: dt.date | None,
                filters: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """Read a partitioned table; only the recent partitions and rows that pass ``(column, op, values)``.

    Both kinds of condition reach the scan: the first prunes folders, the second is pushed into Parquet.
    """
    df = spark.read.parquet(path)
    if column and today:
        df = df.where(F.col(column).isin(recent_partitions(column, today)))
    for name, op, value in filters:
        c = F.col(name)
        df = df.where({
            "in": lambda: c.isin(list(value)), "not in": lambda: ~c.isin(list(value)), "=": lambda: c == value,
            "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value,
            "<": lambda: c < value, "<=": lambda: c <= value}[op]())
    return df


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, partition_cols: Sequence[str] = (), ts: str = "ts",
                min_days: int = 40, check: bool = True) -> DataFrame:
    """One row per key, the last loaded one; partition columns are dropped.

    With ``check`` an empty table or one that spans less than ``min_days`` is an error.
    """
    if check:
        span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if span.lo is None or (span.hi - span.lo).days < min_days:
            raise ValueError(f"table is empty or spans less than {min_days} days")
    return dedup(df.drop(*partition_cols), keys, F.col(order), "last")


def write_partitioned(df: DataFrame, path: str, column: str = "year_month", ts: str = "ts", mode: str = "append") -> None:
    """Snappy Parquet partitioned by ``year_month``, ``year_bimester`` or ``year_quarter``.

    ``append`` adds files, ``overwrite`` replaces the table, ``partitions`` replaces only the
    partitions present in ``df``.
    """
    keyed = df.withColumn(column, partition_keys(ts)[column])
    writer = keyed.write.option("compression", "snappy").partitionBy(column)
    if mode == "partitions":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rules and thresholds as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def gated_write(df: DataFrame, report: DataFrame, path: str, least_rows: int) -> bool:
    """Write only if the table is long enough and no check failed; returns whether it was written."""
    failed = report.where("failed").limit(1).count()
    if failed or df.count() < least_rows:
        return False
    write_partitioned(df, path, mode="overwrite")
    return True


def backup(df: DataFrame, path: str, last_backup: dt.datetime | None, checks_pass: bool, ts: str = "ts", hours: int = 48) -> dt.datetime | None:
    """Write a snapshot partition if ``hours`` passed since the last one and the checks pass.

    Returns the time of the newest snapshot.
    """
    newest = df.agg(F.max(ts)).first()[0]
    if not checks_pass or (last_backup is not None and (newest - last_backup).total_seconds() <= hours * 3600):
        return last_backup
    df.withColumn("snapshot", F.lit(newest.strftime("%Y%m%d%H%M%S"))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)
    return newest


def restore(df: DataFrame, path: str, last_backup: dt.datetime | None, ts: str = "ts", days: int = 3) -> DataFrame:
    """The snapshot if it is younger than ``days``, else the table itself."""
    newest = df.agg(F.max(ts)).first()[0]
    if last_backup is None or (newest - last_backup).total_seconds() >= days * 86400:
        return df
    stored = df.sparkSession.read.option("recursiveFileLookup", "false").parquet(path)
    return stored.where(F.col("snapshot").cast("string") == last_backup.strftime("%Y%m%d%H%M%S")).drop("snapshot")


def series_shapes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and columns per series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns) - len(keys)))
