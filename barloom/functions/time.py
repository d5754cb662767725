"""Time-axis expressions on zone-less timestamps; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970-01-01 of a ``timestamp_ntz`` column."""
    return F.expr(f"cast(cast({ts} - {EPOCH} as interval second) as bigint)")


def epoch_micros(ts: str) -> Column:
    return F.expr(f"cast(cast({ts} - {EPOCH} as interval second) as decimal(18,6)) * 1000000").cast("bigint")


def from_epoch(seconds: Column) -> Column:
    """``timestamp_ntz`` from epoch seconds."""
    return F.expr(EPOCH) + F.expr("interval '1' second") * seconds


def bucket_start(ts: str, step: int) -> Column:
    """Start of the tumbling bucket of ``step`` seconds that holds ``ts``."""
    return from_epoch(F.floor(epoch_seconds(ts) / F.lit(step)) * step)


def epoch_millis_to_ts(ms: Column) -> Column:
    return F.expr(EPOCH) + F.expr("interval '1' second") * (ms / F.lit(1000))


def month_start(ts: str) -> Column:
    return F.expr(f"cast(trunc({ts}, 'MM') as timestamp_ntz)")


def tie_order(ts: str, tie: str) -> Column:
    """One sortable number from time and tie breaker.

    A decimal keeps ``min_by``/``max_by`` on hash aggregation; ordering by a struct would make Spark
    sort all input rows.
    """
    return epoch_micros(ts).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(tie)
