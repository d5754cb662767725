"""Structured Streaming forms of the incremental jobs.

Each job is a streaming query with a checkpoint, run with ``availableNow``: a scheduled run takes what
arrived since the last one and stops. State, offsets and watermarks live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barloom.operators.backtest import position_flow, take_profit_stop_loss, trading_signal, with_rules
from barloom.operators.blocks import Grid, bounded, ema
from barloom.operators.models import Versions, next_bars, scored_bars
from barloom.operators.sets import overlap_merge, tail_rows
from barloom.operators.windows import ha_price
from barloom.session import fresh_path, stage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Folder of Parquet files as a stream; ``max_files`` bounds a micro-batch after a long pause."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def run_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived and append results to a table. State is kept in RocksDB for this run; the setting of the session is put back."""
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting, None)
    conf.set(setting, ROCKSDB)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start(out).awaitTermination()
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, one call of ``handle`` per micro-batch."""
    stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def event_time(ts: str = "ts") -> Column:
    """Event time for watermarks, which need a zoned timestamp."""
    return F.col(ts).cast("timestamp")


def tumbling_bars(ticks: DataFrame, step: int, late: str) -> DataFrame:
    """Bars that can no longer change: closed once the watermark has passed their end."""
    order = F.struct("ts", "event_id")
    bars = ticks.withColumn("_t", event_time()).withWatermark("_t", late).groupBy("series", F.window("_t", f"{step} seconds").alias("_w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("price"), F.sum("value").alias("volume"))
    return bars.select("series", F.col("_w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "price", "volume")


def dedup(rows: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """One row per key; keys are remembered for the watermark delay."""
    return rows.withColumn("_t", event_time()).withWatermark("_t", late).dropDuplicatesWithinWatermark(list(keys)).drop("_t")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a day-partitioned table, empty before the first write."""
    with_day = StructType([*schema.fields, StructField("day", StringType())])
    try:
        return spark.read.schema(with_day).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], with_day)


def _write_days(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def revise(path: str, g: Grid, revisable: int = 24) -> Callable[[DataFrame, int], None]:
    """Batch handler: merge bars into a day-partitioned table; the last ``revisable`` rows may change.

    Only days from the first one of the batch on are read and rewritten. Rows are counted from the end of
    a series, so leaving earlier days out does not change which rows are final. A repeated batch writes
    the same rows again.
    """
    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = stage(batch, "batch")
        first = new.agg(F.min(F.date_format(g.ts, "yyyy-MM-dd"))).first()[0]
        if first is None:
            return
        old = stored(spark, path, batch.schema).where(F.col("day") >= first).drop("day")
        _write_days(_day(stage(overlap_merge(stage(old), new, g, revisable))), path)
    return handle


def _merged_days(rows: DataFrame, old: DataFrame, g: Grid) -> DataFrame:
    """Rows with the stored ones of the same days, which an overwrite of these days would take away."""
    key = [*g.keys, g.ts]
    days = rows.select(F.date_format(g.ts, "yyyy-MM-dd").alias("day")).distinct()
    first = rows.agg(F.min(F.date_format(g.ts, "yyyy-MM-dd"))).first()[0]
    kept = old.where(F.col("day") >= first).join(days, "day", "left_semi").join(rows.select(*key), key, "left_anti")
    return stage(rows.unionByName(kept.drop("day")), "days")


def _needed_days(counts: DataFrame, new: DataFrame, g: Grid, overlap: int) -> DataFrame:
    """(keys, _from): the day from which a series of the batch has ``overlap`` stored bars beside those that the batch may replace."""
    batch = new.groupBy(*g.keys).agg(F.count(F.lit(1)).alias("_mine"))
    later = Window.partitionBy(*g.keys).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = counts.join(batch, list(g.keys)).withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return known.where(F.col("_later") < F.col("_mine") + overlap).groupBy(*g.keys).agg(F.min("day").alias("_from"))


def append_features(path: str, out: str, g: Grid, overlap: int, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch handler: store new bars and compute features for them only, with the last ``overlap`` stored
    bars of each series as history.

    A list of bars per series and day (``path`` + ``-days``) says how far back a batch has to read; older days are not touched. The list is written last: where a
    run broke off before it, it counts too few bars and the next batch reads more than it needs.
    """
    listed = path.rstrip("/") + "-days"

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = stage(batch, "batch").withColumn("_new", F.lit(True))
        if new.isEmpty():
            return
        key = [*g.keys, g.ts]
        count_schema = StructType([*[new.schema[k] for k in g.keys], StructField("n", LongType())])
        needed = stage(_needed_days(stored(spark, listed, count_schema), new, g, overlap), "needed")
        first = needed.agg(F.min("_from")).first()[0]
        history = stored(spark, path, batch.schema)
        near = history.where(F.col("day") >= first) if first is not None else history.limit(0)
        rest = near.join(needed, list(g.keys)).where("day >= _from").drop("day", "_from").join(new.select(*key), key, "left_anti")
        both = stage(tail_rows(rest, g, overlap).withColumn("_new", F.lit(False)).unionByName(new))
        made = stage(build(both).where("_new").drop("_new"), "features")
        # features first: a batch that is repeated after a failure between the writes finds the store as it was
        _write_days(_day(_merged_days(made, stored(spark, out, made.schema), g)), out)
        days = _merged_days(new.drop("_new"), history, g)
        _write_days(_day(days), path)
        _write_days(_day(days).groupBy(*g.keys, "day").agg(F.count(F.lit(1)).alias("n")), listed)
    return handle


def _newest(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame:
    """Rows that the last batch before ``batch_id`` left in ``path``, empty before the first."""
    with_batch = StructType([*schema.fields, StructField("after", LongType())])
    try:
        kept = spark.read.schema(with_batch).parquet(path).where(F.col("after") < batch_id)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    last = kept.agg(F.max("after")).first()[0]
    return kept.where(F.col("after") == (last if last is not None else -1)).drop("after")


def _leave(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("after", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("after").parquet(path)


def carry_on(
    folder: str, out: str, g: Grid, late: int, step: Callable[[DataFrame], DataFrame], state: str, seed: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame, int], None]:
    """Batch handler for operators that carry a state from bar to bar, in event time and with late bars.

    The operator itself is the batch one: its carries are associative, so it can go on from any bar. ``step`` computes its columns for
    rows and ``seed(last)``, one row per series that stands for all bars so far (made of the columns of ``state``, a schema, at the last final bar). Bars of the last ``late`` seconds of a series
    stay open: they are kept and computed again with what arrives between them, and their results are written again. Bars older than that are put
    aside in ``folder``/late. A series is spread over blocks like in a batch run; nothing runs row by row.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key, keys = [*g.keys, g.ts], list(g.keys)
        new = stage(batch.dropDuplicates(key), "batch")
        if new.isEmpty():
            return
        kept = StructType.fromDDL(state)
        last = stage(_newest(spark, f"{folder}/state", StructType([*[new.schema[k] for k in key], *kept.fields]), batch_id), "last")
        seen = stage(new.join(last.select(*keys, F.col(g.ts).alias("_last")), keys, "left"), "seen")
        fresh = seen.where(F.col("_last").isNull() | (F.col(g.ts) > F.col("_last"))).drop("_last")
        passed = seen.where(F.col(g.ts) <= F.col("_last")).drop("_last")
        open_rows = _newest(spark, f"{folder}/open", new.schema, batch_id)
        rows = stage(open_rows.join(fresh.select(*key), key, "left_anti").unionByName(fresh).withColumn("_seed", F.lit(False)), "rows")
        moving = last.join(rows.select(*keys).distinct(), keys, "left_semi")
        begun = stage(rows.unionByName(seed(moving).withColumn("_seed", F.lit(True)), allowMissingColumns=True), "begun")
        done = stage(step(begun).where("not _seed").drop("_seed"), "done")
        limit = rows.groupBy(*keys).agg((F.max(F.col(g.ts).cast("timestamp").cast("long")) - late).alias("_limit"))
        bounded_rows = stage(done.join(stage(limit, "limit"), keys), "bounded")
        final = F.col(g.ts).cast("timestamp").cast("long") <= F.col("_limit")
        settled = bounded_rows.where(final).groupBy(*keys).agg(F.max_by(F.struct(g.ts, *kept.names), F.col(g.ts)).alias("_s")).select(*keys, "_s.*")
        settled = stage(settled, "settled")
        settled = settled.unionByName(last.join(settled.select(*keys), keys, "left_anti"))
        made = done.select(*[c for c in done.columns if c not in new.columns or c in key])
        if made.isEmpty():  # late bars only
            made = None
        if made is not None:
            _write_days(_day(_merged_days(made, stored(spark, out, made.schema), g)), out)
        if not passed.isEmpty():
            _leave(passed, f"{folder}/late", batch_id)
        _leave(rows.drop("_seed").join(bounded_rows.where(~final).select(*key), key, "left_semi"), f"{folder}/open", batch_id)
        _leave(settled, f"{folder}/state", batch_id)
    return handle


def ema_step(g: Grid, alpha: float) -> tuple:
    """Exponential average ``ema`` of the price and Heikin-Ashi open ``ha_open`` for ``carry_on``: step, state, seed.

    An average that starts at its last value goes on as if it had never stopped, so a seed is a bar whose price is the average and whose
    Heikin-Ashi open and price are those of the last final bar.
    """
    def step(rows: DataFrame) -> DataFrame:
        given = {c: F.col(c) if c in rows.columns else F.lit(None).cast("double") for c in ("_ha", "_open")}
        priced = rows.withColumns(given).withColumn("ha_price", F.coalesce("_ha", ha_price()))
        fed = bounded(priced, g, lambda w: {"_in": F.coalesce("_open", F.lag("ha_price").over(w), (F.col("open") + F.col("price")) / 2)}, back=1)
        return ema(stage(fed, "fed"), g, {"ema": (F.col("price"), alpha), "ha_open": (F.col("_in"), 0.5)}).drop("_in", "_ha", "_open")

    def seed(last: DataFrame) -> DataFrame:
        return last.select(*g.keys, g.ts, F.col("ema").alias("price"), F.col("ha_price").alias("_ha"), F.col("ha_open").alias("_open"))

    return step, "ema double, ha_open double, ha_price double", seed


def position_step(g: Grid, rules: dict) -> tuple:
    """Flow and trading signal of a position that follows the flow, for ``carry_on``.

    A position depends on the last certain bar and the last stop after it. A seed is a bar of the kind of the last flow: certain when the position was
    on, past its stop when it had been stopped.
    """
    high, low = F.col("open") * (1 + abs(rules["ltp"]) + abs(rules["ssl"]) + 1), F.col("open") * 0

    def step(rows: DataFrame) -> DataFrame:
        ruled = with_rules(rows, [{**rules, "follow_flow": True}])
        signals = trading_signal(stage(take_profit_stop_loss(position_flow(ruled, g)), "signals"), g)
        stopped = F.col("tp_triggered") | F.col("sl_triggered")
        return signals.withColumn("stopped", stopped).drop("param", "pid", "tp_price", "sl_price", "tp_triggered", "sl_triggered", "passive_trading")

    def seed(last: DataFrame) -> DataFrame:
        sure = F.when(F.col("trading_signal"), 2.0).otherwise(-1.0).alias("certainty")
        one = last.select(*g.keys, g.ts, F.col("flow").alias("kind"), sure, F.lit(1.0).alias("open"), "stopped")
        return one.withColumns({"high": F.when(F.col("stopped"), high).otherwise(F.lit(None)), "low": F.when(F.col("stopped"), low).otherwise(F.lit(None))}).drop("stopped")

    return step, "flow string, trading_signal boolean, stopped boolean", seed


def store_snapshot(path: str, g: Grid, rows: int = 150) -> Callable[[DataFrame, int], None]:
    """Batch handler: keep the last ``rows`` bars of each series of the batch as a snapshot partition."""
    def handle(batch: DataFrame, _: int) -> None:
        new = stage(batch, "batch")
        last = new.agg(F.date_format(F.max(g.ts), "yyyyMMddHHmmss")).first()[0]
        if last is not None:
            tail_rows(new, g, rows).withColumn("snapshot", F.lit(last)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)
    return handle


def live_snapshots(spark: SparkSession, path: str, schema: StructType, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots; older partitions are not read."""
    df = spark.read.schema(StructType([*schema.fields, StructField("snapshot", StringType())])).parquet(path)
    newest = [r.snapshot for r in df.select("snapshot").distinct().orderBy(F.col("snapshot").desc()).limit(keep).collect()]
    return df.where(F.col("snapshot").isin(newest))


def last_seen(ticks: DataFrame) -> DataFrame:
    """Newest time per series, kept up to date."""
    return ticks.groupBy("series").agg(F.max("ts").alias("last_ts"))


class EmaState(StatefulProcessor):
    """Exponential average and Heikin-Ashi open carried from batch to batch; one value set per series."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ema double, ha_open double, ha_price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts")
        known = self.last.get()
        ema, ha_open, ha_price = known if known is not None else (None, None, None)
        out = []
        for o, h, l, p in frame[["open", "high", "low", "price"]].itertuples(index=False):
            ha_open = (o + p) / 2 if ha_open is None else (ha_open + ha_price) / 2
            ema = p if ema is None else (1 - self.alpha) * ema + self.alpha * p
            ha_price = (o + h + l + p) / 4
            out.append((ema, ha_open))
        self.last.update((ema, ha_open, ha_price))
        yield pd.DataFrame({"series": key[0], "ts": frame["ts"].values, "ema": [e for e, _ in out], "ha_open": [a for _, a in out]})

    def close(self) -> None:
        pass


class PositionState(StatefulProcessor):
    """Flow and signal of the position carried from batch to batch, following the flow."""

    def __init__(self, threshold: float, ltp: float, stp: float, lsl: float, ssl: float):
        self.rules = (threshold, ltp, stp, lsl, ssl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "flow string, active boolean, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        threshold, ltp, stp, lsl, ssl = self.rules
        frame = pd.concat(list(rows)).sort_values("ts")
        known = self.last.get()
        flow, active, stopped = known if known is not None else (None, False, False)
        out = []
        for certainty, kind, o, h, l in frame[["certainty", "kind", "open", "high", "low"]].itertuples(index=False):
            sure = certainty > threshold
            flow = kind if flow is None or sure else flow
            active = bool(sure or (active and not stopped))
            long = flow == "long"
            stopped = bool((h > o * (1 + ltp) or l < o * (1 + lsl)) if long else (l < o * (1 + stp) or h > o * (1 + ssl)))
            out.append((flow, active))
        self.last.update((flow, active, stopped))
        yield pd.DataFrame({"series": key[0], "ts": frame["ts"].values, "flow": [f for f, _ in out], "trading_signal": [a for _, a in out]})

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Keyed state per series, for rows that come in order; ``run_append`` keeps it in RocksDB, so state size is not bound by executor memory."""
    return rows.groupBy("series").transformWithStateInPandas(processor, schema, "Append", "None")


def replay(spark: SparkSession, chunks: Sequence[DataFrame], run: Callable[[DataFrame, str], None], partitions: int | None = None) -> None:
    """Feed chunks one after the other, with one scheduled run after each, as an incremental job sees them.

    ``partitions`` sets the number of state partitions, which a stateful query keeps for its lifetime.
    """
    inbox, checkpoint = fresh_path(spark, "inbox"), fresh_path(spark, "checkpoint")
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        if partitions:
            spark.conf.set(setting, str(partitions))
        for chunk in chunks:
            chunk.write.mode("append").parquet(inbox)
            run(source(spark, inbox, chunk.schema), checkpoint)
    finally:
        spark.conf.set(setting, before)


def score_newest(
    versions: Versions, tails: str, out: str, g: Grid, cols: Sequence[str], back: int, build: Callable[[DataFrame], DataFrame], features: Sequence[str], rules: dict,
) -> Callable[[DataFrame, int], None]:
    """Batch handler: score the bar after the newest one of each series that moved on, with the newest stored model.

    The last ``back`` bars of each series are kept per batch under ``tails`` as history for the look-backs of ``build``, so a batch of one bar has
    its features and no older bar is read. A late bar joins the history and is not scored; a repeated batch writes the same rows again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = [*g.keys, g.ts]
        new = stage(batch.select(*key, *cols).dropDuplicates(key), "batch")
        if new.isEmpty():
            return
        schema = StructType([*new.schema.fields, StructField("after", LongType())])
        try:
            kept = spark.read.schema(schema).parquet(tails).where(F.col("after") < batch_id)
        except AnalysisException:
            kept = spark.createDataFrame([], schema)
        newest = kept.agg(F.max("after")).first()[0]
        old = kept.where(F.col("after") == newest).drop("after") if newest is not None else kept.drop("after")
        both = stage(old.join(new.select(*key), key, "left_anti").unionByName(new), "history")
        seen = old.groupBy(*g.keys).agg(F.max(g.ts).alias("_seen"))
        moved = new.groupBy(*g.keys).agg(F.max(g.ts).alias("_new")).join(seen, list(g.keys), "left").where("_seen is null or _new > _seen").select(*g.keys)
        version, state = versions.get()
        rows = next_bars(both.join(stage(moved, "moved"), list(g.keys), "left_semi"), g, build, cols)
        scored = scored_bars(rows, state, list(g.keys), features, rules)
        names = [*key, "return_forecast", "certainty", "kind", "leverage", "exposure", "tp_price", "sl_price"]
        scored.select(*names, F.lit(version).cast("long").alias("version"), F.lit(batch_id).alias("batch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        tail_rows(both, g, back).withColumn("after", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("after").parquet(tails)
    return handle
