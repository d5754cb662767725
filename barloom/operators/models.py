"""Linear models of many series from one aggregation, stored with their transform in versions, and the bars that are scored with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.scalars import exposure
from barloom.operators import backtest as bt
from barloom.operators.blocks import Grid
from barloom.operators.windows import shift_with_forecast_row
from barloom.session import join_staged, stage


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key the sums of products of all column pairs and of the columns themselves (``1`` is the last one), as array ``s`` of a square matrix.

    A task adds up its batches per key and gives up one matrix for each; Spark adds those. Rows with a null, NaN or infinite value are left out.
    """
    k = len(cols) + 1
    x = [F.col(c).cast("double") for c in cols]
    rows = df.select(*keys, *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    for i in range(len(cols)):
        rows = rows.where((F.abs(f"_x{i}") < float("inf")))
    rows = rows.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))).select("_k", *[f"_x{i}" for i in range(len(cols))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.chunked_array([batch.column(0)]).combine_chunks()
            names = seen.to_pylist()
            number: dict[tuple, int] = {}
            at = np.array([number.setdefault(tuple(n.values()), len(number)) for n in names])
            m = np.column_stack([*[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], np.ones(len(at))])
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(number) + 1))
            mats = [m[order[a:b]].T @ m[order[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
            first = pa.array([int(order[a]) for a in edges[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.array([x.reshape(-1) for x in mats], pa.list_(pa.float64()))], ["_k", "_s"])

    schema = f"_k {rows.schema['_k'].dataType.simpleString()}, _s array<double>"
    cells = rows.mapInArrow(sums, schema).select("_k", F.posexplode("_s").alias("_i", "_v")).groupBy("_k", "_i").agg(F.sum("_v").alias("_v"))
    out = cells.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("s"))
    return out.where(F.size("s") == k * k).select(*([f"_k.{c}" for c in keys]), "s")


STATE = "n double, mean array<double>, scale array<double>, coef array<double>, intercept double"


def fit_linear(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, ridge: float = 0.0, least: int = 30) -> DataFrame:
    """One linear model per key: its transform (mean and deviation of each feature) and the coefficients of the transformed features.

    The rows are read once for all keys (twice with the means, which are taken off first); what a key leaves is a matrix of (features + 2) ** 2 sums, solved
    in a task. A feature that does not vary gets the coefficient 0; keys of fewer than ``least`` rows have no model.
    """
    cols = [*features, target]
    means = train.agg(*[F.avg(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))) for c in cols]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    moved = train.select(*keys, *[(F.col(c).cast("double") - float(m)).alias(c) for c, m in zip(cols, shift)])
    p = len(features)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(batch.schema.get_field_index("s")).to_pylist():
                m = np.array(s).reshape(p + 2, p + 2)
                n, total = m[-1, -1], m[:-1, -1]
                mean = total / n
                c = m[:-1, :-1] / n - np.outer(mean, mean)
                dev = np.sqrt(np.maximum(np.diag(c)[:p], 0.0))
                live = dev > 1e-12 * np.maximum(1.0, np.abs(mean[:p] + shift[:p]))
                scale = np.where(live, dev, 1.0)
                a = np.where(np.outer(live, live), c[:p, :p] / np.outer(scale, scale), np.eye(p)) + ridge * np.eye(p)
                coef = np.linalg.lstsq(a, np.where(live, c[:p, p] / scale, 0.0), rcond=1e-12)[0]
                out.append((n, mean[:p] + shift[:p], scale, coef, mean[p] + shift[p]) if n >= least else (n, None, None, None, None))
            fields = [pa.array([o[i] for o in out], pa.float64() if i in (0, 4) else pa.list_(pa.float64())) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keys], *fields], [*keys, "n", "mean", "scale", "coef", "intercept"])

    sums = gram(moved, keys, cols)
    types = "".join(f"`{c}` {sums.schema[c].dataType.simpleString()}, " for c in keys)
    return sums.mapInArrow(solve, types + STATE).where("coef is not null").withColumn("features", F.array(*[F.lit(f) for f in features]))


def linear_forecast(features: Sequence[str]) -> Column:
    """The forecast of a row that has met its model; a feature that is null or not finite stands at its mean."""
    out = F.col("intercept")
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        z = (x - F.col("mean")[i]) / F.col("scale")[i]
        out = out + F.col("coef")[i] * F.when(F.abs(x) < float("inf"), z).otherwise(0.0)
    return out


def apply_linear(rows: DataFrame, state: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "return_forecast") -> DataFrame:
    """Rows with their forecast; keys without a model have none."""
    if not keys:  # one model for all rows
        one = F.lit(1).alias("_one")
        return apply_linear(rows.select("*", one), state.select("*", one), ["_one"], features, name).drop("_one")
    both = join_staged(rows, state.select(*keys, "mean", "scale", "coef", "intercept"), keys, "left")
    return both.withColumn(name, linear_forecast(features)).drop("mean", "scale", "coef", "intercept")


def fit_state(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """What a scoring job needs per key: transform, model, and the normal fit (``loc``, ``spread``) of its residuals on the training rows."""
    model = stage(fit_linear(train, keys, features, target, ridge), "model")
    fitted = apply_linear(train.withColumn("real_return", F.col(target)), model, keys, features)
    fit = bt.fit_normal(bt.residuals(fitted), keys).select(*keys, "loc", F.col("scale").alias("spread"))
    return model.join(stage(fit, "fit"), list(keys), "left")


class Versions:
    """Versions of a state table in a folder. A version counts once its line in the list is written, after its rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def listed(self) -> DataFrame:
        try:
            return self.spark.read.schema("version long, stored_at timestamp, note string").parquet(f"{self.path}/list")
        except AnalysisException:
            return self.spark.createDataFrame([], "version long, stored_at timestamp, note string")

    def latest(self) -> int | None:
        return self.listed().agg(F.max("version")).first()[0]

    def put(self, state: DataFrame, note: str = "") -> int:
        version = (self.latest() or 0) + 1
        state.write.mode("overwrite").parquet(f"{self.path}/version={version}")  # what a failed run left there is replaced
        line = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("stored_at"), F.lit(note).alias("note"))
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/list")
        return version

    def get(self, version: int | None = None) -> tuple[int, DataFrame]:
        """A version (the newest listed one) and its rows."""
        version = version if version is not None else self.latest()
        if version is None:
            raise LookupError(f"no version in {self.path}")
        return version, self.spark.read.parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version).cast("long"))


def next_bars(bars: DataFrame, g: Grid, build, cols: Sequence[str]) -> DataFrame:
    """The bar after the last one of each series: features of ``build`` on the moved columns, and the last price as its open."""
    moved = stage(shift_with_forecast_row(bars.select(*g.keys, g.ts, *cols), g, list(cols)), "moved")
    last = bars.groupBy(*g.keys).agg(F.max(g.ts).alias("_last"), F.max_by("price", F.col(g.ts)).alias("_open"))
    return join_staged(build(moved), last, g.keys).where(F.col(g.ts) > F.col("_last")).withColumn("open", F.col("_open")).drop("_last", "_open")


def scored_bars(rows: DataFrame, state: DataFrame, keys: Sequence[str], features: Sequence[str], rules: dict) -> DataFrame:
    """Forecast, side, certainty, leverage, exposure and exit prices of bars that have not begun (their open is known, high and low are not)."""
    known = apply_linear(rows, state, keys, features)
    fit = state.select(*keys, "loc", F.col("spread").alias("scale"))
    unseen = known.withColumns({"high": F.lit(None).cast("double"), "low": F.lit(None).cast("double")})
    ruled = bt.with_rules(bt.certainty(unseen, fit, keys), [rules]).withColumn("flow", F.col("kind"))
    out = bt.take_profit_stop_loss(ruled)
    active = F.col("certainty") > F.col("param.certainty_threshold")
    return out.withColumns({
        "leverage": F.when(F.col("certainty") > 0.9, F.col("param.max_leverage")).otherwise(1.0), "exposure": exposure(F.col("certainty"), active)})
