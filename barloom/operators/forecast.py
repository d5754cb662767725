"""Forecasts on a panel and what is done to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.blocks import Grid, bounded
from barloom.operators.project import clip_to_seen
from barloom.operators.sets import batches
from barloom.operators.trees import fit_trees, tree_forecast
from barloom.operators.windows import cumulative_share
from barloom.session import join_staged, stage


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector ``_x`` of every row; a null or NaN counts as 0, so no row is left out of a fit or of its forecasts."""
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    return df.withColumn("_x", array_to_vector(F.array(*values)))


def repeatable(df: DataFrame, *cols: str) -> DataFrame:
    """Same rows in the same partitions in the same order on every run, so that seeded bagging repeats.

    Spread by hash of the row key; no key value gathers rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *cols).sortWithinPartitions(*cols)


def tree_model(algorithm: str, target: str, seed: int = 7, trees: int = 20, depth: int = 5):
    if algorithm == "random_forest":
        return RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="forecast", numTrees=trees, maxDepth=depth, seed=seed)
    if algorithm == "boosted_trees":
        return GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="forecast", maxIter=trees, maxDepth=depth, seed=seed)
    raise ValueError(f"unknown algorithm {algorithm}")


def fit_panel(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, algorithm: str = "random_forest", **options):
    """One model on the whole panel; the same rows give the same model."""
    known = repeatable(train.where(F.col(target).isNotNull()), *keys)
    return tree_model(algorithm, target, **options).fit(assemble(known, features))


def fit_predict(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, algorithm: str = "random_forest",
                keys: Sequence[str] = ("series", "ts"), **options):
    """Fitted panel model and ``rows`` with ``forecast``."""
    model = fit_panel(train, keys, features, target, algorithm, **options)
    return model, model.transform(assemble(rows, features)).drop("_x")


def walk_forward(df: DataFrame, g: Grid, features: Sequence[str], target: str, start: Column, steps: int, refit_every: int,
                 algorithm: str = "random_forest", by: Sequence[str] = (), **options) -> DataFrame:
    """Forecast batches of ``steps`` bars; the history grows with the actual values and the model is refitted when ``refit_every`` bars passed.

    Every bar has the number of the newest model that is older than it, and of the first model that has seen it. All models are fitted together, each on
    the bars up to its time (a bar is handed to every later model: refits are few), and every bar is scored once, by the model of its number.
    ``by``: a model per value of these keys and refit, else one for the whole panel.
    """
    future = stage(batches(df.where(start), g, steps))
    per = max(1, -(-refit_every // steps))  # batches that one model serves
    model = F.floor(F.col("batch") / per).cast("int")
    last = future.agg(F.max(model)).first()[0]
    if last is None:  # no row passes ``start``
        return future.select(*g.keys, g.ts, "batch", target, F.lit(None).cast("double").alias("forecast"))
    numbered = Grid(keys=(*g.keys, "_model"), ts=g.ts, step=g.step, block=g.block, dense=g.dense, ties=g.ties)
    needed = [*g.keys, g.ts, target, *features]
    seen = df.where(~start).select(*needed, F.lit(0).alias("_first")).unionByName(future.select(*needed, (model + 1).alias("_first")))
    train = seen.where(F.col("_first") <= last).withColumn("_model", F.explode(F.sequence(F.col("_first"), F.lit(last)))).drop("_first")
    fitted = fit_trees(train, numbered, features, target, (*by, "_model"), algorithm, **options)
    rows = future.select(*dict.fromkeys([*needed, "batch"]), model.alias("_model"))
    return tree_forecast(fitted, rows, numbered).select(*g.keys, g.ts, "batch", target, "forecast")


def target_inversion(df: DataFrame, g: Grid, method: str) -> DataFrame:
    """Return forecast from a forecast of ``return``, ``acceleration``, ``jerk`` or ``price``."""
    f = F.col("forecast")

    def exprs(w) -> dict[str, Column]:
        r, a = F.lag("return").over(w), F.lag("acceleration").over(w)
        before = F.lag("forecast").over(w)
        return {"return_forecast": {
            "return": lambda: f, "acceleration": lambda: f + r, "jerk": lambda: f + r + a,
            "price": lambda: F.try_divide(f - before, before)}[method]()}
    return bounded(df, g, exprs, back=1)


def adjust(df: DataFrame, train: DataFrame, keys: Sequence[str], seen: str, bias: float = 0.0, reverse: bool = False) -> DataFrame:
    """Scale to the size of the target, add a bias, turn the sign, clip to the returns seen in training.

    ``train`` holds the actual (``seen``) and the fitted ``forecast`` of the training rows.
    """
    m = train.groupBy(*keys).agg(F.try_divide(F.avg(F.abs(seen)), F.avg(F.abs("forecast"))).alias("_scale"))
    value = (F.col("return_forecast") * F.col("_scale") + bias) * (-1 if reverse else 1)
    scaled = join_staged(df, m, keys).withColumn("return_forecast", value).select(*df.columns)
    return clip_to_seen(scaled, train, keys, "return_forecast", seen)


def best_series(performance: DataFrame, model: str, series: str, metric: str) -> DataFrame:
    """The series on which each model has the greatest metric, then the greatest average return; values equal to 12 decimals are ties, told apart by name."""
    w = Window.partitionBy(model).orderBy(F.round(metric, 12).desc_nulls_last(), F.round("avg_real_trading_return", 12).desc_nulls_last(), series)
    return performance.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def feature_importance(model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Tree importances, largest first, with their running share."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    out = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return cumulative_share(out.withColumn("_one", F.lit(1)), ["_one"], "feature", "importance").drop("_one")
