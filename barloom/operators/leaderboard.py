"""Ranking and promotion of models. A registry is a short table: one row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def rank_models(models: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Best metric first, null counts as 0, ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(metric, F.lit(0.0)).desc(), "model_id")
    return models.withColumn("rank", F.row_number().over(w))


def dedup_models(models: DataFrame, same: Sequence[str], metric: str) -> DataFrame:
    """Of models with the same settings, or the same id, only the best stays."""
    w = lambda *cols: Window.partitionBy(*cols).orderBy(F.coalesce(metric, F.lit(0.0)).desc(), "model_id")
    settings = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same])
    one = models.withColumn("_s", settings).withColumn("_r", F.row_number().over(w("_s", *same))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(w("model_id"))).where("_r = 1").drop("_s", "_r")


def promote(models: DataFrame, keys: Sequence[str], candidates: int, keep: int = 5, update_champion: bool = True) -> DataFrame:
    """New ``stage`` per model.

    Input: ``model_id, stage, checks_pass, val_metric, opt_metric, opt_monthly_ret, val_tuning``. All but the
    champion (``production``) compete: the best ``candidates`` by validation metric that pass their checks
    become ``staging``; the best of these by optimized metric replaces the champion when its metric is
    greater and its monthly return more than 1.05 times the champion's (or when there is none); of the
    rest the best ``keep`` with a positive tuning metric stay in ``development``.
    """
    w = lambda metric: Window.partitionBy(*keys).orderBy(F.coalesce(metric, F.lit(0.0)).desc(), "model_id")
    champion = models.where("stage = 'production'")
    others = models.where("stage <> 'production'").withColumn("_rv", F.row_number().over(w("val_metric")))
    staged = others.withColumn("_staged", (F.col("_rv") <= candidates) & F.col("checks_pass"))
    challenger = staged.where("_staged").withColumn("_ro", F.row_number().over(w("opt_metric"))).where("_ro = 1")
    duel = challenger.select(*keys, F.col("model_id").alias("_new"), F.col("opt_metric").alias("_nm"), F.col("opt_monthly_ret").alias("_nr")).join(
        champion.select(*keys, F.col("model_id").alias("_old"), F.col("opt_metric").alias("_om"), F.col("opt_monthly_ret").alias("_or")), list(keys), "full_outer")
    better = F.col("_old").isNull() | (F.lit(update_champion) & (F.col("_nm") > F.col("_om")) & (F.col("_nr") > 1.05 * F.col("_or")))
    winner = duel.select(*keys, F.when(F.coalesce(better, F.lit(False)) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias("_winner"))
    rest = staged.where("not _staged").withColumn("_rd", F.row_number().over(w("val_metric")))
    marked = staged.select(*models.columns, "_staged").join(rest.select(*keys, "model_id", "_rd"), [*keys, "model_id"], "left")
    everyone = marked.unionByName(champion.withColumns({"_staged": F.lit(True), "_rd": F.lit(None).cast("int")}))
    new = (
        F.when(F.col("model_id") == F.col("_winner"), "production").when(F.col("_staged"), "staging")
        .when((F.col("_rd") <= keep) & (F.col("val_tuning") > 0), "development").otherwise("dropped")
    )
    return everyone.join(winner, list(keys), "left").withColumn("new_stage", new).drop("_staged", "_rd", "_winner")


def admit(models: DataFrame, candidates: DataFrame, keys: Sequence[str], metric: str, size: int) -> DataFrame:
    """Candidates with a positive metric join the list while it has room or beat its last entry."""
    pool = models.withColumn("_old", F.lit(1)).unionByName(candidates.where(F.col(metric) > 0).withColumn("_old", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.coalesce(metric, F.lit(0.0)).desc(), F.col("_old").desc(), "model_id")
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("_old")
