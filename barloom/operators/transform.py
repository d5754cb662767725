"""Feature transforms: splits, encoding, scaling, truncation, components, seasonality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalars import finite
from barloom.operators.aggregate import band_thresholds
from barloom.operators.blocks import Grid, bounded, row_numbers
from barloom.operators.project import soft_clip_to
from barloom.session import join_staged, stage


def time_split(df: DataFrame, g: Grid, test_share: float = 0.15, val_share: float = 0.25) -> DataFrame:
    """Label rows of each series by time: the last share is ``test``, the last share of the rest ``val``."""
    numbered = row_numbers(df, g, "_rn", "_n")
    test = F.floor(F.col("_n") * test_share + 1e-9)
    val = F.floor((F.col("_n") - test) * val_share + 1e-9)
    part = F.when(F.col("_rn") > F.col("_n") - test, "test").when(F.col("_rn") > F.col("_n") - test - val, "val").otherwise("train")
    return numbered.withColumn("split", part).drop("_rn", "_n")


def train_flag(df: DataFrame, g: Grid, share: float = 0.85) -> DataFrame:
    """``_train`` marks the first ``share`` of the rows of each series."""
    return row_numbers(df, g, "_rn", "_n").withColumn("_train", F.col("_rn") <= F.floor(F.col("_n") * share + 1e-9)).drop("_rn", "_n")


def categories(df: DataFrame, cols: Sequence[str], most: int = 10_000) -> dict[str, list[str]]:
    """Known values of each categorical column. Each becomes a column, so more than ``most`` are refused before any comes to the driver."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("_x")).select("_x.*")
    out: dict[str, list[str]] = {c: [] for c in cols}
    found = stage(long.where("v is not null").distinct(), "categories")
    if (n := found.count()) > most:
        raise ValueError(f"{n} values in {list(cols)} are more than {most}: not categories")
    for r in found.orderBy("c", "v").collect():
        out[r.c].append(r.v)
    return out


def one_hot(df: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per known value; unknown values are 0 everywhere."""
    return df.withColumns({
        f"{c}_{v}": F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for c, vs in known.items() for v in vs}).drop(*known)


def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``<c>_mean`` and ``<c>_std`` (population) of the training rows, one row per key."""
    return df.where("_train").groupBy(*keys).agg(*[
        e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def bands(df: DataFrame, keys: Sequence[str], cols: Sequence[str], z: float = 1.96) -> DataFrame:
    """``<c>_low`` and ``<c>_high`` = mean -+ z sample deviations of the training rows, one row per key."""
    return band_thresholds(df.where("_train"), keys, cols, z)


def scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fitted: DataFrame) -> DataFrame:
    """(x - mean) / std of the key; infinities become 0, constant columns are only centred."""
    def value(c: str) -> Column:
        std = F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))
        return F.coalesce(finite(F.try_divide(F.col(c) - F.col(f"{c}_mean"), std)), F.lit(0.0))
    return join_staged(df, fitted, keys).withColumns({c: value(c) for c in cols}).select(*df.columns)


def truncate(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fitted: DataFrame, keep: float = 0.25) -> DataFrame:
    """Beyond the fitted band of the key a share of the excess is kept."""
    return soft_clip_to(df, fitted, keys, cols, keep)


def pca(df: DataFrame, cols: Sequence[str], explained: float = 0.95, most: int | None = None) -> DataFrame:
    """Components that explain the given share of variance, as ``pca_0``, ``pca_1``, ..."""
    data = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)
    full = PCA(k=len(cols), inputCol="_x", outputCol="_z").fit(data.where("_train") if "_train" in df.columns else data)
    total, k = 0.0, 0
    for v in full.explainedVariance.toArray():
        total, k = total + float(v), k + 1
        if total >= explained:
            break
    k = min(k, most) if most else k
    out = full.transform(data).withColumn("_a", vector_to_array("_z"))
    return out.select(*[c for c in df.columns if c not in cols], *[F.col("_a")[i].alias(f"pca_{i}") for i in range(k)])


def transform_panel(df: DataFrame, g: Grid, numbers: Sequence[str], classes: Sequence[str], components: bool = False, share: float = 0.85) -> DataFrame:
    """Encode, truncate, scale, truncate again and, on request, project; scales and bands are fitted on the training
    rows of each series, categories and components on those of the panel."""
    flagged = stage(train_flag(df.select(*g.keys, g.ts, *numbers, *classes), g, share))
    encoded = one_hot(flagged, categories(flagged.where("_train"), classes)) if classes else flagged
    first = stage(truncate(encoded, g.keys, numbers, bands(encoded, g.keys, numbers)))
    scaled = stage(scale(first, g.keys, numbers, moments(first, g.keys, numbers)))
    second = stage(truncate(scaled, g.keys, numbers, bands(scaled, g.keys, numbers)))
    dummies = [c for c in second.columns if c not in (*g.keys, g.ts, *numbers, "_train")]
    return (pca(second, [*numbers, *dummies]) if components else second).drop("_train")


def seasonal_means(df: DataFrame, g: Grid, col: str, period: int) -> DataFrame:
    """Additive seasonal component per phase: mean of the detrended series by row number modulo the period.

    The trend is a centred mean over one period (half weights at both ends of an even one).
    """
    half = period // 2

    def exprs(w) -> dict[str, Column]:
        wide = w.rowsBetween(-half, half)
        ends = (F.lag(col, half).over(w) + F.lead(col, half).over(w)) / 2 if period % 2 == 0 else F.lit(0.0)
        trend = (F.sum(col).over(wide) - ends) / period
        return {"_trend": F.when(F.count(col).over(wide) == 2 * half + 1, trend)}
    numbered = stage(row_numbers(df, g, "_rn", "_n").select(*g.keys, g.ts, col, "_rn", "_n"))
    smooth = bounded(numbered, g, exprs, back=half, ahead=half)
    phases = smooth.groupBy(*g.keys, ((F.col("_rn") - 1) % period).alias("phase")).agg(
        F.avg(F.col(col) - F.col("_trend")).alias("_s"), F.max("_n").alias("n"))
    return phases.select(*g.keys, "phase", "n", (F.col("_s") - F.avg("_s").over(Window.partitionBy(*g.keys))).alias("seasonal"))


def seasonal_period(df: DataFrame, g: Grid, col: str, period: int) -> DataFrame:
    """Strongest period of the seasonal component of each series: ``(keys, period, power)``.

    The component repeats, so each frequency is a sum over its phases times a geometric sum over the
    repeats: n/2 frequencies x ``period`` phases rows per series, not n x n/2.
    """
    phases = seasonal_means(df, g, col, period)
    waves = phases.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int") - 1)))
    angle = 2 * math.pi * F.col("k") / F.col("n")
    repeats = F.floor((F.col("n") - F.col("phase") - 1) / period) + 1
    step = angle * period
    # sum over m < repeats of exp(-i * step * m), as length and turn; step at a full turn means all add up
    near = F.abs(F.sin(step / 2)) < 1e-12
    size = F.when(near, repeats.cast("double")).otherwise(F.try_divide(F.sin(repeats * step / 2), F.sin(step / 2)))
    turn = F.when(near, 0.0).otherwise((repeats - 1) * step / 2) + angle * F.col("phase")
    power = waves.groupBy(*g.keys, "k", "n").agg(
        F.sum(F.col("seasonal") * size * F.cos(turn)).alias("_re"), F.sum(F.col("seasonal") * size * F.sin(turn)).alias("_im"))
    power = power.withColumn("power", F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))
    best = power.groupBy(*g.keys).agg(F.max_by(F.struct("k", "n", "power"), F.col("power")).alias("_b"))
    return best.select(*g.keys, F.floor(F.col("_b.n") / F.col("_b.k")).alias("period"), F.col("_b.power").alias("power"))
