"""Feature selection. Statistics come from Spark aggregations; the lists they shrink to are short."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import stats
from barloom.functions.scalars import normal_cdf
from barloom.operators.aggregate import above_quantile, correlations, exact_quantiles, pair_correlations
from barloom.operators.forecast import assemble, repeatable
from barloom.operators.grouped import bucketed
from barloom.session import stage
from barloom.sources.ingest import key_uniform


def colinear_filter(df: DataFrame, features: Sequence[str], limit: float = 0.95, block: int = 256) -> list[str]:
    """Walk the features in order and drop those with limit <= |corr| < 1 to a kept one.

    Each pair is correlated over the rows where both are there, in one pass whatever the number of features. Only the close pairs of
    features come to the driver. A constant has no correlation.
    """
    rows = df.select(*features)
    ends = rows.agg(*[F.min(f).alias(f"lo{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"hi{i}") for i, f in enumerate(features)]).first()
    varying = [f for i, f in enumerate(features) if ends[f"lo{i}"] != ends[f"hi{i}"]]
    found = pair_correlations(rows, varying, block).where((F.abs("r") >= limit) & (F.abs("r") < 1)).collect()
    close = {frozenset((varying[p.i], varying[p.j])) for p in found}
    kept: list[str] = []
    for f in features:
        if not any(frozenset((f, k)) in close for k in kept):
            kept.append(f)
    return kept


def chi2_scores(df: DataFrame, columns: Sequence[str], up: Column) -> DataFrame:
    """Chi-square of each one-hot value against the sign of the target: ``(column, value, chi2)``.

    One aggregation over ``(column, value)``; class shares come from its totals.
    """
    long = df.select(up.alias("_up"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_v")).select("_up", "_v.*")
    counts = long.groupBy("column", "value").agg(F.count_if("_up").alias("_u"), F.count_if(~F.col("_up")).alias("_d"))
    w = Window.partitionBy("column")
    n, p = F.sum(F.col("_u") + F.col("_d")).over(w), F.sum("_u").over(w) / F.sum(F.col("_u") + F.col("_d")).over(w)
    of = F.col("_u") + F.col("_d")
    term = lambda seen, expected: F.try_divide((seen - expected) * (seen - expected), expected)
    return counts.withColumn("chi2", term(F.col("_u"), of * p) + term(F.col("_d"), of * (1 - p))).select("column", "value", "chi2")


def chi2_categorical(df: DataFrame, columns: Sequence[str], up: Column, share: float = 0.1) -> list[str]:
    """Columns with a value among the top ``share`` of all values by chi-square."""
    scores = stage(chi2_scores(df, columns, up), "scores")
    first = scores.orderBy(F.col("chi2").desc(), "column", "value").limit(max(1, int(share * scores.count())))
    top = {r.column for r in first.select("column").distinct().collect()}  # column names, not values
    return [c for c in columns if c in top]


def ordered_lists(*lists: Sequence[str], limit: int | None = None) -> list[str]:
    """Union of ranked lists, first occurrence wins, cut at ``limit``."""
    out = list(dict.fromkeys(f for fs in lists for f in fs))
    return out[:limit] if limit else out


def primary_filter(df: DataFrame, targets: Sequence[str], features: Sequence[str], categories: Sequence[str], up: Column,
                   q: float = 0.7, limit: float = 0.95, share: float = 0.1) -> list[str]:
    """Per target the features most correlated with it, free of near copies; then the chi-square categories."""
    lists = []
    for t in targets:
        ranked = above_quantile(correlations(df, [], t, features), [], q).orderBy(F.col("score").desc(), "feature")
        lists.append(colinear_filter(df, [r.feature for r in ranked.collect()], limit))
    return ordered_lists(*lists, chi2_categorical(df, categories, up, share) if categories else [])


def _forest(df: DataFrame, features: Sequence[str], target: str, seed: int, trees: int, depth: int) -> list[float]:
    rows = repeatable(df.select(target, *features), target, *features)
    data = assemble(rows, features)
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    return [float(v) for v in model.featureImportances.toArray()]


def rfe_select(df: DataFrame, features: Sequence[str], target: str, n: int, step: float = 0.05, seed: int = 7, trees: int = 10, depth: int = 4) -> list[str]:
    """Recursive elimination: refit and drop the least important ``step`` until ``n`` features are left."""
    kept = list(features)
    while len(kept) > n:
        importance = _forest(df, kept, target, seed, trees, depth)
        drop = min(len(kept) - n, max(1, int(step * len(kept))))
        order = sorted(range(len(kept)), key=lambda i: (importance[i], kept[i]))
        gone = set(order[:drop])
        kept = [f for i, f in enumerate(kept) if i not in gone]
    return kept


def _cuts(df: DataFrame, col: str, qs: Sequence[float]) -> Column:
    """Quantiles of one column as a literal array."""
    row = exact_quantiles(df.select(F.lit(1).alias("_one"), col), ["_one"], col, qs).first()
    return F.array(*[F.lit(float(v)) for v in row.quantiles])


def joint_counts(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Counts per feature of (feature bin, target bin) cells; bins are exact quantile ranges.

    At most ``bins`` x ``bins`` cells per feature leave the aggregation.
    """
    qs = [i / bins for i in range(1, bins)]
    long = df.select(F.col(target).alias("_y"), *features).unpivot(["_y"], list(features), "feature", "_x").where("_x is not null and _y is not null")
    cuts = stage(exact_quantiles(long, ["feature"], "_x", qs))
    target_cuts = _cuts(df, target, qs)
    bx = F.size(F.filter("quantiles", lambda c: c < F.col("_x")))
    by = F.size(F.filter(target_cuts, lambda c: c < F.col("_y")))
    # The cut table has one short row per feature name.
    return long.join(F.broadcast(cuts), "feature").groupBy("feature", bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(cells: DataFrame) -> DataFrame:
    """Mutual information per feature from joint counts (binned: an approximation of the continuous value)."""
    w = Window.partitionBy("feature")
    n = F.sum("n").over(w)
    ratio = F.col("n") * n / (F.sum("n").over(w.partitionBy("feature", "bx")) * F.sum("n").over(w.partitionBy("feature", "by")))
    return cells.withColumn("_t", F.col("n") / n * F.ln(ratio)).groupBy("feature").agg(F.sum("_t").alias("mi"))


def mutual_info_top_k(df: DataFrame, features: Sequence[str], target: str, k: int, k_sign: int, bins: int = 10) -> DataFrame:
    """Top k features by mutual information with the target, then those with its sign: ``(feature, mi, mi_sign)``."""
    cells = stage(joint_counts(df, features, target, bins))
    signed = joint_counts_sign(df, features, target, bins)
    both = mutual_information(cells).join(mutual_information(signed).withColumnRenamed("mi", "mi_sign"), "feature")
    a = F.row_number().over(Window.orderBy(F.col("mi").desc(), "feature"))
    b = F.row_number().over(Window.orderBy(F.col("mi_sign").desc(), "feature"))
    return both.withColumns({"_a": a, "_b": b}).where((F.col("_a") <= k) | (F.col("_b") <= k_sign)).drop("_a", "_b")


def joint_counts_sign(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Joint counts with the sign of the target (0 down, 1 up) as second axis."""
    qs = [i / bins for i in range(1, bins)]
    long = df.select((F.col(target) >= 0).cast("int").alias("by"), *features).unpivot(["by"], list(features), "feature", "_x").where("_x is not null and by is not null")
    cuts = stage(exact_quantiles(long, ["feature"], "_x", qs))
    bx = F.size(F.filter("quantiles", lambda c: c < F.col("_x")))
    return long.join(F.broadcast(cuts), "feature").groupBy("feature", bx.alias("bx"), "by").agg(F.count(F.lit(1)).alias("n"))


def two_valued(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with exactly two values: everything equals the minimum or the maximum, which differ."""
    ends = df.agg(*[F.min(f).alias(f"lo_{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    inner = df.agg(*[F.count_if((F.col(f) != ends[f"lo_{i}"]) & (F.col(f) != ends[f"hi_{i}"])).alias(f"n_{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if ends[f"lo_{i}"] != ends[f"hi_{i}"] and inner[f"n_{i}"] == 0]


def kendall(cells: DataFrame) -> DataFrame:
    """Kendall test per feature on binned ranks: ``(feature, tau, p_value)``.

    Works on the joint counts (a fixed number of cells per feature), with the tie-corrected variance.
    """
    a, b = cells.alias("a"), cells.alias("b")
    cd = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("b.bx") < F.col("a.bx"))).groupBy(F.col("a.feature").alias("feature")).agg(
        F.sum(F.signum(F.col("a.by") - F.col("b.by")) * F.col("a.n") * F.col("b.n")).alias("_s"))

    def ties(axis: str, name: str) -> DataFrame:
        t = F.col("_n").cast("double")
        return cells.groupBy("feature", axis).agg(F.sum("n").alias("_n")).groupBy("feature").agg(
            F.sum(t * (t - 1) / 2).alias(f"{name}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}0"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}1"), F.sum(t).alias("_m" if name == "x" else "_m2"))
    j = cd.join(ties("bx", "x"), "feature").join(ties("by", "y"), "feature")
    n = F.col("_m")
    pairs = n * (n - 1)
    var = (pairs * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18 + 2 * F.col("x2") * F.col("y2") / pairs + F.col("x0") * F.col("y0") / (9 * pairs * (n - 2))
    tau = F.try_divide(F.col("_s"), F.sqrt((pairs / 2 - F.col("x2")) * (pairs / 2 - F.col("y2"))))
    return j.select("feature", tau.alias("tau"), (2 * normal_cdf(-F.abs(F.try_divide(F.col("_s"), F.sqrt(var))))).alias("p_value"))


def two_sample_ks(cells: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance of the target between the two values of a binary feature, from counts
    per target bin: ``(feature, distance, p_value)``."""
    w = Window.partitionBy("feature")
    split = cells.groupBy("feature", "by").agg(F.sum(F.when(F.col("bx") == 0, F.col("n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("bx") > 0, F.col("n")).otherwise(0)).alias("_b"))
    run = w.orderBy("by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda c: F.try_divide(F.sum(c).over(run), F.sum(c).over(w))
    gaps = split.select("feature", F.abs(share("_a") - share("_b")).alias("_d"), F.sum("_a").over(w).alias("_na"), F.sum("_b").over(w).alias("_nb"))
    out = gaps.groupBy("feature").agg(F.max("_d").alias("distance"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
    return out.select("feature", "distance", stats.kolmogorov_upper(F.col("distance"), F.col("_na") * F.col("_nb") / (F.col("_na") + F.col("_nb"))).alias("p_value"))


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of sign(x - x') * sign(y - y') * w * w', by merging sorted halves level by level."""
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(float)
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    span, total, half = int(rank.max()) + 1, 0.0, 1
    while half < len(x):
        pair = np.arange(len(x)) // (2 * half)
        left = np.arange(len(x)) % (2 * half) < half
        # left halves sorted by (pair, rank): where each row of a right half falls among those of its own pair
        key = pair * span + rank
        lk, lw = key[left], w[left]
        s = np.argsort(lk, kind="stable")
        lk, cum = lk[s], np.r_[0.0, np.cumsum(lw[s])]
        rk, start, end = key[~left], pair[~left] * span, (pair[~left] + 1) * span
        below = cum[np.searchsorted(lk, rk, "left")] - cum[np.searchsorted(lk, start, "left")]
        above = cum[np.searchsorted(lk, end, "left")] - cum[np.searchsorted(lk, rk, "right")]
        total += float(((below - above) * w[~left]).sum())
        half *= 2
    # rows of one x stood in order of y, as if the later ones had a greater x
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    of_x = np.add.reduceat(w, first)
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (rank[1:] != rank[:-1])])
    of_xy = np.add.reduceat(w, new)
    return total - float((of_x**2).sum() - (of_xy**2).sum()) / 2


def _pairs_inside(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(feature, s): signed pairs inside each group of ``by``; a group is a range of values, one after the other in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, sums = None, [], {}

        def close() -> None:
            u, v, w = (np.concatenate(c) for c in zip(*parts))
            if u.min() < u.max() and v.min() < v.max():  # a range of one value holds ties only
                sums[now[0]] = sums.get(now[0], 0.0) + signed_pairs(u, v, w)

        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in by]))
            u, v, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_u", "_v", "_w"))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if names[lo] != now:
                    if now is not None:
                        close()
                    now, parts = names[lo], []
                parts.append((u[lo:hi], v[lo:hi], w[lo:hi]))
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["feature", "s"])

    cols = [*by, F.col(x).cast("double").alias("_u"), F.col(y).cast("double").alias("_v"), F.col("_n").cast("double").alias("_w")]
    return rows.select(*cols).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "feature string, s double")


def _below(c: str) -> Callable[[Column], Column]:
    return lambda q: q < F.col(c)


def kendall_exact(df: DataFrame, features: Sequence[str], target: str, parts: int = 64) -> DataFrame:
    """Kendall test per feature without bins: ``(feature, n, tau, p_value)``, over the rows where both are there.

    Equal pairs of values are counted first. Feature and target are cut into ``parts`` ranges of values each. Pairs whose ranges differ on both sides
    are read from the parts x parts table of counts; pairs inside a range of the feature are counted in that range, by merging; pairs inside a range
    of the target whose feature ranges differ are counted there, with range numbers in place of values. No task sees a whole feature unless a value
    holds its rows, and ranges of one value have ties only.
    """
    parts = max(2, parts)
    long = df.select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["_y"], list(features), "feature", "_x")
    pairs = stage(long.where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)").groupBy("feature", "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "pairs")
    placed = pairs
    sides = {}
    for c in ("_x", "_y"):
        counts = pairs.groupBy("feature", c).agg(F.sum("_n").alias("_m"))
        cuts = counts.groupBy("feature").agg(F.percentile_approx(c, [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"))
        placed = placed.join(stage(cuts, "cuts"), "feature").withColumn(f"{c}b", F.size(F.filter("_cuts", _below(c)))).drop("_cuts")
        t = F.col("_m").cast("double")
        sides[c] = counts.groupBy("feature").agg(
            F.sum(t * (t - 1) / 2).alias(f"{c}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{c}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{c}1"), F.sum(t).alias(f"{c}n"))
    placed = stage(placed, "placed")
    cells = stage(placed.groupBy("feature", "_xb", "_yb").agg(F.sum("_n").alias("_n")), "cells")
    a, b = cells.alias("a"), cells.alias("b")
    across = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("b._xb") < F.col("a._xb"))).groupBy(F.col("a.feature").alias("feature")).agg(
        F.sum(F.signum(F.col("a._yb") - F.col("b._yb")) * F.col("a._n") * F.col("b._n")).alias("s"))  # parts ** 4 / 2 pairs of cells at most
    same_x = _pairs_inside(placed, ["feature", "_xb"], "_x", "_y")
    same_y = _pairs_inside(placed.groupBy("feature", "_yb", "_xb", "_y").agg(F.sum("_n").alias("_n")), ["feature", "_yb"], "_xb", "_y")
    s = across.unionByName(same_x).unionByName(same_y).groupBy("feature").agg(F.sum("s").alias("_s"))
    j = sides["_x"].join(sides["_y"], "feature").join(s, "feature", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    n = F.col("_xn")
    every = n * (n - 1)
    var = (every * (2 * n + 5) - F.col("_x1") - F.col("_y1")) / 18 + F.try_divide(2 * F.col("_x2") * F.col("_y2"), every) + F.try_divide(F.col("_x0") * F.col("_y0"), 9 * every * (n - 2))
    tau = F.try_divide(F.col("_s"), F.sqrt((every / 2 - F.col("_x2")) * (every / 2 - F.col("_y2"))))
    return j.select("feature", n.cast("long").alias("n"), tau.alias("tau"), (2 * normal_cdf(-F.abs(F.try_divide(F.col("_s"), F.sqrt(var))))).alias("p_value"))


def two_sample_ks_exact(df: DataFrame, features: Sequence[str], target: str, parts: int = 64) -> DataFrame:
    """Kolmogorov-Smirnov distance of the target between the two values of each binary feature, without bins: ``(feature, distance, p_value)``.

    Equal values are counted first; running counts are taken inside ``parts`` ranges of the target, on top of the counts of the ranges before.
    """
    parts = max(2, parts)
    ends = df.agg(*[F.min(f).alias(f"lo{i}") for i, f in enumerate(features)]).first()
    marked = df.select(F.col(target).cast("double").alias("_y"), *[(F.col(f) > F.lit(ends[f"lo{i}"])).cast("int").alias(f) for i, f in enumerate(features)])
    long = marked.unpivot(["_y"], list(features), "feature", "_b").where("_y is not null and not isnan(_y) and _b is not null")
    counts = stage(long.groupBy("feature", "_y").agg(F.count_if(F.col("_b") == 0).alias("_a"), F.count_if(F.col("_b") == 1).alias("_c")), "counts")
    cuts = stage(counts.groupBy("feature").agg(F.percentile_approx("_y", [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts")), "cuts")
    ranged = counts.join(cuts, "feature").withColumn("_part", F.size(F.filter("_cuts", lambda q: q < F.col("_y")))).drop("_cuts")
    whole = Window.partitionBy("feature")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("feature", "_part").agg(F.sum("_a").alias("_a"), F.sum("_c").alias("_c"))
    offsets = sums.select("feature", "_part", *[x for c in ("_a", "_c") for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0"), F.sum(c).over(whole).alias(f"{c}n"))])
    inside = Window.partitionBy("feature", "_part").orderBy("_y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda c: F.try_divide(F.sum(c).over(inside) + F.col(f"{c}0"), F.col(f"{c}n"))
    gaps = ranged.join(stage(offsets, "offsets"), ["feature", "_part"]).select("feature", F.abs(share("_a") - share("_c")).alias("_d"), "_an", "_cn")
    out = gaps.groupBy("feature").agg(F.max("_d").alias("distance"), F.max("_an").alias("_an"), F.max("_cn").alias("_cn"))
    size = F.try_divide(F.col("_an") * F.col("_cn"), F.col("_an") + F.col("_cn"))
    return out.select("feature", "distance", stats.kolmogorov_upper(F.col("distance"), size).alias("p_value"))


def fdr(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: corrected p-value and rejection, over one short list of tests."""
    w = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(w.orderBy(p, "feature"))
    raw = df.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(w))
    back = w.orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back))
    return raw.withColumn("p_corrected", adjusted).withColumn("rejected", F.col("p_corrected") <= alpha).drop("_r", "_n")


def relevance(df: DataFrame, features: Sequence[str], target: str, p_limit: float = 0.01, top: int | None = None, bins: int = 10) -> DataFrame:
    """Significance of each feature for a real target with false-discovery control, most significant first."""
    binary = two_valued(df, features)
    real = [f for f in features if f not in binary]
    parts = []
    if real:
        parts.append(kendall(stage(joint_counts(df, real, target, bins))).select("feature", "p_value"))
    if binary:
        # One cut at the minimum separates the two values of a binary feature.
        parts.append(two_sample_ks(joint_counts_two(df, binary, target)).select("feature", "p_value"))
    tests = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = fdr(tests).where(F.col("rejected") & (F.col("p_value") < p_limit)).orderBy("p_value", "feature")
    return out.limit(top) if top else out


def joint_counts_two(df: DataFrame, features: Sequence[str], target: str, bins: int = 64) -> DataFrame:
    """Joint counts of two-valued features (0 low, 1 high) with fine target bins."""
    qs = [i / bins for i in range(1, bins)]
    low = df.agg(*[F.min(f).alias(f) for f in features]).first()
    cuts = _cuts(df, target, qs)
    marked = df.select(F.col(target).alias("_y"), *[(F.col(f) > low[f]).cast("int").alias(f) for f in features])
    long = marked.unpivot(["_y"], list(features), "feature", "bx").where("_y is not null")
    return long.groupBy("feature", "bx", F.size(F.filter(cuts, lambda c: c < F.col("_y"))).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def binary_target_tests(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Test of each feature against the sign of the target: ``(feature, test, statistic, p_value)``.

    Two-valued features: chi-square of the 2 x 2 table with continuity correction. Others: Welch t-test.
    One aggregation serves all features.
    """
    binary = two_valued(df, features)
    low = df.agg(*[F.min(f).alias(f) for f in features]).first()
    up = F.col(target) >= 0
    known = df.where(F.col(target).isNotNull())
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        hi = F.col(f) > low[f]
        aggs.append(F.struct(
            F.lit(f).alias("feature"), F.lit(f in binary).alias("two"),
            F.count(F.when(~up, x)).alias("n0"), F.count(F.when(up, x)).alias("n1"), F.avg(F.when(~up, x)).alias("m0"), F.avg(F.when(up, x)).alias("m1"),
            F.var_samp(F.when(~up, x)).alias("v0"), F.var_samp(F.when(up, x)).alias("v1"),
            F.count_if(~up & hi).cast("double").alias("h0"), F.count_if(up & hi).cast("double").alias("h1")))
    rows = known.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")
    a, b = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n0") - 1) + F.try_divide(b * b, F.col("n1") - 1))
    l0, l1 = F.col("n0") - F.col("h0"), F.col("n1") - F.col("h1")
    n = F.col("n0") + F.col("n1")
    gap = F.abs(F.col("h0") * l1 - F.col("h1") * l0)
    less = F.greatest(F.lit(0.0), gap - F.least(n / 2, gap))
    chi = F.try_divide(n * less * less, F.col("n0") * F.col("n1") * (F.col("h0") + F.col("h1")) * (l0 + l1))
    out = rows.withColumns({"_t": t, "_d": dof, "_c": chi})
    out = out.withColumn("p_value", F.when(F.col("two"), 2 * normal_cdf(-F.sqrt("_c"))).otherwise(stats.t_two_sided(F.col("_t"), F.col("_d"))))
    return out.select("feature", F.when(F.col("two"), "chi2").otherwise("welch").alias("test"), F.when(F.col("two"), F.col("_c")).otherwise(F.col("_t")).alias("statistic"), "p_value")


def select_binary_target(tests: DataFrame, p_limit: float = 0.02, top: int | None = None) -> DataFrame:
    out = tests.where(F.col("p_value") <= p_limit).orderBy("p_value", "feature")
    return out.limit(top) if top else out


def shuffled(df: DataFrame, keys: Sequence[str], features: Sequence[str], seed: int) -> DataFrame:
    """Shadow copy of each feature: its values in another, random row order.

    Rows are numbered twice by hash order, once plain and once per column, and joined on the number.
    Numbers come from counts per hash range, so no task orders all rows.
    """
    def numbered(frame: DataFrame, salt: str, name: str) -> DataFrame:
        u = frame.withColumn("_u", key_uniform(*keys, salt=salt)).withColumn("_part", F.floor(F.col("_u") * 256))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = u.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy("_u", *keys))
        return u.withColumn("_rn", inside).join(offsets, "_part").withColumn(name, F.col("_rn") + F.col("_off")).drop("_u", "_part", "_rn", "_off")

    out = stage(numbered(df, f"{seed}", "_row"))
    for f in features:
        other = numbered(df.select(*keys, F.col(f).alias(f"shadow_{f}")), f"{seed}-{f}", "_row").select("_row", f"shadow_{f}")
        out = out.join(other, "_row")
    return out.drop("_row")


def _binomial_upper(hits: int, n: int) -> float:
    """Chance of ``hits`` or more heads in ``n`` throws."""
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2.0**n


def false_discoveries(p: Sequence[float], alpha: float) -> list[bool]:
    """Benjamini-Hochberg over a short list: which tests are rejected."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max((k for k, i in enumerate(order, 1) if p[i] <= alpha * k / len(p)), default=0)
    chosen = set(order[:last])
    return [i in chosen for i in range(len(p))]


def decide(hits: dict[str, int], undecided: Sequence[str], n: int, alpha: float) -> tuple[list[str], list[str]]:
    """Accepted and rejected among ``undecided`` after ``n`` rounds. Two corrections: false discoveries over all features of the first list, then ``alpha`` shared by the rounds."""
    names = list(hits)
    out = []
    for tail in (lambda h: _binomial_upper(h, n), lambda h: 1 - _binomial_upper(h + 1, n)):
        p = [tail(hits[f]) for f in names]
        found = false_discoveries(p, alpha)
        out.append([f for f, q, d in zip(names, p, found) if d and q <= alpha / n and f in undecided])
    return out[0], out[1]


def permuted(df: DataFrame, n: int, seed: int, row: str = "_row", vector: str = "_x", name: str = "_shadow") -> DataFrame:
    """Row i with the vector of row (a * i + b) mod n, a bijection keyed by ``seed``: one join, whatever the number of features.

    The inverse bijection says which row each vector goes to, so only vectors travel when ``df`` is bucketed by ``row``. The join stays a merge
    join, whose partitions are those of ``row``.
    """
    rnd = random.Random(seed)
    a = next(k for k in iter(lambda: rnd.randrange(1, max(2, n)), None) if math.gcd(k, n) == 1) if n > 1 else 1
    b = rnd.randrange(max(1, n))
    back = pow(a, -1, max(1, n))
    wide = "bigint" if n < 1 << 31 else "decimal(38,0)"  # back * (row + n) fits
    to = F.expr(f"cast((cast({back} as {wide}) * ({row} + {n - b})) % {max(1, n)} as bigint)")
    return df.join(df.select(to.alias(row), F.col(vector).alias(name)).hint("merge"), row)


def boruta_select(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, rounds: int | None = None, alpha: float = 0.05, seed: int = 7,
                  trees: int = 10, depth: int = 4) -> dict[str, tuple[int, str]]:
    """Features that beat the best shadow more often than chance: ``{feature: (hits, decision)}``.

    Feature vectors are written once with row numbers in hash order, bucketed by them. A round sends every row the vector of another row as its shadows (one
    shuffle), keeps both while it fits one forest on them, and lets go of them; a feature has a hit when it matters more than every shadow. After each round features are accepted and rejected by binomial tests with two corrections
    (see ``decide``); rejected ones and their shadows leave the pool, and the search ends when none is undecided or after ``rounds`` (default 30). Hits are those
    until the decision.
    """
    rounds = rounds or 30
    known = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    rows = df.where(F.col(target).isNotNull()).select(*keys, F.col(target).cast("double").alias("_y"), F.array(*known).alias("_x"))
    u = rows.withColumn("_u", key_uniform(*keys, salt=f"{seed}")).withColumn("_part", F.floor(F.col("_u") * 256))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = u.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_u", *keys))
    numbered = u.withColumn("_rn", inside).join(offsets, "_part").select((F.col("_rn") + F.col("_off") - 1).alias("_row"), "_y", "_x")
    staged = bucketed(numbered, ["_row"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vectors")
    n = staged.count()
    hits, decision, pool = dict.fromkeys(features, 0), {}, list(features)
    for r in range(1, rounds + 1):
        if n < 2 or len(decision) == len(features):
            break
        at = [features.index(f) for f in pool]
        both = permuted(staged, n, seed * 1000 + r).sortWithinPartitions("_row")
        data = both.select("_y", array_to_vector(F.array(*[F.col("_x")[i] for i in at], *[F.col("_shadow")[i] for i in at])).alias("_x")).persist()  # a fit reads its rows three times
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed + r).fit(data)
        data.unpersist()
        weight = [float(v) for v in model.featureImportances.toArray()]
        best = max(weight[len(pool):])
        for f, v in zip(pool, weight):
            hits[f] += f not in decision and v > best
        undecided = [f for f in pool if f not in decision]
        accepted, rejected = decide({f: hits[f] for f in pool if f not in decision}, undecided, r, alpha)
        decision |= dict.fromkeys(accepted, "accepted") | dict.fromkeys(rejected, "rejected")
        pool = [f for f in pool if decision.get(f) != "rejected"]
    return {f: (hits[f], decision.get(f, "tentative")) for f in features}


def select_panel(df: DataFrame, features: Sequence[str], target: str, forced: Sequence[str], limit: int, n_rfe: int, k: int, k_sign: int,
                 p_relevance: float = 0.01, p_binary: float = 0.02) -> list[str]:
    """Forced features, then elimination, mutual information, relevance and sign tests; cut at ``limit``."""
    names = lambda rows: [r.feature for r in rows.select("feature").collect()]
    return ordered_lists(
        [f for f in forced if f in features],
        rfe_select(df, features, target, n_rfe),
        names(mutual_info_top_k(df, features, target, k, k_sign).orderBy(F.col("mi").desc(), "feature")),
        names(relevance(df, features, target, p_relevance)),
        names(select_binary_target(binary_target_tests(df, features, target), p_binary)),
        limit=limit)
