"""Aggregations over panels, fills and balances."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.session import join_staged, stage


def band_thresholds(df: DataFrame, keys: Sequence[str], cols: Sequence[str], z: float = 1.96) -> DataFrame:
    """Per column mean - z * std and mean + z * std (sample), as ``<c>_low`` and ``<c>_high``."""
    aggs = []
    for c in cols:
        aggs.append((F.avg(c) - z * F.stddev_samp(c)).alias(f"{c}_low"))
        aggs.append((F.avg(c) + z * F.stddev_samp(c)).alias(f"{c}_high"))
    return df.groupBy(*keys).agg(*aggs)


def long_thresholds(wide: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key and column from the wide ``<c>_low`` / ``<c>_high`` row."""
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high")) for c in cols
    ])).alias("_t")).select(*keys, "_t.*")


def outlier_thresholds(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prices: Sequence[str], z: float = 4.0) -> DataFrame:
    """Wide thresholds: mean - z std to mean + z std; prices 0 to mean + 9.5 std (10 for a high)."""
    aggs = []
    for c in cols:
        mean, std = F.avg(c), F.stddev_samp(c)
        if c in prices:
            aggs += [F.lit(0.0).alias(f"{c}_low"), (mean + (10.0 if c.endswith("high") else 9.5) * std).alias(f"{c}_high")]
        else:
            aggs += [(mean - z * std).alias(f"{c}_low"), (mean + z * std).alias(f"{c}_high")]
    return df.groupBy(*keys).agg(*aggs)


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, parts: int = 64) -> DataFrame:
    """Distinct values ``_v`` of a column with the ranks ``_first`` .. ``_last`` (from 0) they cover in
    the sorted column of their key, and the number of values ``_total``.

    Values are counted first (spread over all tasks), cut into ``parts`` ranges by an approximate sketch
    of bounded size, and ranked inside each range, so a hot key is not sorted in one task.
    """
    counts = stage(df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(
        "_v", [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"))
    ranged = counts.join(cuts, list(keys)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    by_part = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by_part).agg(F.sum("_n").alias("_m")).select(
        *by_part, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*by_part).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("_cum", F.sum("_n").over(inside)).join(offsets, by_part)
    last = F.col("_off") + F.col("_cum") - 1
    return ranked.select(*keys, "_v", (last - F.col("_n") + 1).alias("_first"), last.alias("_last"), "_total")


SKETCH = 10_000  # accuracy of the sketch that proposes where to look for a rank


def ranks_near(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float], accuracy: int = SKETCH) -> DataFrame:
    """The rows of ``value_ranks`` that hold the ranks of the quantiles ``qs``, and few others.

    A bounded sketch proposes two cuts around each quantile. One pass counts exactly what lies at the cuts and between them, which says in which of
    these ranges the wanted ranks are; only the values there are counted one by one and ranked. Nothing else is shuffled, and a sketch that misses makes
    ranges longer, not results wrong.
    """
    rows = stage(df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v")), "values")
    near = sorted({min(1.0, max(0.0, q + d)) for q in qs for d in (-2 / accuracy, 2 / accuracy)})
    cuts = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", near, accuracy))).alias("_cuts"))
    at = [F.get("_cuts", F.lit(i)) for i in range(len(near))]  # a lambda over the cuts would cost more than all else
    below = sum((F.coalesce((c < F.col("_v")).cast("int"), F.lit(0)) for c in at), F.lit(0))
    equal = F.coalesce(F.greatest(*[(c == F.col("_v")).cast("int") for c in at]), F.lit(0))
    placed = join_staged(rows, cuts, keys).withColumn("_part", 2 * below + equal).drop("_cuts")
    by_part = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by_part).agg(F.count(F.lit(1)).alias("_m")).select(
        *by_part, "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"), F.sum("_m").over(Window.partitionBy(*keys)).alias("_total"))
    holds = lambda rank: (rank >= F.col("_off")) & (rank < F.col("_off") + F.col("_m"))
    spots = F.array(*[(F.col("_total") - 1) * F.lit(float(q)) for q in qs])
    wanted = sizes.where(F.exists(spots, lambda p: holds(F.floor(p)) | holds(F.ceil(p)))).drop("_m")
    counts = join_staged(placed, wanted, by_part).groupBy(*by_part, "_off", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*by_part).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("_off") + F.col("_cum") - 1
    return counts.withColumn("_cum", F.sum("_n").over(inside)).select(*keys, "_v", (last - F.col("_n") + 1).alias("_first"), last.alias("_last"), "_total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float], parts: int = 64) -> DataFrame:
    """Linear-interpolated quantiles, exact, as array ``quantiles`` per key.

    ``percentile`` would hold every distinct value of a hot key in one task; this picks the wanted ranks
    from ``ranks_near``, or for many quantiles from ``value_ranks``.
    """
    ranked = ranks_near(df, keys, col, qs) if len(qs) <= 4 else value_ranks(df, keys, col, parts)
    spots = F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q, i: F.struct(i.alias("i"), ((F.col("_total") - 1) * q).alias("p")))
    covers = lambda rank: (rank >= F.col("_first")) & (rank <= F.col("_last"))
    hits = ranked.select(*keys, "_v", "_first", "_last", F.explode(F.filter(
        spots, lambda s: covers(F.floor(s.p)) | covers(F.ceil(s.p)))).alias("_s"))
    p = F.col("_s.p")
    ends = hits.groupBy(*keys, F.col("_s.i").alias("_i")).agg(
        F.max(F.when(covers(F.floor(p)), F.col("_v"))).alias("_lo"), F.max(F.when(covers(F.ceil(p)), F.col("_v"))).alias("_hi"),
        F.max(p - F.floor(p)).alias("_w"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    return ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_q")).select(
        *keys, F.transform("_q", lambda x: x.v).alias("quantiles"))


def most_frequent(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent value per key, the smallest one on ties."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(col).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(col))


def imputer_statistics(df: DataFrame, numbers: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """One row per column: median of numbers, most frequent string."""
    whole = df.withColumn("_all", F.lit(1))
    parts = []
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], list(numbers), "column", "_x")
        found = exact_quantiles(long, ["column"], "_x", [0.5])
        names = df.sparkSession.createDataFrame([(c,) for c in numbers], "column string")
        parts.append(names.join(found, "column", "left").select("column", F.col("quantiles")[0].alias("number"), F.lit(None).cast("string").alias("text")))
    parts += [
        most_frequent(whole, ["_all"], c).select(
            F.lit(c).alias("column"), F.lit(None).cast("double").alias("number"), F.col(c).alias("text"))
        for c in strings
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlations(df: DataFrame, keys: Sequence[str], target: str, cols: Sequence[str]) -> DataFrame:
    """|Pearson| of each column with the target, one aggregation for all columns."""
    return df.groupBy(*keys).agg(*[F.abs(F.corr(target, c)).alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "feature", "score")


def above_quantile(scores: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Features whose score is above the q-quantile of their list."""
    w = Window.partitionBy(*keys)
    return scores.withColumn("_q", F.percentile("score", F.lit(q)).over(w)).where(F.col("score") > F.col("_q")).drop("_q")


def correlation_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pairwise |Pearson| x 100 over common rows (null becomes 100), one row per column pair.

    The pairs are pairs of columns: their number does not depend on the rows, and one pass of partial
    sums covers them all.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.abs(f"_c{i}") * 100, F.lit(100.0)).alias("score"))
             for i, (a, b) in enumerate(pairs)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_p")).select(*keys, "_p.*")


def dense_correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same for long lists of columns without nulls (a finished feature table), by one Gram matrix.

    Hundreds of columns would make hundreds of thousands of aggregates; here each task keeps one
    columns x columns matrix, and that matrix is what reaches the driver.
    """
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="skip").transform(df.select(*cols))
    m = Correlation.corr(vectors, "_x").first()[0].toArray()
    rows = [(a, b, 100.0 if math.isnan(m[i, j]) else abs(float(m[i, j])) * 100)
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, score double")


def pair_correlations(df: DataFrame, cols: Sequence[str], block: int = 256) -> DataFrame:
    """Pearson ``r`` of every column pair ``(i, j)``, i < j (positions in ``cols``), over the rows where both are there.

    One pass whatever the number of columns: a task keeps six columns x columns matrices of pairwise-complete sums (NaN and infinite
    values count as missing) and gives them up as one row per column, whose partial sums Spark adds up. Values are centred at the
    mean of their column first. ``r`` is rounded to 14 decimals, so that exact copies have 1; it is null where a column does not vary. ``block``: columns per batch given up.
    """
    n = len(cols)
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    rows = df.select(*[known(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    if not n:
        return df.sparkSession.createDataFrame([], "i int, j int, r double")
    means = np.array([0.0 if v is None else v for v in rows.agg(*[F.avg(f"_x{i}") for i in range(n)]).first()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, n, n))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            there = ~np.isnan(x)
            x, m = np.where(there, x - means, 0.0), there.astype(float)
            x2 = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, x2.T @ m, m.T @ x2, x.T @ x])
        for lo in range(0, n, block):
            part = [total[:, i, i + 1:].reshape(-1) for i in range(lo, min(n, lo + block))]
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int32()), pa.array(part, pa.list_(pa.float64()))], ["i", "s"])

    parts = rows.mapInArrow(sums, "i int, s array<double>").where("size(s) > 0")
    width = n - 1 - F.col("i")
    cells = parts.select("i", F.posexplode("s").alias("at", "v"))
    cells = cells.groupBy("i", (F.col("i") + 1 + F.col("at") % width).cast("int").alias("j")).agg(
        *[F.sum(F.when(F.floor(F.col("at") / width) == k, F.col("v"))).alias(f"s{k}") for k in range(6)])
    count, a, b, aa, bb, ab = (F.col(f"s{k}") for k in range(6))
    va, vb = aa - F.try_divide(a * a, count), bb - F.try_divide(b * b, count)
    r = F.when((va > 0) & (vb > 0), (ab - a * b / count) / F.sqrt(va * vb))
    return cells.select("i", "j", F.round(r, 14).alias("r"))


def peer_scores(wide: DataFrame, peers: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Mean |corr| of each peer's one-bar-old columns with the current columns of all other peers, ranked.

    ``wide`` holds ``<peer>_<kind>`` and ``<peer>_<kind>_shifted`` columns, one row per time.
    """
    rows = []
    for p in peers:
        terms = [F.abs(F.corr(f"{p}_{k}_shifted", f"{o}_{m}")) for k in kinds for o in peers if o != p for m in kinds]
        rows.append((sum(terms[1:], terms[0]) / len(terms)).alias(p))
    scores = wide.agg(*rows).unpivot([], list(peers), "series", "score")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "series")))


def train_peers(matrix: DataFrame, limit: float = 0.6, q: float = 0.25) -> DataFrame:
    """Peers of each series whose |corr| exceeds min(limit, q-quantile of the series' own list).

    ``matrix`` holds ``(series, peer, score)``, the series itself included with 1.
    """
    w = Window.partitionBy("series")
    return matrix.withColumn("threshold", F.least(F.lit(limit), F.percentile("score", F.lit(q)).over(w))).where(
        F.col("score") > F.col("threshold"))


def full_matrix(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both halves and the diagonal of a pair list, as ``(series, peer, score)`` with shares of 1."""
    half = pairs.select(F.col("a").alias("series"), F.col("b").alias("peer"), (F.col("score") / 100).alias("score"))
    other = half.select(F.col("peer").alias("series"), F.col("series").alias("peer"), "score")
    own = half.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], half.schema)
    return half.unionByName(other).unionByName(own)


def crosstab(df: DataFrame, keys: Sequence[str], feature: str, up: Column) -> DataFrame:
    """Counts of a feature value against the sign of the target."""
    return df.groupBy(*keys, feature).agg(F.count_if(~up).alias("down"), F.count_if(up).alias("up"))


def class_counts(df: DataFrame, keys: Sequence[str], col: str, classes: Sequence[str]) -> DataFrame:
    """Counts of each class; absent classes count 0."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(col) == c).alias(c) for c in classes])


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; ``approximate`` keeps one small sketch per column instead of the values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in cols]).unpivot([], list(cols), "column", "n")


def fills_vwap(fills: DataFrame, bucket: Column) -> DataFrame:
    """Filled orders by symbol, type, side and bucket: quantity and quantity-weighted prices."""
    q = F.sum("quantity")
    return fills.where(F.col("status") == "FILLED").groupBy("symbol", "type", "side", bucket.alias("bucket")).agg(
        F.try_divide(F.sum(F.col("price") * F.col("quantity")), q).alias("avg_price"), q.alias("quantity"),
        F.try_divide(F.sum(F.col("stop_price") * F.col("quantity")), q).alias("stop_price"))


def portfolio(balances: DataFrame, prices: DataFrame, wrapped: dict[str, str], least: float = 10.0) -> DataFrame:
    """Total balance per asset (wrapped assets count as their base) valued at the last price; small ones dropped."""
    base = F.col("asset")
    for k, v in wrapped.items():
        base = F.when(F.col("asset") == k, F.lit(v)).otherwise(base)
    total = balances.where(F.col("balance") > 0).groupBy(base.alias("asset")).agg(F.sum("balance").alias("total_balance"))
    valued = total.join(prices, "asset").withColumn("usd_amount", F.abs("total_balance") * F.col("usd_price"))
    return valued.where(F.col("usd_amount") > least).orderBy(F.col("usd_amount").desc())
