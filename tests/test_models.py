"""Selection, transforms, forecasts: where SQL has no say, small fixtures with a known answer."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import forecast as fc, select as se, transform as tr
from barloom.operators.blocks import Grid
from conftest import hours


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    rows = []
    for t in hours(400):
        a, b, c, n = (rnd.gauss(0, 1) for _ in range(4))
        y = 2 * a + 0.3 * n
        rows.append(("s", t, y, a, b, 2 * b + 1e-6 * c, c, 1.0 if a > 0.2 else 0.0))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, a double, b double, b2 double, c double, flag double").cache()


def test_colinear_keeps_first(data):
    assert se.colinear_filter(data, ["b2", "a", "b", "c"]) == ["b2", "a", "c"]


def test_gram_and_pairwise_agree(data):
    from barloom.operators.aggregate import correlation_matrix, dense_correlation_matrix
    key = lambda df: {(r.a, r.b): r.score for r in df.collect()}
    one, two = key(correlation_matrix(data, [], ["a", "b", "c", "y"])), key(dense_correlation_matrix(data, ["a", "b", "c", "y"]))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_rfe_and_relevance_find_the_signal(data):
    # flag is a cut of a, so both carry the signal and b and c go first
    assert set(se.rfe_select(data, ["a", "b", "c", "flag"], "y", 2, step=0.25)) == {"a", "flag"}
    found = [r.feature for r in se.relevance(data, ["a", "b", "c", "flag"], "y").collect()]
    assert set(found[:2]) == {"a", "flag"} and "c" not in found


def test_kendall_against_pairs(data):
    cells = se.joint_counts(data, ["b"], "y", 5)
    got = se.kendall(cells).first()
    rows = [(r.bx, r.by) for r in cells.collect() for _ in range(r.n)]
    s = sum(np.sign(x1 - x2) * np.sign(y1 - y2) for (x1, y1), (x2, y2) in itertools.combinations(rows, 2))
    n = len(rows)
    ties = lambda k: sum(c * (c - 1) / 2 for c in np.unique([r[k] for r in rows], return_counts=True)[1])
    assert got.tau == pytest.approx(s / np.sqrt((n * (n - 1) / 2 - ties(0)) * (n * (n - 1) / 2 - ties(1))))


def test_select_panel_puts_forced_features_first(data):
    got = se.select_panel(data, ["a", "b", "c", "flag"], "y", ["c", "unknown"], 3, 2, 1, 1)
    assert got[0] == "c" and "a" in got and len(got) <= 3


def test_fdr_steps(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r.feature: r.p_corrected for r in se.fdr(df).collect()}
    assert [got[f"f{i}"] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.9])


def test_shuffle_is_a_permutation_per_column(data):
    out = se.shuffled(data.select("series", "ts", "a", "c"), ["series", "ts"], ["a", "c"], 1).collect()
    assert len(out) == 400
    for f in ("a", "c"):
        assert sorted(r[f] for r in out) == sorted(r[f"shadow_{f}"] for r in out)
    assert abs(np.corrcoef([r.a for r in out], [r.shadow_a for r in out])[0, 1]) < 0.2
    assert sum(r.a == r.shadow_a for r in out) < 20


def test_boruta_accepts_signal(data):
    found = se.boruta_select(data, ["series", "ts"], ["a", "b", "c"], "y", trees=5, depth=3)
    assert found["a"][1] == "accepted" and found["c"][1] != "accepted"


def test_boruta_needs_enough_rounds(data):
    found = se.boruta_select(data, ["series", "ts"], ["a", "c"], "y", rounds=2, trees=5, depth=3)
    assert {d for _, d in found.values()} == {"tentative"}  # two wins have a chance of 1/4


def test_pca_share(data):
    flagged = tr.train_flag(data, Grid())
    cols = ["a", "b", "b2", "c"]
    scaled = tr.scale(flagged, ["series"], cols, tr.moments(flagged, ["series"], cols))
    out = tr.pca(scaled, cols)
    assert [c for c in out.columns if c.startswith("pca_")] == ["pca_0", "pca_1", "pca_2"]


def test_seasonal_period_of_a_wave(spark):
    rows = [("s", t, 10 + 3 * np.sin(2 * np.pi * i / 12) + 0.01 * i) for i, t in enumerate(hours(241))]
    df = spark.createDataFrame([(s, t, float(v)) for s, t, v in rows], "series string, ts timestamp_ntz, x double")
    assert tr.seasonal_period(df, Grid(), "x", 24).first().period == 12


def test_walk_forward_sees_only_the_past(data):
    start = F.expr("ts >= timestamp_ntz'2024-01-15'")
    run = lambda df: {(r.ts, r.batch): r.forecast for r in fc.walk_forward(df, Grid(), ["a", "b"], "y", start, 20, 40, trees=3, depth=3).collect()}
    whole = run(data)
    # Changing targets from the third batch on must leave the first three batches alone.
    cut = sorted(t for t, b in whole if b == 2)[0]
    bent = data.withColumn("y", F.when(F.col("ts") >= F.lit(cut), F.lit(99.0)).otherwise(F.col("y")))
    other = run(bent)
    assert whole.keys() == other.keys()
    assert all(whole[k] == other[k] for k in whole if k[1] <= 2)


def test_panel_forecast_learns(data):
    parts = tr.time_split(data, Grid())
    _, out = fc.fit_predict(parts.where("split = 'train'"), parts.where("split = 'test'"), ["a", "b"], "y", trees=10, depth=5)
    r = out.agg(F.corr("y", "forecast").alias("c"), F.count("*").alias("n")).first()
    assert r.c > 0.9 and r.n == 60


def test_boosted_trees_and_importance(data):
    model, _ = fc.fit_predict(data, data, ["a", "c"], "y", "boosted_trees", trees=3, depth=3)
    top = fc.feature_importance(model, ["a", "c"], data).orderBy("share").collect()
    assert top[0].feature == "a" and top[-1].share == pytest.approx(1.0)


def test_colinear_filter_is_one_rule_for_every_length(spark):
    from barloom.operators.select import colinear_filter

    cols = {f"f{i}": [float((j * (i + 3)) % 17) for j in range(60)] for i in range(45)}
    cols["f1"] = [2.0 * v for v in cols["f0"]]
    cols["f1"][3] = None
    cols["f1"][5] += 0.01
    cols["f44"][10:] = [None] * 50
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    few = colinear_filter(df, list(cols)[:10])
    assert "f1" not in few and colinear_filter(df, list(cols))[:len(few)] == few
    assert colinear_filter(df, list(cols), block=7) == colinear_filter(df, list(cols), block=50)


def test_rows_with_nulls_keep_their_forecast_vector(spark):
    from barloom.operators.forecast import assemble

    df = spark.createDataFrame([(1.0, None), (None, float("nan")), (2.0, 3.0)], "a double, b double")
    assert [r["_x"].toArray().tolist() for r in assemble(df, ["a", "b"]).collect()] == [[1.0, 0.0], [0.0, 0.0], [2.0, 3.0]]


def test_walk_forward_without_future_rows(data):
    out = fc.walk_forward(data, Grid(), ["a"], "y", F.col("ts") > F.lit("2030-01-01").cast("timestamp_ntz"), 24, 48)
    assert out.columns == ["series", "ts", "batch", "y", "forecast"] and out.count() == 0


def test_statistics_are_joined_without_a_shuffle_of_the_rows(spark, data):
    """Rows beyond the broadcast threshold are not exchanged by series, not even in the plan before it is adapted."""
    from barloom.operators import backtest as bt
    from barloom.operators import project as pr
    from barloom.session import stage

    rows = stage(data.withColumn("_train", F.lit(True)).withColumns({"return_forecast": F.col("a"), "loc": F.lit(0.0), "scale": F.lit(1.0)}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        limits = rows.groupBy("series").agg(F.min("a").alias("a_low"), F.max("a").alias("a_high"))
        fit = rows.groupBy("series").agg(F.avg("a").alias("loc"), F.stddev_samp("a").alias("scale"))
        plans = {
            "scale": tr.scale(rows, ["series"], ["a"], tr.moments(rows, ["series"], ["a"])),
            "zscore": pr.zscore_filter(rows, ["series"], "a"),
            "certainty": bt.certainty(rows.drop("loc", "scale"), fit, ["series"]),
            "clip": pr.clip_to(rows, limits, ["series"], ["a"]),
        }
        for name, df in plans.items():
            text = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text, (name, text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pair_correlations_equal_numpy_on_common_rows(spark):
    from barloom.operators.aggregate import pair_correlations

    rnd = np.random.default_rng(3)
    x = rnd.normal(1e6, 1.0, (200, 30))
    x[:, 7] = 3.0
    x[:, 9] = x[:, 8]
    holes = rnd.random(x.shape) < 0.2
    holes[:, 5] = True
    rows = [tuple(None if h else float(v) for v, h in zip(a, b)) for a, b in zip(x, holes)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(30))).repartition(5)
    got = {(r.i, r.j): r.r for r in pair_correlations(df, df.columns, block=4).collect()}
    assert set(got) == set(itertools.combinations(range(30), 2))
    for (i, j), r in got.items():
        both = ~holes[:, i] & ~holes[:, j]
        if both.sum() < 2 or np.ptp(x[both, i]) == 0 or np.ptp(x[both, j]) == 0:
            assert r is None or 5 not in (i, j) and 7 not in (i, j)
        else:
            assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert pair_correlations(df.limit(0), df.columns).where("r is not null").count() == 0


def plain_kendall(x, y):
    s = sum(np.sign(a - b) * np.sign(c - d) for (a, c), (b, d) in itertools.combinations(list(zip(x, y)), 2))
    n = len(x)
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    f = lambda t, g: sum(g(v) for v in t)
    pairs = n * (n - 1)
    tau = s / np.sqrt((pairs / 2 - f(tx, lambda t: t * (t - 1) / 2)) * (pairs / 2 - f(ty, lambda t: t * (t - 1) / 2)))
    var = (pairs * (2 * n + 5) - f(tx, lambda t: t * (t - 1) * (2 * t + 5)) - f(ty, lambda t: t * (t - 1) * (2 * t + 5))) / 18
    var += 2 * f(tx, lambda t: t * (t - 1) / 2) * f(ty, lambda t: t * (t - 1) / 2) / pairs
    var += f(tx, lambda t: t * (t - 1) * (t - 2)) * f(ty, lambda t: t * (t - 1) * (t - 2)) / (9 * pairs * (n - 2))
    return tau, math.erfc(abs(s) / np.sqrt(var) / np.sqrt(2))


@pytest.mark.parametrize("parts", [2, 5, 64])
def test_kendall_counts_every_pair(spark, parts):
    rnd = np.random.default_rng(parts)
    n = 240
    y = rnd.integers(-20, 20, n).astype(float)
    cols = {"many": y + rnd.normal(0, 8, n), "few": np.sign(y) + rnd.integers(0, 2, n), "hot": np.where(rnd.random(n) < 0.5, 3.0, rnd.normal(size=n)), "against": -y, "none": rnd.normal(size=n)}
    rows = [(float(y[i]), *[None if c == "none" and i % 3 == 0 else float("nan") if c == "hot" and i == 5 else float(v[i]) for c, v in cols.items()]) for i in range(n)]
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {r.feature: r for r in se.kendall_exact(df, list(cols), "y", parts).collect()}
    assert set(got) == set(cols)
    for i, c in enumerate(cols):
        known = [(r[i + 1], r[0]) for r in rows if r[0] is not None and r[i + 1] is not None and not math.isnan(r[i + 1])]
        tau, p = plain_kendall(*map(np.array, zip(*known)))
        assert (got[c].n, got[c].tau, got[c].p_value) == (len(known), pytest.approx(tau, abs=1e-12), pytest.approx(p, abs=1e-10))
    assert se.kendall_exact(df.limit(0), ["many"], "y").count() == 0


def test_signed_pairs():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 17, 60):
        x, y, w = rnd.integers(0, 6, n).astype(float), rnd.integers(0, 6, n).astype(float), rnd.integers(1, 4, n)
        want = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * w[i] * w[j] for i, j in itertools.combinations(range(n), 2))
        assert se.signed_pairs(x, y, w) == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_two_sample_distance_at_every_value(spark, parts):
    rnd = np.random.default_rng(7)
    y = np.round(rnd.normal(size=300), 1)
    a, b = rnd.random(300) < 0.3, y > 0.5
    df = spark.createDataFrame([(float(v), float(2 * p + 1), float(q)) for v, p, q in zip(y, a, b)], "y double, a double, b double").repartition(4)
    got = {r.feature: r.distance for r in se.two_sample_ks_exact(df, ["a", "b"], "y", parts).collect()}
    for name, g in (("a", a), ("b", b)):
        want = max(abs((y[g] <= v).mean() - (y[~g] <= v).mean()) for v in y)
        assert got[name] == pytest.approx(want)


def test_boruta_decisions_against_hand_worked_tests():
    p = [0.001, 0.5, 0.02, 0.03]
    assert se.false_discoveries(p, 0.05) == [True, False, True, True] and se.false_discoveries([0.04, 0.9], 0.05) == [False, False]
    # ten rounds, three features: 10 wins of 10 has a chance of 1/1024, 0 wins the same; 9 wins 11/1024 > 0.05 / 10
    assert se.decide({"a": 10, "b": 9, "c": 0}, ["a", "b", "c"], 10, 0.05) == (["a"], ["c"])
    assert se.decide({"a": 4}, ["a"], 4, 0.05) == ([], [])  # 1/16 is no proof


def test_permuted_rows_are_a_bijection(spark):
    df = spark.range(101).select(F.col("id").alias("_row"), F.array(F.col("id").cast("double")).alias("_x"))
    one, two = ({r["_row"]: r["_shadow"][0] for r in se.permuted(df, 101, s).collect()} for s in (1, 2))
    assert sorted(one.values()) == [float(i) for i in range(101)] and one != two and sum(k == v for k, v in one.items()) < 10


def test_a_round_of_shadows_is_one_shuffle_and_each_row_keeps_its_partition(spark):
    from barloom.operators.grouped import bucketed
    df = spark.range(1000).select(F.col("id").alias("_row"), F.array(F.col("id").cast("double")).alias("_x"))
    out = se.permuted(bucketed(df, ["_row"], 4, "vectors"), 1000, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 1
    got = {(r["_row"], r.p, r["_shadow"][0]) for r in out.withColumn("p", F.spark_partition_id()).collect()}
    rnd = random.Random(3)
    a = next(k for k in iter(lambda: rnd.randrange(1, 1000), None) if math.gcd(k, 1000) == 1)
    b = rnd.randrange(1000)
    home = {r["_row"]: r.p for r in df.repartition(4, "_row").withColumn("p", F.spark_partition_id()).collect()}
    assert got == {(i, home[i], float((a * i + b) % 1000)) for i in range(1000)}


def test_boruta_settles_a_signal_early(data):
    # noise beats both shadows in a third of the rounds, which takes more of them to reject
    found = se.boruta_select(data, ["series", "ts"], ["a", "c"], "y", rounds=12, trees=5, depth=3)
    assert found["a"][1] == "accepted" and found["a"][0] < 12 and found["c"][1] != "accepted" and found["c"][0] < 12
    assert se.boruta_select(data.limit(0), ["series", "ts"], ["a"], "y", rounds=3) == {"a": (0, "tentative")}


def test_too_many_values_are_no_categories(spark):
    df = spark.range(30).selectExpr("cast(id as string) as c", "id % 2 as d")
    assert {k: len(v) for k, v in tr.categories(df, ["c", "d"]).items()} == {"c": 30, "d": 2}
    with pytest.raises(ValueError):
        tr.categories(df, ["c", "d"], most=31)
