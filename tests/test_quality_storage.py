import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import aggregate as ag, quality as dq, sets
from barloom.operators.blocks import Grid
from barloom.session import fresh_path
from barloom.sources import storage
from conftest import hours


@pytest.mark.parametrize("column,day,want", [
    ("year_month", (2024, 3, 20), {"2024_3", "2024_2"}), ("year_month", (2024, 1, 5), {"2024_1", "2023_12", "2023_11"}),
    ("year_month", (2024, 2, 13), {"2024_2", "2024_1", "2023_12"}), ("year_bimester", (2024, 1, 20), {"2024_1", "2023_6"}),
    ("year_bimester", (2024, 4, 20), {"2024_2"}), ("year_bimester", (2024, 4, 3), {"2024_2", "2024_1"}),
    ("year_quarter", (2024, 1, 31), {"2024_1", "2023_4"}), ("year_quarter", (2024, 2, 20), {"2024_1"}),
    ("year_quarter", (2024, 5, 2), {"2024_2", "2024_1"}), ("year_quarter", (2024, 6, 2), {"2024_2"}),
])
def test_recent_partitions(column, day, want):
    assert set(storage.recent_partitions(column, dt.date(*day))) == want


def test_pruning_reaches_the_scan(spark):
    path = fresh_path(spark, "t")
    rows = [("a", dt.datetime(2024, m, 2), float(m)) for m in range(1, 7)]
    storage.write_partitioned(spark.createDataFrame(rows, "series string, ts timestamp_ntz, x double"), path)
    df = storage.read_recent(spark, path, "year_month", dt.date(2024, 5, 20), [("x", ">", 4.5)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year_month" in plan and "GreaterThan(x,4.5)" in plan
    assert [r.x for r in df.collect()] == [5.0]


def test_latest_rows_checks_span(spark):
    short = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1)], "series string, ts timestamp_ntz, load int")
    with pytest.raises(ValueError):
        storage.latest_rows(short, ["series", "ts"], "load")


def test_report_override_and_rollup(spark):
    df = spark.createDataFrame([("a", t, 5.0) for t in hours(4)] + [("b", t, 50.0) for t in hours(4)], "series string, ts timestamp_ntz, x double")
    rules = {"max": {"x": 10.0}, "expected_rows": 4}
    needs = lambda rows: {r.series: r.needs_repair for r in dq.needs_repair(rows, ["series"]).collect()}
    assert needs(dq.report(df, Grid(), rules)) == {"a": False, "b": True}
    assert needs(dq.report(df, Grid(), rules, {"max": {"x": 60.0}})) == {"a": False, "b": False}


def test_negative_check_fires(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 2.0)], "series string, x double")
    r = dq.negatives(df, ["series"], ["x"]).first()
    assert r.value == 1 and r.failed


@pytest.mark.parametrize("parts", [2, 64])
def test_exact_quantiles_with_a_hot_key(spark, parts):
    import numpy as np
    rng = np.random.default_rng(1)
    hot, cold = np.round(rng.normal(0, 1, 4000), 2), np.array([3.0, 1.0])
    df = spark.createDataFrame([("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", None)], "k string, x double")
    qs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {r.k: r.quantiles for r in ag.exact_quantiles(df, ["k"], "x", qs, parts).collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(hot, qs))) and got["cold"] == pytest.approx(list(np.quantile(cold, qs)))


@pytest.mark.parametrize("accuracy", [4, 1000])
def test_only_values_near_the_wanted_ranks_are_ranked(spark, accuracy):
    import numpy as np
    rng = np.random.default_rng(2)
    some = {"flat": rng.normal(0, 1, 20001), "ties": np.r_[np.zeros(9000), rng.normal(0, 1, 11000)], "two": np.array([1.0, 2.0]), "one": np.array([7.0]), "same": np.full(50, 3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in some.items() for v in vs] + [("one", None), ("null", None)], "k string, x double").repartition(3)
    qs = [0.0, 0.37, 0.5, 1.0]
    near = ag.ranks_near(df, ["k"], "x", qs, accuracy)
    if accuracy == 1000:  # 31001 values of five keys
        assert near.count() < 2000
    rank = {k: np.sort(v) for k, v in some.items()}
    for r in near.collect():
        assert r["_total"] == len(some[r.k]) and (rank[r.k][r["_first"]:r["_last"] + 1] == r["_v"]).all() and (rank[r.k] == r["_v"]).sum() == r["_last"] - r["_first"] + 1
    got = {r.k: r.quantiles for r in ag.exact_quantiles(df, ["k"], "x", qs).collect()}
    assert got.keys() == some.keys() and all(got[k] == pytest.approx(list(np.quantile(v, qs)), abs=1e-12) for k, v in some.items())


def test_imputer_statistics_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "b"), (4.0, None, "a"), (2.0, None, None)], "x double, y double, s string")
    got = {r["column"]: (r.number, r.text) for r in ag.imputer_statistics(df, ["x", "y"], ["s"]).collect()}
    assert got == {"x": (2.0, None), "y": (None, None), "s": (None, "a")}


def test_tail_rows_long_and_short(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(hours(1500))], "series string, ts timestamp_ntz, i int")
    for n in (5, 1200):
        assert sorted(r.i for r in sets.tail_rows(df, Grid(dense=False), n, skip=1).collect()) == list(range(1500 - n, 1499))


def test_quality_of_presence(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert dq.column_presence(df, ["a", "b"], "missing").count() == 0
    assert [r.column for r in dq.column_presence(df, ["a"], "unexpected").collect()] == ["b"]
    assert [r.column for r in dq.duplicate_columns(["a", "b", "a"], df).collect()] == ["a"]


def test_dedup_hot_key_keeps_every_other_row(spark):
    rows = [("hot", 0, i) for i in range(1000)] + [("c", k, 0) for k in range(5)]
    df = spark.createDataFrame(rows, "series string, k int, load int")
    got = {(r.series, r.k): r.load for r in sets.dedup(df, ["series", "k"], F.col("load"), "last").collect()}
    assert len(got) == 6 and got["hot", 0] == 999


def test_combined_panel_refuses_double_keys(spark, panel):
    from barloom.sources.ingest import combined_panel

    y, x = panel.select("series", "ts", "x"), panel.select("series", "ts", "v")
    assert combined_panel(y, x, Grid(dense=False), 1.0, 2.0).count() == panel.count()
    with pytest.raises(ValueError, match="features"):
        combined_panel(y, x.unionByName(x.limit(1)), Grid(dense=False), 1.0, 2.0)
