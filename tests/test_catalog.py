"""Catalog: contract of the entry module and a sample of queries against their oracle on the smallest data.

``check.py`` compares all of them; the sample here touches every catalog module.
"""

import os

import pytest

import __spark_entry__ as entry
from barloom.plans import CATALOG
from check import compare, duck

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "rolling_stats", "ema_features", "rsi", "interpolate_linear", "resample_ohlcv", "series_quantiles", "snapshot_self_join", "overlap_merge",
    "fills_vwap", "write_overwrite_partitions", "dq_report", "repair_table", "candle_type", "null_flat_runs", "backtest_table", "trade_metrics",
    "train_val_test_split", "chi2_categorical", "promote_stages", "stream_tumbling_bars",
]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    q, o = {k: q[k] for k in CATALOG}, {k: v for k, v in o.items() if k in CATALOG}
    assert len(q) == 230
    assert sorted(set(q) - set(o)) == ["boosted_tree_forecast", "boruta_select", "feature_importance", "panel_tree_forecast", "pca_95", "rfe_select", "select_panel", "series_tree_forecast", "walk_forward"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["series", "ts"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("key", SAMPLE)
def test_against_oracle(spark, key):
    ok, note = compare(spark, duck(FOLDER), key, FOLDER)
    assert ok, note


def test_plans_stay_off_python_and_nested_loops(spark):
    for key in ("rolling_stats", "ema_features", "lag_features", "resample_ohlcv", "backtest_table", "dq_report", "parameter_cross_join"):
        plan = CATALOG[key].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (key, bad)
