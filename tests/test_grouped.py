"""The grouped feature build against plain loops over whole series, and the plan of its joins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import grouped as gr
from barloom.operators.blocks import Grid
from conftest import by_series

KINDS = {"x": "diff", "v": "pct", "z": "pct"}
LAGS, WINDOWS, SPANS = [1, 3, 11], [2, 5], [1, 3, 6]


def filled(values):
    out, last = [], None
    for v in values:
        last = v if v is not None else last
        out.append(last)
    first = next((v for v in out if v is not None), 0.0)
    return [first if v is None else v for v in out]


def plain(values, kind):
    """Every feature of one column of one series."""
    x = filled(values)
    n = len(x)
    out = {"": x}

    def change(i):
        if i < 1 or (kind == "pct" and x[i - 1] == 0):
            return None
        return x[i] - x[i - 1] if kind == "diff" else (x[i] - x[i - 1]) / x[i - 1]

    minus = lambda a, b: None if a is None or b is None else a - b
    r = [change(i) for i in range(n)]
    a = [minus(r[i], r[i - 1] if i else None) for i in range(n)]
    j = [minus(a[i], a[i - 1] if i else None) for i in range(n)]
    out |= {"_return": filled(r), "_acceleration": filled(a), "_jerk": filled(j)}
    out |= {f"_lag_{k}": [x[max(0, i - k)] for i in range(n)] for k in LAGS}
    out |= {f"_lag_{k}": [x[i - k] if i >= k else x[0] for i in range(n)] for k in LAGS}
    for w in WINDOWS:
        part = [x[max(0, i - w + 1):i + 1] for i in range(n)]
        out |= {f"_rolling_{w}_mean": [np.mean(p) for p in part], f"_rolling_{w}_min": [min(p) for p in part], f"_rolling_{w}_max": [max(p) for p in part]}
        out[f"_rolling_{w}_range"] = [max(p) - min(p) for p in part]
        dev = [np.std(p, ddof=1) if len(p) > 1 else None for p in part]
        out[f"_rolling_{w}_std"] = [d if d is not None else np.std(x[:2], ddof=1) if n > 1 else 0.0 for d in dev]
    for s in SPANS:
        y = []
        for v in x:
            y.append(v if not y else y[-1] + 2 / (s + 1) * (v - y[-1]))
        out[f"_ema_{s}"] = y
    return out


@pytest.mark.parametrize(("block", "width"), [(4096, 8), (5, 2), (3, 1)])
def test_every_feature_of_every_column(panel, block, width):
    df = panel.withColumn("z", F.when(F.dayofmonth("ts") == 1, 0.0).otherwise(F.col("v") - 4))
    g = Grid(block=block)
    out = gr.column_features(df, g, KINDS, LAGS, WINDOWS, SPANS, width=width, buckets=3)
    assert out.count() == df.count()
    given = {c: by_series(df, c) for c in KINDS}
    names = [c for c in out.columns if c not in ("series", "ts")]
    assert len(names) == len(set(names)) == len(KINDS) * (4 + len(LAGS) + 5 * len(WINDOWS) + len(SPANS))
    got = by_series(out, *names)
    for c, kind in KINDS.items():
        for s, values in given[c].items():
            for feature, want in plain(values, kind).items():
                mine = [row[names.index(c + feature)] for row in got[s]]
                assert mine == pytest.approx([float(v) for v in want], abs=1e-9), (c, feature, s)
                assert all(v is not None and math.isfinite(v) for v in mine)


def test_groups_meet_without_a_shuffle(spark, panel):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        num = gr.numbered(panel, Grid(block=16), ["x", "v"], 3, [3], 4)
        groups = [gr.bucketed(gr._looks(num, [c], [1], [2], [3]), num.by_block, 4, "group") for c in ("x", "v")]
        with gr._by_some_keys(spark):
            met = gr._met(num, groups)
            plan = met._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert met.count() == panel.count()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
        looks = gr._derived(num, {"x": "diff"})._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Window" in looks and "Exchange" not in looks
        assert "v:double" not in looks.replace(" ", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_and_wrong_input(panel):
    g = Grid()
    assert gr.column_features(panel.limit(0), g, {"x": "diff"}, [1], [2], [3]).count() == 0
    assert gr.column_features(panel, g, {}, [1], [2], [3]).columns == ["series", "ts"]
    with pytest.raises(ValueError):
        gr.column_features(panel, g, {"x": "ratio"}, [1], [2], [3])
