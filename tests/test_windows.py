import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.holidays import is_holiday
from barloom.functions.scalars import normal_cdf, soft_truncate
from barloom.operators import windows as win
from barloom.operators.blocks import Grid
from conftest import by_series, hours


def trend_loop(codes):
    state = [0]
    for i in range(1, len(codes)):
        c, p, s = codes[i], codes[i - 1], state[-1]
        if s == 0:
            s = 1 if c == 1 or (c == p == 3) else 2 if (c == p == 4) or c == 5 else 0
        elif s == 1:
            s = 0 if c == 0 or (c == p == 2) else 2 if (c == p == 5) or c == 4 else 1
        else:
            s = 0 if c == 0 or (c == p == 2) else 1 if c == 1 or (c == p == 3) else 2
        state.append(s)
    return state


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_trend_state(spark, block):
    rnd = random.Random(3)
    series = {f"s{k}": [rnd.choice([0, 1, 2, 3, 4, 5][k % 3:]) for _ in range(40 + k)] for k in range(8)}
    series["single"] = [5]
    rows = [(s, t, c) for s, cs in series.items() for t, c in zip(hours(len(cs)), cs)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, ha_code int")
    assert by_series(win.trend_state(df, Grid(block=block)), "trend") == {s: trend_loop(cs) for s, cs in series.items()}


@pytest.mark.parametrize("block", [4, 4096])
def test_heikin_ashi_open(spark, block):
    rnd = random.Random(9)
    bars = [[rnd.uniform(1, 5) for _ in range(4)] for _ in range(30)]
    rows = [("a", t, b[0], max(b), min(b), b[3]) for t, b in zip(hours(30), bars)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, price double")
    want, before = [], None
    for _, _, o, h, l, p in rows:
        a = (o + p) / 2 if before is None else (before[0] + before[1]) / 2
        want.append(a)
        before = (a, (o + h + l + p) / 4)
    assert by_series(win.heikin_ashi(df, Grid(block=block)), "ha_open")["a"] == pytest.approx(want)


def test_publication_shift_caps(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(6))], "series string, ts timestamp_ntz, x double")
    assert by_series(win.publication_shift(df, Grid(), {"x": 9}, max_shift=2), "x")["a"] == [0, 0, 0, 1, 2, 3]


def test_weighted_average_order(spark):
    df = spark.createDataFrame([("a", t, float(i * i)) for i, t in enumerate(hours(5))], "series string, ts timestamp_ntz, y double")
    old = by_series(win.naive_weighted_ma(df, Grid(), "y", 2), "forecast")["a"][3]
    new = by_series(win.naive_weighted_ma(df, Grid(), "y", 2, newest_first=True), "forecast")["a"][3]
    assert old == pytest.approx((1 * 1.0 + 0.5 * 4.0) / 1.5) and new == pytest.approx((0.5 * 1.0 + 1 * 4.0) / 1.5)


def test_holidays(spark):
    days = {"2021-12-31": True, "2022-01-01": True, "2022-06-20": True, "2020-06-19": False, "2023-11-23": True, "2023-05-29": True,
            "2023-05-22": False, "2024-07-04": True, "2024-07-05": False, "2023-11-10": True, "2024-10-14": True}
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d), want) for d, want in days.items()], "ts timestamp_ntz, want boolean")
    assert df.where(is_holiday("ts") != F.col("want")).count() == 0


def test_normal_cdf_tails(spark):
    from statistics import NormalDist
    xs = [-40.0, -9.0, -7.2, -3.0, -0.1, 0.0, 0.7, 5.0, 8.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert p == pytest.approx(NormalDist().cdf(x), rel=1e-6, abs=1e-15)


def test_soft_truncate(spark):
    df = spark.createDataFrame([(-4.0,), (1.0,), (8.0,)], "x double").select(soft_truncate(F.col("x"), F.lit(0.0), F.lit(4.0)).alias("y"))
    assert [r.y for r in df.collect()] == [-1.0, 1.0, 5.0]


@pytest.mark.parametrize("block", [2, 4096])
def test_deviation_is_filled_past_nulls(spark, block):
    rows = [("a", t, v) for t, v in zip(hours(6), [1.0, None, None, 4.0, 6.0, 6.0])]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, x double")
    got = {r.ts: (r.x_std_2, r.x_std_4) for r in win.rolling_stats(df, Grid(block=block), ["x"], [2, 4]).collect()}
    two = [got[t][0] for t in hours(6)]
    four = [got[t][1] for t in hours(6)]
    assert two == pytest.approx([2**0.5] * 5 + [0.0])
    assert four[:4] == pytest.approx([4.5**0.5] * 4)
