"""The back-test plan against a row-by-row loop."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators.blocks import Grid
from conftest import hours

BASE = {"follow_flow": True, "certainty_threshold": 0.6, "ltp": None, "stp": None, "lsl": None, "ssl": None, "long_permission": True,
        "short_permission": True, "max_leverage": 2.0, "fee": -0.001}
SETS = [
    {**BASE, "pid": 1, "ltp": 0.01, "stp": -0.01, "lsl": -0.008, "ssl": 0.008},
    {**BASE, "pid": 2, "follow_flow": False, "lsl": -0.008, "ssl": 0.008},
    {**BASE, "pid": 3, "short_permission": False, "ltp": 0.004, "stp": -0.004},
    {**BASE, "pid": 4, "follow_flow": False, "long_permission": False, "certainty_threshold": 0.99},
]


def loop(rows, p):
    """One series, one parameter set: rows of (certainty, kind, open, high, low, price)."""
    out, flow, raw, stopped, prev, cum = [], None, False, False, None, 1.0
    for c, kind, o, h, l, price in rows:
        sure = c > p["certainty_threshold"]
        flow = kind if flow is None or sure else flow
        side = flow if p["follow_flow"] else kind
        long = side == "long"
        tp = o * (1 + (p["ltp"] if long else p["stp"])) if p["ltp"] is not None else None
        sl = o * (1 + (p["lsl"] if long else p["ssl"])) if p["lsl"] is not None else None
        tp_hit = tp is not None and (h > tp if long else l < tp)
        sl_hit = sl is not None and (l < sl if long else h > sl)
        raw = sure or (p["follow_flow"] and raw and not stopped)
        stopped = tp_hit or sl_hit
        active = raw and p["long_permission" if long else "short_permission"]
        exposure = max(0.5, min(1.0, math.log(100 * c - 49) / math.log(41) + 0.1)) if active else 0.0
        lev = p["max_leverage"] if c > 0.9 else 1.0
        was = prev is not None and prev["active"]
        if active:
            if was and prev["side"] == side:
                fee = p["fee"] * abs(exposure - prev["exposure"]) * lev
            else:
                fee = p["fee"] * exposure * lev + (p["fee"] * prev["exposure"] * prev["lev"] if was else 0.0)
            fee += p["fee"] * exposure * lev if stopped else 0.0
        else:
            fee = p["fee"] * prev["exposure"] * prev["lev"] if was else 0.0
        end = o if tp_hit and sl_hit else tp if tp_hit else sl if sl_hit else price
        ret = (end - o) / o * exposure * lev * (1 if long else -1) if active else 0.0
        cum *= 1 + ret + fee
        prev = {"active": active, "side": side, "exposure": exposure, "lev": lev}
        out.append((flow, active, fee, ret + fee, cum - 1))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rnd = random.Random(11)
    rows = []
    for s in ("a", "b"):
        for t in hours(90):
            o = rnd.uniform(90, 110)
            r = rnd.gauss(0, 0.01)
            p = o * (1 + r)
            rows.append((s, t, rnd.gauss(0, 0.006) + 0.2 * r, r, o, max(o, p) * (1 + rnd.random() * 0.006), min(o, p) * (1 - rnd.random() * 0.006), p))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, return_forecast double, real_return double, open double, high double, low double, price double").cache()


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_against_loop(bars, block):
    g = Grid(keys=("series", "pid"), block=block)
    fit = bt.fit_normal(bt.residuals(bars), ["series"])
    table = bt.backtest(bt.with_rules(bars, SETS), g, fit, ["series"]).orderBy("series", "pid", "ts").collect()
    params = {r.series: r for r in fit.collect()}
    for s in ("a", "b"):
        d = NormalDist(params[s].loc, params[s].scale)
        for p in SETS:
            rows = [r for r in table if r.series == s and r.pid == p["pid"]]
            feed = []
            for r in rows:
                down = d.cdf(-r.return_forecast)
                feed.append((max(down, 1 - down), "long" if 1 - down >= down else "short", r.open, r.high, r.low, r.price))
            want = loop(feed, p)
            assert [(r.flow, r.trading_signal) for r in rows] == [w[:2] for w in want]
            for name, k in (("fees", 2), ("real_trading_return", 3), ("total_cum_returns", 4)):
                assert [r[name] for r in rows] == pytest.approx([w[k] for w in want], abs=1e-9), (s, p["pid"], name)


def test_best_family_with_all_six(spark):
    rnd = random.Random(4)
    draw = {"norm": lambda: rnd.gauss(1, 2), "uniform": lambda: rnd.uniform(-3, 5), "expon": lambda: 1 + rnd.expovariate(0.5)}
    rows = [(k, f()) for k, f in draw.items() for _ in range(800)]
    df = spark.createDataFrame(rows, "series string, return_residual double")
    out = bt.fit_best(df, ["series"], limit=10.0).collect()
    assert {r.family for r in out} == set(bt.FAMILIES)
    best = {r.series: r.family for r in out if r.best}
    # A symmetric beta can look like a normal, and a flat beta like a uniform; the family must be close.
    assert best["norm"] in ("norm", "beta", "gamma", "lognorm") and best["uniform"] in ("uniform", "beta") and best["expon"] in ("expon", "gamma", "beta")
    close = {(r.series, r.family): r.distance for r in out}
    assert close["norm", "norm"] < 0.05 and close["uniform", "uniform"] < 0.05 and close["expon", "expon"] < 0.05
    assert close["uniform", "norm"] > close["uniform", "uniform"]


def test_extend_equals_whole(bars):
    g = Grid(keys=("series", "pid"), block=16)
    cut = F.expr("ts < timestamp_ntz'2024-01-03'")
    fit = bt.fit_normal(bt.residuals(bars.where(cut)), ["series"])
    both = bt.with_rules(bars, SETS[:1])
    whole = bt.backtest(both, g, fit, ["series"]).orderBy("series", "ts").collect()
    grown = bt.extend(both.where(cut), both.where(~cut), g, fit, ["series"]).orderBy("series", "ts").collect()
    assert [r.total_cum_returns for r in whole] == [r.total_cum_returns for r in grown]


def test_too_few_rows_give_no_fit(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "series string, return_residual double")
    assert bt.fit_normal(df, ["series"]).first()["loc"] is None


def test_threshold_search_equals_a_back_test_per_candidate(spark):
    """Hot, short and broken series; smoothed and plain averages."""
    import random

    from barloom.operators import aggregate as ag

    rnd = random.Random(8)
    rows = []
    for s, n in (("hot", 500), ("cold", 60)):
        for t in hours(n):
            o = 100 + rnd.random()
            r = rnd.gauss(0, 0.01)
            hi, lo = max(0.0, r) + abs(rnd.gauss(0, 0.004)), min(0.0, r) - abs(rnd.gauss(0, 0.004))
            rows.append((s, t, r * 0.3 + rnd.gauss(0, 0.01), r, o, o * (1 + hi), o * (1 + lo), o * (1 + r)))
    for k in (5, 70, 90):  # moves past the far exit of the other side, and an open of nothing
        s, t, f, r, o, hi, lo, p = rows[k]
        rows[k] = (s, t, f, r, o, o * 2.5, o * 0.05, p) if k != 90 else (s, t, f, r, o, o, o, p)
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, return_forecast double, real_return double, open double, high double, low double, price double").repartition(3)
    base = {"pid": 0, "follow_flow": False, "certainty_threshold": 0.55, "ltp": None, "stp": None, "lsl": None, "ssl": None, "long_permission": True, "short_permission": True,
            "max_leverage": 2.0, "fee": -0.0004}
    g = Grid()
    pairs = {"ltp": "stp", "stp": "ltp", "lsl": "ssl", "ssl": "lsl"}
    cands = {(c["series"], c["field"]): [(x["q"], x["v"]) for x in c["cands"]] for c in bt.stop_candidates(df, ["series"]).collect()}
    assert {k: len(v) for k, v in cands.items() if k[0] == "hot"} == {("hot", "ltp"): 29, ("hot", "stp"): 29, ("hot", "lsl"): 14, ("hot", "ssl"): 14}
    fit = bt.fit_normal(bt.residuals(df), ["series"])
    for smooth in (True, False):
        got = {(r["series"], r["field"]): r for r in bt.threshold_search(df, g, base, smooth_returns=smooth).collect()}
        assert set(got) == set(cands)
        for (s, field), grid in cands.items():
            spec = bt.STOP_FIELDS[field]
            sets = [{**base, "pid": i, field: v, pairs[field]: spec.other} for i, (_, v) in enumerate(grid)]
            table = bt.backtest(bt.with_rules(df.where(F.col("series") == s), sets), Grid(keys=("series", "pid")), fit, ["series"])
            each = {}
            for r in table.where("trading_signal").collect():
                each.setdefault(r["pid"], []).append((r["real_trading_return"], r["tp_triggered"] or r["sl_triggered"]))
            score = []
            for i, (q, v) in enumerate(grid):
                x = np.array([e[0] for e in each[i]])
                if smooth:
                    m, d = x.mean(), x.std(ddof=1)
                    x = np.where(x > m + 1.96 * d, m + 1.96 * d + 0.4 * (x - m - 1.96 * d), np.where(x < m - 1.96 * d, m - 1.96 * d - 0.4 * (m - 1.96 * d - x), x))
                score.append((round(x.mean(), 12), -q, v, sum(e[1] for e in each[i])))
            best = max(score)
            r = got[s, field]
            assert (r["q"], r["value"]) == (-best[1], best[2])
            assert r["avg_real_trading_return"] == pytest.approx(best[0], abs=1e-11)
            assert r["triggers"] == pytest.approx(best[3] / (500 if s == "hot" else 60))
    with pytest.raises(ValueError):
        bt.threshold_search(df, g, {**base, "follow_flow": True})
