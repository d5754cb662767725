"""Blocked operators give what a plain loop gives, whatever the block size."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import windows as win
from barloom.operators.bars import gap_fill, missing_bars
from barloom.operators.blocks import Grid, bounded, ema, frame, row_numbers, running
from conftest import by_series

BLOCKS = [1, 2, 5, 4096]


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        assert len(a[k]) == len(b[k]), k
        for x, y in zip(a[k], b[k]):
            if x is None or y is None:
                assert x is None and y is None, (k, a[k], b[k])
            else:
                assert x == pytest.approx(y, abs=tol, rel=tol), (k, x, y)


@pytest.mark.parametrize("block", BLOCKS)
def test_running_kinds(panel, block):
    got = running(panel, Grid(block=block), {
        "l": ("last", F.col("x")), "b": ("last_before", F.col("x")), "n": ("next", F.col("x")), "s": ("sum", F.col("x")),
        "c": ("count", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))})
    want = {k: {} for k in "l b n s c lo hi".split()}
    for s, xs in by_series(panel, "x").items():
        at = lambda i: [v for v in xs[:i + 1] if v is not None]
        want["l"][s] = [(at(i) or [None])[-1] for i in range(len(xs))]
        want["b"][s] = [(at(i - 1) or [None])[-1] if i else None for i in range(len(xs))]
        want["n"][s] = [next((v for v in xs[i:] if v is not None), None) for i in range(len(xs))]
        want["s"][s] = [sum(at(i)) if at(i) else None for i in range(len(xs))]
        want["c"][s] = [len(at(i)) for i in range(len(xs))]
        want["lo"][s] = [min(at(i), default=None) for i in range(len(xs))]
        want["hi"][s] = [max(at(i), default=None) for i in range(len(xs))]
    for k in want:
        close(by_series(got, k), want[k])


@pytest.mark.parametrize("block", BLOCKS)
def test_bounded_halo(panel, block):
    got = bounded(panel, Grid(block=block), lambda w: {
        "p": F.lag("v", 3).over(w), "q": F.lead("v", 2).over(w), "m": F.sum("v").over(frame(w, 4))}, back=3, ahead=2)
    v = by_series(panel, "v")
    close(by_series(got, "p"), {s: [xs[i - 3] if i >= 3 else None for i in range(len(xs))] for s, xs in v.items()})
    close(by_series(got, "q"), {s: [xs[i + 2] if i + 2 < len(xs) else None for i in range(len(xs))] for s, xs in v.items()})
    close(by_series(got, "m"), {s: [sum(xs[max(0, i - 3):i + 1]) for i in range(len(xs))] for s, xs in v.items()})


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.5, 2 / 25, 0.001])
def test_ema(panel, block, alpha):
    got = ema(panel, Grid(block=block), {"e": (F.col("v"), alpha)})
    want = {s: list(pd.Series(xs).ewm(alpha=alpha, adjust=False).mean()) for s, xs in by_series(panel, "v").items()}
    close(by_series(got, "e"), want)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_positions_on_gappy_rows(panel, block):
    g = Grid(block=block, dense=False)
    thin = panel.where("x is not null")
    got = row_numbers(thin, g, "rn", "n")
    xs = by_series(thin, "x")
    assert by_series(got, "rn", "n") == {s: [(i + 1, len(v)) for i in range(len(v))] for s, v in xs.items()}
    lagged = bounded(thin, g, lambda w: {"p": F.lag("x", 2).over(w)}, back=2)
    close(by_series(lagged, "p"), {s: [v[i - 2] if i >= 2 else None for i in range(len(v))] for s, v in xs.items()})


@pytest.mark.parametrize("block", [2, 4096])
def test_interpolate_matches_pandas(panel, block):
    got = by_series(win.interpolate(panel, Grid(block=block), ["x"]), "x")
    for s, xs in by_series(panel, "x").items():
        want = pd.Series(xs, dtype=float).interpolate("linear")
        close({s: got[s]}, {s: [None if math.isnan(v) else v for v in want]})


@pytest.mark.parametrize("rows", [3, 65, 70])
@pytest.mark.parametrize("block", [7, 4096])
def test_rolling_extremes(panel, rows, block):
    got = win.rolling_extremes(panel, Grid(block=block), rows, {"lo": ("min", "v"), "hi": ("max", "v")})
    v = by_series(panel, "v")
    close(by_series(got, "lo"), {s: [min(xs[max(0, i - rows + 1):i + 1]) for i in range(len(xs))] for s, xs in v.items()})
    close(by_series(got, "hi"), {s: [max(xs[max(0, i - rows + 1):i + 1]) for i in range(len(xs))] for s, xs in v.items()})


@pytest.mark.parametrize("block", [4, 4096])
def test_gap_fill_and_missing(panel, block):
    g = Grid(block=block)
    thin = panel.where("x is not null")
    full, gone = gap_fill(thin, g), missing_bars(thin, g)
    spans = {s: v for s, v in by_series(thin, "ts").items()}
    for s, ts in by_series(full, "ts").items():
        assert len(ts) == (spans[s][-1] - spans[s][0]).total_seconds() / 3600 + 1
    assert gone.count() == full.count() - thin.count()
    assert full.where("x is null").count() == gone.count()


def test_cumulative_return_signs(spark):
    import datetime as dt
    rs = [0.1, -0.5, -2.5, 0.3, -1.7, -1.0, 0.4]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, i), r) for i, r in enumerate(rs)], "series string, ts timestamp_ntz, r double")
    want, p = [], 1.0
    for r in rs:
        p *= 1 + r
        want.append(p - 1)
    for block in (2, 4096):
        close(by_series(win.cumulative_return(df, Grid(block=block), "r"), "cum_ret"), {"a": want})
