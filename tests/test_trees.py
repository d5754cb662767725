"""Trees of many series grown from histograms, against the same trees grown row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import trees as tr
from barloom.operators.blocks import Grid
from conftest import hours

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    out = []
    for s, n, sign in (("up", 300, 1), ("down", 260, -1), ("tiny", 3, 1), ("none", 4, 0)):
        for i, t in enumerate(hours(n)):
            a, b, c = rnd.normal(size=3)
            y = sign * (3 * (a > 0.2) + b) + 0.1 * rnd.normal()
            out.append((s, t, None if s == "none" else float(y), float(a), float(round(b, 1)), None if i % 7 == 0 else float("inf") if i % 11 == 0 else float(c)))
    return spark.createDataFrame(out, "series string, ts timestamp_ntz, y double, a double, b double, c double").repartition(5).cache()


def plain_tree(x, y, w, cuts, tree, depth, seed, boosted):
    """Recursive growth on rows; bins as cut points."""
    bins = tr.bins_of(x, cuts)
    nodes = {}

    def grow(node, own, level):
        mean = (w[own] * y[own]).sum() / w[own].sum()
        nodes[node] = (-1, 0, mean)
        if level == depth:
            return
        allowed = range(x.shape[1]) if boosted else tr.tried(seed, tree, node, x.shape[1])
        best = None
        for f in allowed:
            for b in range(31):
                lo = own[bins[own, f] <= b]
                hi = own[bins[own, f] > b]
                if w[lo].sum() <= 0 or w[hi].sum() <= 0:
                    continue
                part = lambda r: (w[r] * y[r]).sum() ** 2 / w[r].sum()
                gain = round(part(lo) + part(hi) - part(own), 8)
                if gain > 1e-8 and (best is None or gain > best[0]):
                    best = (gain, f, b, lo, hi)
        if best:
            nodes[node] = (best[1], best[2], mean)
            grow(2 * node, best[3], level + 1)
            grow(2 * node + 1, best[4], level + 1)

    grow(1, np.flatnonzero(w > 0), 0)

    def value(i):
        n = 1
        while nodes[n][0] >= 0:
            n = 2 * n + (bins[i, nodes[n][0]] > nodes[n][1])
        return nodes[n][2]
    return np.array([value(i) for i in range(len(x))])


@pytest.mark.parametrize(("algorithm", "per_series"), [("random_forest", True), ("random_forest", False), ("boosted_trees", True)])
def test_trees_equal_row_by_row_growth(rows, algorithm, per_series):
    boosted = algorithm == "boosted_trees"
    trees, depth, rate = (3, 2, 0.1) if boosted else (4, 3, 0.1)
    g = Grid()
    fitted = tr.fit_trees(rows, g, FEATURES, "y", g.keys if per_series else (), algorithm, trees, depth)
    out = tr.tree_forecast(fitted, rows, g)
    assert out.columns == [*rows.columns, "forecast"] and out.count() == rows.count()
    got = {(r.series, r.ts): r.forecast for r in out.collect()}
    packs = tr.pack(rows, g, ["series"] if per_series else [tr.ALL], FEATURES, "y").collect()
    models = {m["series"] if per_series else 1: m for m in fitted.model.collect()}
    assert set(models) == ({"up", "down", "tiny"} if per_series else {1})
    for key, m in models.items():
        mine = [p for p in packs if (p["series"] if per_series else p[tr.ALL]) == key]
        x, y = np.concatenate([np.array(p["x"]).reshape(-1, 3) for p in mine]), np.concatenate([p["y"] for p in mine])
        draws = np.concatenate([np.array(p["row"], np.int64) for p in mine]).view(np.uint64)
        if boosted:
            want = np.full(len(y), np.mean(y))
            for t in range(trees):
                want = want + rate * plain_tree(x, y - want, np.ones(len(y)), m["cuts"], t, depth, 7, True)
        else:
            want = np.mean([plain_tree(x, y, tr.bag_weights(7, t, draws), m["cuts"], t, depth, 7, False) for t in range(trees)], axis=0)
        know = {tuple(np.nan_to_num(v, nan=9e9, posinf=9e9)): w for v, w in zip(x, want)}
        for r in rows.where("y is not null").collect():
            if not per_series or r.series == key:
                v = tuple(np.nan_to_num(np.array([np.nan if r[f] is None else r[f] for f in FEATURES], float), nan=9e9, posinf=9e9))
                assert got[r.series, r.ts] == pytest.approx(know[v], abs=1e-9)
    if per_series:
        assert all(v is None for (s, _), v in got.items() if s == "none")


def test_a_model_per_series_tells_series_apart(rows):
    g = Grid()
    error = {}
    for per_series in (True, False):
        out = tr.tree_forecast(tr.fit_trees(rows, g, FEATURES, "y", g.keys if per_series else ()), rows.where("series in ('up', 'down')"), g)
        error[per_series] = out.agg(F.avg(F.abs(F.col("y") - F.col("forecast")))).first()[0]
    assert error[True] < 0.7 < error[False]


def test_trees_repeat_and_take_empty_tables(rows):
    g = Grid()
    one = tr.fit_trees(rows, g, FEATURES, "y", g.keys, trees=3, depth=2)
    two = tr.fit_trees(rows.repartition(2), g, FEATURES, "y", g.keys, trees=3, depth=2)
    key = lambda f: {m["series"]: bytes(m["nodes"]) for m in f.model.collect()}
    assert key(one) == key(two)
    assert tr.tree_forecast(one, rows.limit(0), g).count() == 0
    none = tr.fit_trees(rows.limit(0), g, FEATURES, "y", g.keys, trees=3, depth=2)
    assert none.model.count() == 0 and tr.tree_forecast(none, rows, g).where("forecast is not null").count() == 0
    with pytest.raises(ValueError):
        tr.fit_trees(rows, g, FEATURES, "y", algorithm="other")


def test_bag_weights_look_poisson():
    w = tr.bag_weights(3, 1, np.arange(200_000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert len(tr.tried(3, 1, 5, 10)) == 3 and len(tr.tried(3, 1, 5, 1)) == 1
