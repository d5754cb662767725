import pytest
from pyspark.sql import functions as F

from barloom.operators.blocks import Grid, ema
from barloom.session import fresh_path
from barloom.streaming import streams as st
from conftest import by_series, hours


def test_ema_state_over_runs_equals_batch(spark):
    rows = [(s, t, 1.0 * i % 7 + k, 9.0, 0.5, (i * 5) % 11 + 1.0) for k, s in enumerate("ab") for i, t in enumerate(hours(30))]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, price double")
    out = fresh_path(spark, "ema")
    cuts = [("2024-01-01", "2024-01-01 09:00:00"), ("2024-01-01 09:00:00", "2024-01-02 01:00:00"), ("2024-01-02 01:00:00", "2024-02-01")]
    parts = [df.where(f"ts >= timestamp_ntz'{a}' and ts < timestamp_ntz'{b}'") for a, b in cuts]
    st.replay(spark, parts, lambda s, c: st.run_append(st.with_state(s, st.EmaState(0.2), "series string, ts timestamp_ntz, ema double, ha_open double"), out, c))
    got = by_series(spark.read.parquet(out), "ema")
    want = by_series(ema(df, Grid(), {"e": (F.col("price"), 0.2)}), "e")
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_repeated_batch_changes_nothing(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(60))], "series string, ts timestamp_ntz, x double")
    path = fresh_path(spark, "revise")
    handle = st.revise(path, Grid(dense=False), 24)
    handle(df.where("x < 40"), 0)
    late = df.where("x >= 30").withColumn("x", F.col("x") + 0.5)
    for _ in range(2):
        handle(late, 1)
        rows = {r.ts: r.x for r in spark.read.parquet(path).collect()}
        assert len(rows) == 60
    assert rows[hours(1, 20)[0]] == 20.0 and rows[hours(1, 35)[0]] == 35.5


def test_appended_batches_cut_inside_a_day(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(48))], "series string, ts timestamp_ntz, x double")
    path, out = fresh_path(spark, "store"), fresh_path(spark, "features")
    handle = st.append_features(path, out, Grid(dense=False), 5, lambda b: b.withColumn("y", F.col("x") * 2))
    parts = [df.where("x < 12"), df.where("x >= 12 and x < 30"), df.where("x >= 30")]
    for i, part in enumerate([*parts, parts[-1]]):  # the last batch is repeated
        handle(part, i)
    for p in (path, out):
        assert sorted(r.x for r in spark.read.parquet(p).collect()) == [float(i) for i in range(48)]


def bars_of(spark, n=60):
    rows = [(s, t, 1.0 * i % 7 + k, 9.0 + i % 3, 0.5, (i * 5) % 11 + 1.0) for k, s in enumerate("ab") for i, t in enumerate(hours(n + k))]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, high double, low double, price double")


def between(df, a, b):
    return df.where(F.col("ts").between(F.lit(hours(1, a)[0]), F.lit(hours(1, b)[0])))


@pytest.mark.parametrize("block", [4096, 7])
def test_carried_averages_take_late_and_repeated_bars(spark, block):
    df = bars_of(spark)
    g = Grid(block=block)
    folder, out = fresh_path(spark, "carry"), fresh_path(spark, "out")
    handle = st.carry_on(folder, out, g, 5 * 3600, *st.ema_step(g, 0.2))
    late = F.col("ts").isin(hours(1, 18) + hours(1, 16))
    batches = [between(df, 0, 19).where(~late), between(df, 20, 40).unionByName(between(df, 0, 19).where(late)), between(df, 30, 99), df.limit(0)]
    for i, b in enumerate(batches):
        for _ in range(2 if i == 1 else 1):  # a repeated batch writes the same
            handle(b, i)
    got, want = spark.read.parquet(out), ema(df, Grid(), {"e": (F.col("price"), 0.2)})
    assert got.count() == df.count()
    a, b = by_series(got, "ema"), by_series(want, "e")
    assert all(a[s] == pytest.approx(b[s], abs=1e-9) for s in b)
    ha = {}
    for r in df.orderBy("series", "ts").collect():
        before = ha.get(r.series)
        ha.setdefault(r.series, []).append(((r.open + r.price) / 2 if before is None else (before[-1][0] + before[-1][1]) / 2, (r.open + r.high + r.low + r.price) / 4))
    assert all(by_series(got, "ha_open")[s] == pytest.approx([x for x, _ in v], abs=1e-9) for s, v in ha.items())


def test_bars_older_than_the_open_ones_are_put_aside(spark):
    df = bars_of(spark)
    folder, out = fresh_path(spark, "carry"), fresh_path(spark, "out")
    handle = st.carry_on(folder, out, Grid(dense=False), 3600, *st.ema_step(Grid(dense=False), 0.2))
    missing = F.col("ts") == F.lit(hours(1, 4)[0])
    handle(between(df, 0, 20).where(~missing), 0)
    handle(df.where(missing), 1)
    handle(between(df, 21, 99), 2)
    assert spark.read.parquet(f"{folder}/late").count() == 2
    got, want = by_series(spark.read.parquet(out), "ema"), by_series(ema(df.where(~missing), Grid(dense=False), {"e": (F.col("price"), 0.2)}), "e")
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_carried_position_equals_a_row_loop(spark):
    import random

    rnd = random.Random(4)
    rules = {"pid": 1, "follow_flow": True, "certainty_threshold": 0.6, "ltp": 0.05, "stp": -0.05, "lsl": -0.05, "ssl": 0.05, "long_permission": True, "short_permission": True,
             "max_leverage": 1.0, "fee": 0.0}
    rows = [(s, t, rnd.uniform(0.5, 0.75), rnd.choice(["long", "short"]), 100.0, 100 + rnd.uniform(0, 8), 100 - rnd.uniform(0, 8)) for s in "ab" for t in hours(80)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, certainty double, kind string, open double, high double, low double")
    folder, out = fresh_path(spark, "position"), fresh_path(spark, "out")
    handle = st.carry_on(folder, out, Grid(block=9), 4 * 3600, *st.position_step(Grid(block=9), rules))
    late = F.col("ts") == F.lit(hours(1, 28)[0])
    for i, b in enumerate([between(df, 0, 30).where(~late), between(df, 31, 31).unionByName(df.where(late)), between(df, 32, 99)]):
        handle(b, i)
    got = by_series(spark.read.parquet(out), "flow", "trading_signal")
    for s in "ab":
        flow, active, stopped, want = None, False, False, []
        for _, _, certainty, kind, o, h, l in [r for r in rows if r[0] == s]:
            sure = certainty > 0.6
            flow = kind if flow is None or sure else flow
            active = sure or (active and not stopped)
            stopped = (h > o * 1.05 or l < o * 0.95)
            want.append((flow, active))
        assert got[s] == want


def test_a_batch_reads_only_the_days_it_needs(spark):
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(hours(24 * 12))], "series string, ts timestamp_ntz, x double")
    path, out = fresh_path(spark, "store"), fresh_path(spark, "features")
    seen = []

    def build(rows):
        seen.append(rows.where("not _new").agg(F.min("ts"), F.count("*")).first())
        return rows.withColumn("y", F.col("x") * 2)
    g = Grid(dense=False)
    handle = st.append_features(path, out, g, 30, build)
    for i, (a, b) in enumerate([(0, 240), (240, 250), (245, 288), (245, 288)]):  # bars handed in again, and a repeated batch
        handle(df.where(f"x >= {a} and x < {b}"), i)
    assert [n for _, n in seen] == [0, 30, 30, 30]
    assert [seen[1][0], seen[2][0], seen[3][0]] == [hours(1, 210)[0], hours(1, 215)[0], hours(1, 215)[0]]
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [float(i) for i in range(288)]
    needed = st._needed_days(st.stored(spark, path + "-days", spark.read.parquet(path + "-days").select("series", "n").schema), df.where("x >= 280"), g, 30)
    assert needed.first()["_from"] == "2024-01-11"
    # the days before are not opened: broken files there are not met
    import glob
    for f in glob.glob(f"{path}/day=2024-01-0[1-5]/*.parquet"):
        open(f, "wb").write(b"broken")
    handle(df.where("x >= 280"), 5)


def test_stored_models_and_scored_bars(spark):
    import numpy as np
    from barloom.operators import models as ml

    rnd = np.random.default_rng(1)
    rows = [(s, t, float(o := 10 + rnd.normal()), float(o + rnd.normal()), float(rnd.normal())) for s in "ab" for t in hours(90)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, open double, price double, ret double")
    build = lambda m: m.withColumns({"x1": F.col("ret"), "x2": F.col("price") - F.col("open")})
    train = spark.createDataFrame([(s, t, float(v[0]), float(v[1]), float(2 + 3 * v[0] - v[1] + 0.1 * rnd.normal())) for s in "ab" for t, v in zip(hours(70), rnd.normal(size=(70, 2)))],
                                  "series string, ts timestamp_ntz, x1 double, x2 double, y double")
    state = ml.fit_state(train, ["series"], ["x1", "x2"], "y")
    for m in state.collect():
        x = np.array([(r.x1, r.x2) for r in train.where(F.col("series") == m.series).collect()])
        y = np.array([r.y for r in train.where(F.col("series") == m.series).collect()])
        want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
        coef = np.array(m["coef"]) / np.array(m["scale"])
        assert coef == pytest.approx(want[1:]) and m["intercept"] - (coef * np.array(m["mean"])).sum() == pytest.approx(want[0])
    store = ml.Versions(spark, fresh_path(spark, "models"))
    with pytest.raises(LookupError):
        store.get()
    assert store.put(state, "one") == 1
    state.withColumn("intercept", F.lit(99.0)).write.parquet(f"{store.path}/version=2")  # a run that broke off before its line
    assert store.get()[0] == 1
    rules = {"pid": 1, "follow_flow": True, "certainty_threshold": 0.55, "ltp": 0.01, "stp": -0.01, "lsl": -0.01, "ssl": 0.01, "long_permission": True, "short_permission": True,
             "max_leverage": 3.0, "fee": 0.0}
    g, out, tails = Grid(), fresh_path(spark, "scored"), fresh_path(spark, "tails")
    handle = st.score_newest(store, tails, out, g, ["open", "price", "ret"], 5, build, ["x1", "x2"], rules)
    handle(between(df, 0, 40), 0)
    assert store.put(state.withColumn("intercept", F.col("intercept") + 1), "two") == 2
    handle(between(df, 41, 41), 1)      # one bar, history from the tail
    handle(between(df, 30, 30), 2)      # a late bar moves nothing on
    handle(between(df, 41, 41), 1)      # a repeated batch
    got = {(r.series, r.ts): r for r in spark.read.parquet(out).collect()}
    assert set(got) == {(s, hours(1, i)[0]) for s in "ab" for i in (41, 42)}
    assert {r.version for (_, t), r in got.items() if t == hours(1, 41)[0]} == {1} and {r.version for (_, t), r in got.items() if t == hours(1, 42)[0]} == {2}
    for (s, t), r in got.items():
        m = next(x for x in state.collect() if x.series == s)
        last = next(x for x in rows if x[0] == s and x[1] == t - (hours(2)[1] - hours(1)[0]))
        z = (np.array([last[4], last[3] - last[2]]) - np.array(m["mean"])) / np.array(m["scale"])
        assert r.return_forecast == pytest.approx(m["intercept"] + (z * np.array(m["coef"])).sum() + (r.version - 1))
        side = 1 if r.kind == "long" else -1
        assert r.tp_price == pytest.approx(last[3] * (1 + side * 0.01))


def test_a_key_without_rows_enough_and_a_constant_feature(spark):
    from barloom.operators import models as ml

    rows = [("a", float(i), 1.0, 2.0 * i) for i in range(40)] + [("b", 1.0, 1.0, 1.0)] * 3 + [("a", None, 1.0, 5.0), ("a", float("nan"), 1.0, 5.0)]
    df = spark.createDataFrame(rows, "series string, u double, v double, y double")
    m = ml.fit_linear(df, ["series"], ["u", "v"], "y").collect()
    assert [r.series for r in m] == ["a"] and m[0]["n"] == 40 and m[0]["coef"][1] == 0
    out = ml.apply_linear(df, ml.fit_linear(df, ["series"], ["u", "v"], "y"), ["series"], ["u", "v"]).collect()
    assert len(out) == 45 and all((r.return_forecast is None) == (r.series == "b") for r in out)
    one = ml.apply_linear(df, ml.fit_linear(df, [], ["u"], "y", least=2), [], ["u"])
    assert one.count() == 45 and one.where("return_forecast is null").count() == 0
