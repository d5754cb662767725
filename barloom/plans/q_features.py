"""Feature, selection, transform, forecast and leaderboard queries (survey sections 2.11, 2.13 and 2.14)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barloom.operators import backtest as bt, forecast as fc, leaderboard as lb, models as ml, select as se, transform as tr, windows as win
from barloom.operators.aggregate import long_thresholds
from barloom.operators.blocks import bounded
from barloom.operators.features import refine_panel
from barloom.operators.grouped import column_features
from barloom.operators.trees import fit_trees, tree_forecast
from barloom.plans.base import DENSE, HOUR, RET, W, hour_dense, hour_returns, stage_table
from barloom.plans.q_backtest import CERT_SQL, INPUT_SQL, SETS, SWEEP_SQL, bt_sql, measure_sql, swept, t_sql, trading_input
from barloom.plans.q_scalars import CANDLE_SQL, HOLIDAYS, SHAPE_SQL, cdf_sql
from barloom.plans.q_windows import bf, ema_sql, ff, lagged, roll
from barloom.plans.registry import query
from barloom.session import fresh_path, stage

X = ["x_ret", "x_acc", "x_vol", "x_ticks", "x_range", "x_body", "x_copy", "b_up"]
CATS = ["manual_session", "manual_busy"]
_WT = f"OVER ({W})"
FEAT = f"""{RET}, feat AS (SELECT series, ts, y, acceleration, jerk, x_ret, x_acc, x_vol, x_ticks, x_range, x_body, 2 * x_body + 0.001 * x_range AS x_copy, CASE WHEN x_ret >= 0 THEN 1.0 ELSE 0.0 END AS b_up,
 CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'america' END AS manual_session, CASE WHEN x_body > 0 THEN 'busy' ELSE 'calm' END AS manual_busy
 FROM (SELECT series, ts, "return" AS y, acceleration, jerk, lag("return") {_WT} AS x_ret, lag(acceleration) {_WT} AS x_acc, lag(volume) {_WT} AS x_vol, CAST(lag(ticks) {_WT} AS DOUBLE) AS x_ticks,
 lag((high - low) / open) {_WT} AS x_range, lag((price - open) / open) {_WT} AS x_body FROM rets) WHERE x_acc IS NOT NULL)"""


@stage_table
def feat(spark, d):
    """Small feature table: last bar's values against this bar's return."""
    r = hour_returns(spark, d)
    rows = bounded(r, HOUR, lambda w: {
        "x_ret": F.lag("return").over(w), "x_acc": F.lag("acceleration").over(w), "x_vol": F.lag("volume").over(w),
        "x_ticks": F.lag("ticks").over(w).cast("double"), "x_range": F.lag(F.try_divide(F.col("high") - F.col("low"), F.col("open"))).over(w),
        "x_body": F.lag(F.try_divide(F.col("price") - F.col("open"), F.col("open"))).over(w)}, back=1)
    h = F.hour("ts")
    return rows.where("x_acc is not null").select(
        "series", "ts", F.col("return").alias("y"), "acceleration", "jerk", *X[:6],
        (2 * F.col("x_body") + 0.001 * F.col("x_range")).alias("x_copy"), F.when(F.col("x_ret") >= 0, 1.0).otherwise(0.0).alias("b_up"),
        F.when(h < 8, "asia").when(h < 16, "europe").otherwise("america").alias("manual_session"),
        F.when(F.col("x_body") > 0, "busy").otherwise("calm").alias("manual_busy"))


def _names(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "feature string, position int")


# ---- refine ------------------------------------------------------------------------------------

_RAW = ["open", "high", "low", "price", "volume", '"return"', "acceleration", "jerk"]
_OUT = ["price", "log_volume", "candle_body", "roc_10", "price_high_bb_10_diff", "cum_ret_10", "price_lag_3", "price_mean_6", "price_std_6", "rsi_10",
        "macd_10", "price_ema_10_diff", "price_ema_6", "ha_candle_body"]


def _refine_sql() -> str:
    s = f"""{RET.replace("WITH bars", "WITH RECURSIVE bars", 1)}, fu AS (SELECT series, ts, {", ".join(_RAW)} FROM rets UNION ALL SELECT series, max(ts) + INTERVAL 1 HOUR, {", ".join("NULL" for _ in _RAW)} FROM rets GROUP BY 1),
m0 AS (SELECT series, ts, {", ".join(f"{lagged(c)} AS {c}" for c in _RAW)} FROM fu), mv AS (SELECT series, ts, {", ".join(f"{bf(c)} AS {c}" for c in _RAW)} FROM m0),
bn AS (SELECT *, (open + high + low + price) / 4 AS ha_price, coalesce(price - {lagged("price")}, 0) AS chg, {roll("min", "low", 744)} AS lo, {roll("max", "high", 744)} AS hi,
 coalesce((price - {lagged("price", 10)}) / {lagged("price", 10)} * 100, 0) AS roc_10, (price - ({roll("avg", "price", 10)} + 2 * {roll("stddev_pop", "price", 10)})) / price AS price_high_bb_10_diff,
 CASE WHEN {roll("count", 'ln(1 + "return")', 10)} = 10 THEN exp({roll("sum", 'ln(1 + "return")', 10)}) - 1 END AS cum_ret_10, {lagged("price", 3)} AS price_lag_3, {roll("avg", "price", 6)} AS price_mean_6, {roll("stddev_samp", "price", 6)} AS sd, {SHAPE_SQL} FROM mv),
bi AS (SELECT *, coalesce({lagged("ha_price")}, (open + price) / 2) AS hin, greatest(chg, 0) AS up, greatest(-chg, 0) AS dn, coalesce(sd, {bf("sd")}) AS price_std_6, candle_body + candle_top_wick + candle_bot_wick AS tot FROM bn)"""
    s = ema_sql({"e10": ("price", 2 / 11), "e20": ("price", 2 / 21), "price_ema_6": ("price", 2 / 7), "u10": ("up", 0.1), "d10": ("dn", 0.1), "ha_open": ("hin", 0.5)}, "bi", s, out="em")
    return s + f""", jo AS (SELECT bi.*, e10, e20, price_ema_6, u10, d10, ha_open, greatest(ha_open, ha_price, high) AS ha_high, least(ha_open, ha_price, low) AS ha_low FROM bi JOIN em ON em.series = bi.series AND em.ts = bi.ts),
ha AS (SELECT *, abs(ha_price - ha_open) / ha_open AS ha_candle_body, (ha_high - greatest(ha_price, ha_open)) / ha_open AS tw, (least(ha_price, ha_open) - ha_low) / ha_open AS bw FROM jo),
hc AS (SELECT *, ha_candle_body + tw + bw AS ht, CASE WHEN ha_price >= ha_open THEN CASE WHEN bw <= 0.05 * (ha_candle_body + tw + bw) AND ha_candle_body >= 0.5 * (ha_candle_body + tw + bw) THEN 0 WHEN tw >= 0.38 * (ha_candle_body + tw + bw) AND bw >= 0.38 * (ha_candle_body + tw + bw) THEN 4 ELSE 2 END
 ELSE CASE WHEN tw <= 0.05 * (ha_candle_body + tw + bw) AND ha_candle_body >= 0.5 * (ha_candle_body + tw + bw) THEN 1 WHEN tw >= 0.38 * (ha_candle_body + tw + bw) AND bw >= 0.38 * (ha_candle_body + tw + bw) THEN 5 ELSE 3 END END AS code FROM ha),
co AS MATERIALIZED (SELECT series, ts, code AS c, lag(code) OVER ({W}) AS p, row_number() OVER ({W}) AS rn FROM hc),
tr AS (SELECT series, ts, rn, 0 AS state FROM co WHERE rn = 1 UNION ALL SELECT n.series, n.ts, n.rn, CASE
  WHEN t.state = 0 THEN CASE WHEN c = 1 OR (c = 3 AND p = 3) THEN 1 WHEN (c = 4 AND p = 4) OR c = 5 THEN 2 ELSE 0 END
  WHEN t.state = 1 THEN CASE WHEN c = 0 OR (c = 2 AND p = 2) THEN 0 WHEN (c = 5 AND p = 5) OR c = 4 THEN 2 ELSE 1 END
  ELSE CASE WHEN c = 0 OR (c = 2 AND p = 2) THEN 0 WHEN c = 1 OR (c = 3 AND p = 3) THEN 1 ELSE 2 END END FROM tr t JOIN co n ON n.series = t.series AND n.rn = t.rn + 1),
bd AS (SELECT series, avg("return") - 1.96 * stddev_samp("return") AS rlo, avg("return") + 1.96 * stddev_samp("return") AS rhi FROM rets GROUP BY 1),
al AS (SELECT hc.*, e10 - e20 AS macd_10, CASE WHEN d10 = 0 THEN 100 ELSE 100 - 100 / (1 + u10 / d10) END AS rsi_10, (price - e10) / price AS price_ema_10_diff, state, {CANDLE_SQL} AS manual_is_candle_type,
 CASE WHEN "return" IS NULL THEN 'return_no_outlier' WHEN "return" <= rlo THEN 'return_low_outlier' WHEN "return" <= rhi THEN 'return_no_outlier' ELSE 'return_top_outlier' END AS manual_return_outlier FROM hc JOIN tr ON tr.series = hc.series AND tr.ts = hc.ts JOIN bd ON bd.series = hc.series)
SELECT series, ts, {", ".join(f"coalesce({ff(c)}, {bf(c)}, 0) AS {c}" for c in _OUT)}, CASE {" ".join(f"WHEN price < lo + {s} * (hi - lo) THEN {k}" for k, s in enumerate(win.FIB_SHARES) if 0 < k < 6)} ELSE 6 END AS fib_group,
 manual_is_candle_type, manual_return_outlier, CASE state WHEN 0 THEN 'bull_trend' WHEN 1 THEN 'bear_trend' ELSE 'indecision' END AS manual_trend_identifier, sin(2 * pi() * hour(ts) / 24) AS hod_sin, CAST(ts AS DATE) IN ({HOLIDAYS}) AS is_holiday FROM al"""


@query("refine_panel", "series:s ts:t " + " ".join(f"{c}:d" for c in _OUT) + " fib_group:i manual_is_candle_type:s manual_return_outlier:s manual_trend_identifier:s hod_sin:d is_holiday:b", _refine_sql())
def _(spark, d):
    return refine_panel(hour_returns(spark, d), HOUR, [10], [1, 3], [6])


# Look-backs of an hourly panel, in bars.
LAGS = [1, 2, 3, 5, 11, 23, 167, 719]
ROLLING = [6, 12, 24]
KINDS = {"price": "pct", "high": "pct", "low": "pct", "volume": "pct", "return": "diff"}
_STATS = {"mean": "avg", "min": "min", "max": "max"}


def _columns_sql() -> tuple[str, str]:
    """Layout and text: every look-back of every column of ``KINDS``, in plain windows over whole series."""
    q = {c: f'"{c}"' for c in KINDS}
    base = f"""{RET}, fu AS (SELECT series, ts, {", ".join(q.values())} FROM rets UNION ALL SELECT series, max(ts) + INTERVAL 1 HOUR, {", ".join("NULL" for _ in q)} FROM rets GROUP BY 1),
m0 AS (SELECT series, ts, {", ".join(f"{lagged(x)} AS {x}" for x in q.values())} FROM fu), mv AS (SELECT series, ts, {", ".join(f"coalesce({ff(x)}, {bf(x)}, 0) AS {x}" for x in q.values())} FROM m0),
d1 AS (SELECT *, {", ".join(f"{x} - {lagged(x)} AS {c}_r" if KINDS[c] == "diff" else f"CASE WHEN {lagged(x)} <> 0 THEN ({x} - {lagged(x)}) / {lagged(x)} END AS {c}_r" for c, x in q.items())} FROM mv),
d2 AS (SELECT *, {", ".join(f"{c}_r - {lagged(f'{c}_r')} AS {c}_a" for c in q)} FROM d1), d3 AS (SELECT *, {", ".join(f"{c}_a - {lagged(f'{c}_a')} AS {c}_j" for c in q)} FROM d2)"""
    text = ema_sql({f"{c}_{n}": (x, 2 / (n + 1)) for c, x in q.items() for n in ROLLING}, "d3", base)
    layout, cells = ["series:s", "ts:t"], []
    for c, x in q.items():
        mine = {c: x, **{f"{c}_{level}": f"coalesce({ff(f'{c}_{level[0]}')}, {bf(f'{c}_{level[0]}')}, 0)" for level in ("return", "acceleration", "jerk")}}
        mine |= {f"{c}_lag_{k}": f"coalesce({lagged(x, k)}, first_value({x}) OVER ({W}))" for k in LAGS}
        for n in ROLLING:
            mine |= {f"{c}_rolling_{n}_{s}": roll(f, x, n) for s, f in _STATS.items()}
            mine[f"{c}_rolling_{n}_std"] = f"coalesce({roll('stddev_samp', x, n)}, stddev_samp({x}) OVER ({W} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0)"
            mine[f"{c}_rolling_{n}_range"] = f"{roll('max', x, n)} - {roll('min', x, n)}"
            mine[f"{c}_ema_{n}"] = f"{c}_{n}"
        layout += [f"{n}:d" for n in mine]
        cells += [f'{e} AS "{n}"' for n, e in mine.items()]
    return " ".join(layout), f"""{text} SELECT series, ts, {", ".join(cells)} FROM (SELECT d3.*, em.* EXCLUDE (series, ts) FROM d3 JOIN em ON em.series = d3.series AND em.ts = d3.ts)"""


@query("refine_columns", *_columns_sql())
def _(spark, d):
    moved = win.shift_with_forecast_row(hour_returns(spark, d).select("series", "ts", *KINDS), HOUR, list(KINDS))
    return column_features(moved, HOUR, KINDS, LAGS, ROLLING, ROLLING, width=2)


# ---- selection ---------------------------------------------------------------------------------

_PAIR_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS s FROM feat" for i, a in enumerate(X) for b in X[i + 1:])


def colinear_sql(ordered: str) -> str:
    """Greedy walk as a recursive table; ``ordered`` yields (i, feature)."""
    return f"""{FEAT.replace("WITH bars", "WITH RECURSIVE bars", 1)}, pr AS MATERIALIZED ({_PAIR_ROWS}), od AS MATERIALIZED ({ordered}),
wk AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE s >= 0.95 AND s < 1 AND ((pr.a = o.feature AND list_contains(w.kept, pr.b)) OR (pr.b = o.feature AND list_contains(w.kept, pr.a)))) THEN w.kept ELSE list_append(w.kept, o.feature) END FROM wk w JOIN od o ON o.i = w.i + 1),
keep AS (SELECT unnest(kept) AS feature, generate_subscripts(kept, 1) AS position FROM (SELECT kept FROM wk ORDER BY i DESC LIMIT 1))"""


@query("colinear_filter", "feature:s position:i", colinear_sql("SELECT i, feature FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(X, 1)) + ") v(i, feature)") + " SELECT * FROM keep")
def _(spark, d):
    return _names(spark, se.colinear_filter(feat(spark, d), X))


CHI_SQL = f"""{FEAT}, lo AS (SELECT y >= 0 AS up, unnest(['manual_session', 'manual_busy']) AS "column", unnest([manual_session, manual_busy]) AS value FROM feat),
pu AS (SELECT avg(CASE WHEN y >= 0 THEN 1.0 ELSE 0 END) AS p FROM feat), ct AS (SELECT "column", value, count(*) FILTER (up) AS u, count(*) FILTER (NOT up) AS dn FROM lo GROUP BY 1, 2),
chi AS (SELECT "column", value, pow(u - (u + dn) * p, 2) / ((u + dn) * p) + pow(dn - (u + dn) * (1 - p), 2) / ((u + dn) * (1 - p)) AS chi2 FROM ct, pu)"""


@query("chi2_categorical", "column:s value:s chi2:d", f"{CHI_SQL} SELECT * FROM chi")
def _(spark, d):
    return se.chi2_scores(feat(spark, d), CATS, F.col("y") >= 0)


_NUM = X[:7]


def _primary_sql() -> str:
    base = FEAT.replace("WITH bars", "WITH RECURSIVE bars", 1) + f", pr AS MATERIALIZED ({_PAIR_ROWS})"
    parts = []
    for t in ("y", "jerk"):
        base += f""", sc_{t} AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({t}, {c})) AS score FROM feat" for c in _NUM)}),
od_{t} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, feature) AS i, feature FROM sc_{t} WHERE score > (SELECT quantile_cont(score, 0.3) FROM sc_{t})),
wk_{t} AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE s >= 0.95 AND s < 1 AND ((pr.a = o.feature AND list_contains(w.kept, pr.b)) OR (pr.b = o.feature AND list_contains(w.kept, pr.a)))) THEN w.kept ELSE list_append(w.kept, o.feature) END FROM wk_{t} w JOIN od_{t} o ON o.i = w.i + 1)"""
        parts.append(f"SELECT kept FROM wk_{t} ORDER BY i DESC LIMIT 1")
    chi = CHI_SQL[len(FEAT):]
    return f"""{base}{chi}, ls AS (SELECT list_concat(list_concat(({parts[0]}), ({parts[1]})), (SELECT list("column") FROM (SELECT "column" FROM chi ORDER BY chi2 DESC, "column", value LIMIT 1))) AS all_f),
fl AS (SELECT unnest(all_f) AS feature, generate_subscripts(all_f, 1) AS i FROM ls) SELECT feature, row_number() OVER (ORDER BY min(i)) AS position FROM fl GROUP BY feature"""


@query("primary_filter", "feature:s position:i", _primary_sql())
def _(spark, d):
    return _names(spark, se.primary_filter(feat(spark, d), ["y", "jerk"], _NUM, CATS, F.col("y") >= 0, q=0.3, share=0.1))


@query("rfe_select", "feature:s position:i")
def _(spark, d):
    return _names(spark, se.rfe_select(feat(spark, d), X, "y", 4))


_Q9 = [i / 10 for i in range(1, 10)]
CELLS_SQL = f"""{FEAT}, lg AS (SELECT y, unnest({X!r}) AS feature, unnest([{", ".join(X)}]) AS x FROM feat), cx AS (SELECT feature, quantile_cont(x, {_Q9!r}::DOUBLE[]) AS c FROM lg GROUP BY 1), cy AS (SELECT quantile_cont(y, {_Q9!r}::DOUBLE[]) AS c FROM feat),
cells AS (SELECT lg.feature, len(list_filter(cx.c, lambda q: q < x)) AS bx, len(list_filter(cy.c, lambda q: q < y)) AS "by", count(*) AS n FROM lg JOIN cx ON cx.feature = lg.feature, cy GROUP BY ALL),
cellz AS (SELECT lg.feature, len(list_filter(cx.c, lambda q: q < x)) AS bx, CASE WHEN y >= 0 THEN 1 ELSE 0 END AS "by", count(*) AS n FROM lg JOIN cx ON cx.feature = lg.feature GROUP BY ALL)"""


def mi_sql(cells: str) -> str:
    return f"""SELECT feature, sum(n / t * ln(n * t / (px * py))) AS mi FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS t, sum(n) OVER (PARTITION BY feature, bx) AS px, sum(n) OVER (PARTITION BY feature, "by") AS py FROM {cells}) GROUP BY 1"""


@query("mutual_info_top_k", "feature:s mi:d mi_sign:d", f"""{CELLS_SQL}, a AS ({mi_sql('cells')}), b AS ({mi_sql('cellz')}) SELECT feature, a.mi, b.mi AS mi_sign FROM a JOIN b USING (feature)
QUALIFY row_number() OVER (ORDER BY a.mi DESC, feature) <= 3 OR row_number() OVER (ORDER BY b.mi DESC, feature) <= 2""")
def _(spark, d):
    return se.mutual_info_top_k(feat(spark, d), X, "y", 3, 2)


def _p_norm(z: str) -> str:
    return f"CASE WHEN abs({z}) > 8 THEN 0 ELSE 2 * (1 - ({cdf_sql(f'abs({z})')})) END"


REL_SQL = f"""{CELLS_SQL}, s AS (SELECT a.feature, sum(sign(a."by" - b."by") * a.n * b.n) AS s FROM cells a JOIN cells b ON b.feature = a.feature AND b.bx < a.bx WHERE a.feature <> 'b_up' GROUP BY 1),
tx AS (SELECT feature, sum(m) AS m, sum(m * (m - 1) / 2) AS x2, sum(m * (m - 1) * (m - 2)) AS x0, sum(m * (m - 1) * (2 * m + 5)) AS x1 FROM (SELECT feature, bx, CAST(sum(n) AS DOUBLE) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
ty AS (SELECT feature, sum(m * (m - 1) / 2) AS y2, sum(m * (m - 1) * (m - 2)) AS y0, sum(m * (m - 1) * (2 * m + 5)) AS y1 FROM (SELECT feature, "by", CAST(sum(n) AS DOUBLE) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT feature, s / sqrt((m * (m - 1) * (2 * m + 5) - x1 - y1) / 18 + 2 * x2 * y2 / (m * (m - 1)) + x0 * y0 / (9 * m * (m - 1) * (m - 2))) AS z FROM s JOIN tx USING (feature) JOIN ty USING (feature)),
c63 AS (SELECT quantile_cont(y, {[i / 64 for i in range(1, 64)]!r}::DOUBLE[]) AS c FROM feat), kb AS (SELECT b_up > 0 AS hi, len(list_filter(c, lambda q: q < y)) AS "by" FROM feat, c63),
ks AS (SELECT max(abs(f0 - f1)) AS dist, any_value(n0) AS n0, any_value(n1) AS n1 FROM (SELECT "by", sum(count(*) FILTER (NOT hi)) OVER (ORDER BY "by") / sum(count(*) FILTER (NOT hi)) OVER () AS f0, sum(count(*) FILTER (hi)) OVER (ORDER BY "by") / sum(count(*) FILTER (hi)) OVER () AS f1, sum(count(*) FILTER (NOT hi)) OVER () AS n0, sum(count(*) FILTER (hi)) OVER () AS n1 FROM kb GROUP BY "by")),
ps AS (SELECT feature, {_p_norm('z')} AS p_value FROM z UNION ALL SELECT 'b_up', least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2.0 * k * k * dist * dist * n0 * n1 / (n0 + n1)))))) FROM ks),
bh AS (SELECT *, least(1, min(p_value * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_corrected FROM (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS r, count(*) OVER () AS n FROM ps))"""


@query("relevance_pvalues", "feature:s p_value:d p_corrected:d", f"{REL_SQL} SELECT * FROM bh WHERE p_corrected <= 0.05 AND p_value < 0.02")
def _(spark, d):
    return se.relevance(feat(spark, d), X, "y", 0.02)


TEST_SQL = f"""{FEAT}, w AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, 'welch' AS test, (avg({c}) FILTER (y < 0) - avg({c}) FILTER (y >= 0)) / sqrt(var_samp({c}) FILTER (y < 0) / count(*) FILTER (y < 0) + var_samp({c}) FILTER (y >= 0) / count(*) FILTER (y >= 0)) AS statistic, pow(var_samp({c}) FILTER (y < 0) / count(*) FILTER (y < 0) + var_samp({c}) FILTER (y >= 0) / count(*) FILTER (y >= 0), 2) / (pow(var_samp({c}) FILTER (y < 0) / count(*) FILTER (y < 0), 2) / (count(*) FILTER (y < 0) - 1) + pow(var_samp({c}) FILTER (y >= 0) / count(*) FILTER (y >= 0), 2) / (count(*) FILTER (y >= 0) - 1)) AS v FROM feat" for c in _NUM)}),
ct AS (SELECT CAST(count(*) FILTER (y < 0 AND b_up = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (y < 0 AND b_up = 1) AS DOUBLE) AS b, CAST(count(*) FILTER (y >= 0 AND b_up = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (y >= 0 AND b_up = 1) AS DOUBLE) AS e FROM feat),
x2 AS (SELECT (a + b + c + e) * pow(greatest(0, abs(a * e - b * c) - (a + b + c + e) / 2), 2) / ((a + b) * (c + e) * (a + c) * (b + e)) AS s FROM ct)"""


@query("binary_target_tests", "feature:s test:s statistic:d p_value:d", f"{TEST_SQL} SELECT feature, test, statistic, {t_sql('statistic', 'v')} AS p_value FROM w UNION ALL SELECT 'b_up', 'chi2', s, {_p_norm('sqrt(s)')} FROM x2")
def _(spark, d):
    return se.binary_target_tests(feat(spark, d), X, "y")


@query("boruta_select", "feature:s hits:i decision:s")
def _(spark, d):
    found = se.boruta_select(feat(spark, d), ["series", "ts"], ["x_ret", "x_acc", "x_vol", "x_body"], "y")
    return spark.createDataFrame([(f, h, s) for f, (h, s) in found.items()], "feature string, hits int, decision string")


# Kendall's test over all pairs of rows and the two-sample distance at every value, in plain joins and windows.
_KF = ["x_ret", "x_ticks", "x_body"]
KENDALL_SQL = f"""{FEAT}, lg AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, y FROM feat WHERE y IS NOT NULL" for c in _KF)}), nb AS (SELECT *, row_number() OVER (PARTITION BY feature) AS i FROM lg),
sg AS (SELECT a.feature, sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s FROM nb a JOIN nb b ON a.feature = b.feature AND b.i < a.i GROUP BY 1),
tx AS (SELECT feature, sum(t * (t - 1) / 2) AS x2, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1, sum(t) AS n FROM (SELECT feature, count(*)::DOUBLE AS t FROM lg GROUP BY feature, x) GROUP BY 1),
ty AS (SELECT feature, sum(t * (t - 1) / 2) AS y2, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1 FROM (SELECT feature, count(*)::DOUBLE AS t FROM lg GROUP BY feature, y) GROUP BY 1),
kz AS (SELECT *, greatest(-7, -abs(s / sqrt((n * (n - 1) * (2 * n + 5) - x1 - y1) / 18 + 2 * x2 * y2 / (n * (n - 1)) + x0 * y0 / (9 * n * (n - 1) * (n - 2))))) AS zz FROM sg JOIN tx USING (feature) JOIN ty USING (feature))"""


@query("kendall_tau", "feature:s n:i tau:d p_value:d", f"{KENDALL_SQL} SELECT feature, n, s / sqrt((n * (n - 1) / 2 - x2) * (n * (n - 1) / 2 - y2)) AS tau, 2 * {cdf_sql('zz')} AS p_value FROM kz")
def _(spark, d):
    return se.kendall_exact(feat(spark, d), _KF, "y")


@query("two_sample_distance", "feature:s distance:d", f"""{FEAT}, cu AS (SELECT b_up, y, sum(count(*) FILTER (b_up = 0)) OVER (ORDER BY y) AS a, sum(count(*) FILTER (b_up = 1)) OVER (ORDER BY y) AS c FROM feat WHERE y IS NOT NULL GROUP BY b_up, y)
SELECT 'b_up' AS feature, max(abs(a / (SELECT count(*) FROM feat WHERE b_up = 0 AND y IS NOT NULL)::DOUBLE - c / (SELECT count(*) FROM feat WHERE b_up = 1 AND y IS NOT NULL)::DOUBLE)) AS distance FROM cu""")
def _(spark, d):
    return se.two_sample_ks_exact(feat(spark, d), ["b_up"], "y")


@query("fdr_correction", "feature:s p_value:d p_corrected:d rejected:b", f"{REL_SQL} SELECT feature, p_value, p_corrected, p_corrected <= 0.05 AS rejected FROM bh WHERE true")
def _(spark, d):
    x = feat(spark, d)
    k = se.kendall(stage(se.joint_counts(x, _NUM, "y"))).select("feature", "p_value")
    return se.fdr(k.unionByName(se.two_sample_ks(se.joint_counts_two(x, ["b_up"], "y")).select("feature", "p_value")))


@query("select_panel", "feature:s position:i")
def _(spark, d):
    return _names(spark, se.select_panel(feat(spark, d), X, "y", ["x_vol"], 6, 6, 3, 2))


# ---- transforms --------------------------------------------------------------------------------

SPLIT_SQL = f"""{FEAT}, sn AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series) AS n FROM feat), tf AS (SELECT *, rn <= floor(n * 0.85 + 1e-9) AS train FROM sn)"""


@query("one_hot", "series:s ts:t manual_session_america:d manual_session_asia:d manual_session_europe:d", f"""{FEAT} SELECT series, ts, CASE WHEN s = 'america' THEN 1 ELSE 0 END AS manual_session_america, CASE WHEN s = 'asia' THEN 1 ELSE 0 END AS manual_session_asia, CASE WHEN s = 'europe' THEN 1 ELSE 0 END AS manual_session_europe
FROM (SELECT *, CASE WHEN x_ticks > 4 THEN 'other' ELSE manual_session END AS s FROM feat)""")
def _(spark, d):
    x = feat(spark, d)
    known = tr.categories(x, ["manual_session"])
    odd = x.withColumn("manual_session", F.when(F.col("x_ticks") > 4, "other").otherwise(F.col("manual_session")))
    return tr.one_hot(odd, known)


@query("standard_scale", "series:s ts:t x_vol:d x_range:d", f"""{SPLIT_SQL}, m AS (SELECT series, avg(x_vol) AS a, stddev_pop(x_vol) AS b, avg(x_range) AS c, stddev_pop(x_range) AS e FROM tf WHERE train GROUP BY 1)
SELECT series, ts, (x_vol - a) / b AS x_vol, (x_range - c) / e AS x_range FROM tf JOIN m USING (series)""")
def _(spark, d):
    x = stage(tr.train_flag(feat(spark, d), HOUR))
    cols = ["x_vol", "x_range"]
    return tr.scale(x, ["series"], cols, tr.moments(x, ["series"], cols))


def _cut_sql(c: str) -> str:
    return (f"CASE WHEN {c} > a_{c} + 1.96 * s_{c} THEN a_{c} + 1.96 * s_{c} + ({c} - a_{c} - 1.96 * s_{c}) * 0.25 "
            f"WHEN {c} < a_{c} - 1.96 * s_{c} THEN a_{c} - 1.96 * s_{c} - (a_{c} - 1.96 * s_{c} - {c}) * 0.25 ELSE {c} END AS {c}")


def _fit_sql(source: str, deviation: str, cols: list[str]) -> str:
    """Join of a table with mean ``a_<c>`` and deviation ``s_<c>`` of its training rows per series."""
    stats = ", ".join(f"avg({c}) AS a_{c}, {deviation}({c}) AS s_{c}" for c in cols)
    return f"{source} JOIN (SELECT series, {stats} FROM {source} WHERE train GROUP BY 1) f_{source} USING (series)"


def _steps_sql(cols: list[str], keep: str) -> str:
    """Tables t1 (cut), t2 (scaled), t3 (cut again) of the transform."""
    return f"""{SPLIT_SQL}, t1 AS (SELECT {keep}, {", ".join(map(_cut_sql, cols))} FROM {_fit_sql("tf", "stddev_samp", cols)}),
t2 AS (SELECT {keep}, {", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in cols)} FROM {_fit_sql("t1", "stddev_pop", cols)}),
t3 AS (SELECT {keep}, {", ".join(map(_cut_sql, cols))} FROM {_fit_sql("t2", "stddev_samp", cols)})"""


_BANDED = ["x_vol", "x_range"]


@query("truncation_params", "step:i series:s column:s low:d high:d", _steps_sql(_BANDED, "series, ts, train") + " " + " UNION ALL ".join(
    f"""SELECT {k} AS step, series, '{c}' AS "column", avg({c}) - 1.96 * stddev_samp({c}) AS low, avg({c}) + 1.96 * stddev_samp({c}) AS high FROM {t} WHERE train GROUP BY 2"""
    for k, t in ((1, "tf"), (2, "t2")) for c in _BANDED))
def _(spark, d):
    x = stage(tr.train_flag(feat(spark, d), HOUR))
    one = stage(tr.bands(x, ["series"], _BANDED))
    cut = stage(tr.truncate(x, ["series"], _BANDED, one))
    two = tr.bands(tr.scale(cut, ["series"], _BANDED, tr.moments(cut, ["series"], _BANDED)), ["series"], _BANDED)
    table = lambda f, step: long_thresholds(f, ["series"], _BANDED).withColumn("step", F.lit(step))
    return table(one, 1).unionByName(table(two, 2))


@query("pca_95", "series:s ts:t pca_0:d pca_1:d")
def _(spark, d):
    cols = ["x_vol", "x_ticks", "x_range", "x_body", "x_copy"]
    x = stage(tr.train_flag(feat(spark, d), HOUR))
    return tr.pca(tr.scale(x, ["series"], cols, tr.moments(x, ["series"], cols)), cols)


_TC = ["x_vol", "x_range", "x_body"]


def _transform_sql() -> str:
    return _steps_sql(_TC, "series, ts, train, manual_busy") + f""" SELECT series, ts, {", ".join(_TC)}, CASE WHEN manual_busy = 'busy' THEN 1 ELSE 0 END AS manual_busy_busy,
 CASE WHEN manual_busy = 'calm' THEN 1 ELSE 0 END AS manual_busy_calm FROM t3"""


@query("transform_panel", "series:s ts:t " + " ".join(f"{c}:d" for c in _TC) + " manual_busy_busy:d manual_busy_calm:d", _transform_sql())
def _(spark, d):
    return tr.transform_panel(feat(spark, d), HOUR, _TC, ["manual_busy"])


@query("seasonal_period", "series:s period:i power:d2", f"""{DENSE}, sn AS (SELECT series, ts, price, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series) AS n FROM dense),
td AS (SELECT *, CASE WHEN count(*) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(price) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(price, 12) OVER ({W}) + lead(price, 12) OVER ({W})) / 2) / 24 END AS trend FROM sn),
sm AS (SELECT series, (rn - 1) % 24 AS ph, avg(price - trend) AS s FROM td GROUP BY 1, 2), sz AS (SELECT series, ph, s - avg(s) OVER (PARTITION BY series) AS s FROM sm),
tl AS (SELECT sn.series, rn - 1 AS t, n, s FROM sn JOIN sz ON sz.series = sn.series AND sz.ph = (rn - 1) % 24), ks AS (SELECT unnest(range(1, 360)) AS k),
pw AS (SELECT series, k, any_value(n) AS n, pow(sum(s * cos(2 * pi() * k * t / n)), 2) + pow(sum(s * sin(2 * pi() * k * t / n)), 2) AS p FROM tl, ks WHERE k < n // 2 GROUP BY 1, 2)
SELECT series, n // k AS period, p AS power FROM pw QUALIFY row_number() OVER (PARTITION BY series ORDER BY p DESC) = 1""")
def _(spark, d):
    return tr.seasonal_period(hour_dense(spark, d), HOUR, "price", 24)


@query("train_val_test_split", "series:s ts:t split:s", f"""{SPLIT_SQL} SELECT series, ts, CASE WHEN rn > n - t THEN 'test' WHEN rn > n - t - floor((n - t) * 0.25 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, floor(n * 0.15 + 1e-9) AS t FROM sn)""")
def _(spark, d):
    return tr.time_split(feat(spark, d), HOUR)


# ---- forecasts ---------------------------------------------------------------------------------

_NW = [1 - p / 5 for p in range(5)]


@query("naive_forecasts", "series:s ts:t last_value:d moving:d", f"""{RET}, a AS (SELECT series, ts, {lagged('"return"', 2)} AS f, ({" + ".join(f"{_NW[p]!r} * " + lagged(chr(34) + "return" + chr(34), 5 - p) for p in range(5))}) / {sum(_NW)!r} AS g FROM rets)
SELECT series, ts, {bf("f")} AS last_value, {bf("g")} AS moving FROM a""")
def _(spark, d):
    r = hour_returns(spark, d).select("series", "ts", "return")
    one = win.naive_last_value(r, HOUR, "return", 2).withColumnRenamed("forecast", "last_value")
    return win.naive_weighted_ma(stage(one), HOUR, "return", 5).withColumnRenamed("forecast", "moving")


@query("panel_tree_forecast", "series:s ts:t y:d forecast:d")
def _(spark, d):
    parts = stage(tr.time_split(feat(spark, d), HOUR))
    _, out = fc.fit_predict(parts.where("split = 'train'"), parts.where("split <> 'train'"), _NUM, "y")
    return out


def _split_trees(spark, d, algorithm):
    parts = stage(tr.time_split(feat(spark, d), HOUR))
    fitted = fit_trees(parts.where("split = 'train'"), HOUR, _NUM, "y", HOUR.keys, algorithm)
    return tree_forecast(fitted, parts.where("split <> 'train'").select("series", "ts", "y", *_NUM), HOUR)


@query("series_tree_forecast", "series:s ts:t y:d forecast:d")
def _(spark, d):
    """A forest per series, all grown together."""
    return _split_trees(spark, d, "random_forest")


@query("boosted_tree_forecast", "series:s ts:t y:d forecast:d")
def _(spark, d):
    """Boosted trees per series, all grown together."""
    return _split_trees(spark, d, "boosted_trees")


@query("walk_forward", "series:s ts:t batch:i y:d forecast:d")
def _(spark, d):
    return fc.walk_forward(feat(spark, d), HOUR, ["x_ret", "x_acc", "x_body"], "y", F.expr("ts >= timestamp_ntz'2024-01-25'"), 50, 100)


@query("target_inversion", "series:s ts:t from_acceleration:d from_jerk:d from_price:d", f"""{RET}, f AS (SELECT *, 0.5 * "return" AS f FROM rets)
SELECT series, ts, f + {lagged('"return"')} AS from_acceleration, f + {lagged('"return"')} + {lagged("acceleration")} AS from_jerk, CASE WHEN {lagged("f")} <> 0 THEN (f - {lagged("f")}) / {lagged("f")} END AS from_price FROM f""")
def _(spark, d):
    out = hour_returns(spark, d).withColumn("forecast", 0.5 * F.col("return"))
    for m in ("acceleration", "jerk", "price"):
        out = fc.target_inversion(out, HOUR, m).withColumnRenamed("return_forecast", f"from_{m}")
    return out


@query("forecast_adjust", "series:s ts:t return_forecast:d", f"""{INPUT_SQL}, t AS (SELECT series, avg(abs(real_return)) / avg(abs(return_forecast)) AS sc, min(real_return) AS lo, max(real_return) AS hi FROM inp WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT series, ts, greatest(lo, least(hi, -(return_forecast * sc + 0.002))) AS return_forecast FROM inp JOIN t USING (series) WHERE ts >= TIMESTAMP '2024-01-20'""")
def _(spark, d):
    x = trading_input(spark, d)
    train = x.where("ts < timestamp_ntz'2024-01-20'").withColumn("forecast", F.col("return_forecast"))
    return fc.adjust(x.where("ts >= timestamp_ntz'2024-01-20'"), train, ["series"], "real_return", 0.002, True)


# One linear model of the whole panel on the last return and the last upward reach, fitted on the bars before a day, tried on those after it.
PANEL = ["x_real", "x_reach"]
PANEL_CUT = "2024-01-20"
_PX = INPUT_SQL.replace("inp AS (SELECT u.series", "inp0 AS (SELECT u.series", 1) + f""", px AS (SELECT *, lag(real_return) OVER ({W}) AS x_real, lag(high / open - 1) OVER ({W}) AS x_reach FROM inp0),
pm AS (SELECT avg(x_real) AS m1, avg(x_reach) AS m2, avg(real_return) AS my, var_pop(x_real) AS s11, var_pop(x_reach) AS s22, covar_pop(x_real, x_reach) AS s12, covar_pop(x_real, real_return) AS s1y, covar_pop(x_reach, real_return) AS s2y FROM px WHERE x_real IS NOT NULL AND ts < TIMESTAMP '{PANEL_CUT}'),
pc AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM pm),
inp AS (SELECT series, ts, open, high, low, price, real_return, my + b1 * (x_real - m1) + b2 * (x_reach - m2) AS return_forecast FROM px, pc WHERE ts >= TIMESTAMP '{PANEL_CUT}')"""
PANEL_SQL = measure_sql(bt_sql(SETS, prefix=_PX + CERT_SQL[len(INPUT_SQL):]))


@query("best_series_for_model", "pid:i series:s metric:d avg_real_trading_return:d", f"""{PANEL_SQL} SELECT pid, series, weighted_trading_accuracy AS metric, avg_real_trading_return FROM perf
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(weighted_trading_accuracy, 12) DESC NULLS LAST, round(avg_real_trading_return, 12) DESC NULLS LAST, series) = 1""")
def _(spark, d):
    rows = stage(bounded(trading_input(spark, d).drop("return_forecast"), HOUR, lambda w: {
        "x_real": F.lag("real_return").over(w), "x_reach": F.lag(F.try_divide("high", "open") - 1).over(w)}, back=1))
    model = stage(ml.fit_linear(rows.where(f"x_real is not null and ts < timestamp_ntz'{PANEL_CUT}'"), [], PANEL, "real_return"))
    scored = ml.apply_linear(rows.where(f"ts >= timestamp_ntz'{PANEL_CUT}'"), model, [], PANEL)
    return fc.best_series(bt.sweep(scored, HOUR, SETS), "pid", "series", "weighted_trading_accuracy").withColumnRenamed("weighted_trading_accuracy", "metric")


@query("feature_importance", "feature:s importance:d share:d")
def _(spark, d):
    x = feat(spark, d)
    model, _out = fc.fit_predict(x, x, _NUM, "y")
    return fc.feature_importance(model, _NUM, x)


# The linear model of a series on the last return and the last body, from covariances, and the normal fit of its residuals.
LINEAR = ["x_ret", "x_body"]
LINEAR_COLS = ["open", "price", "return"]


def linear_sql(until: str) -> str:
    """Tables ``rets`` (bars) and ``lin`` (coefficients, means, ``loc`` and ``scale`` of each series) fitted on the rows before ``until``."""
    return f"""{FEAT}, ltr AS (SELECT * FROM feat WHERE ts < TIMESTAMP '{until}'),
lmo AS (SELECT series, avg(x_ret) AS m1, avg(x_body) AS m2, avg(y) AS my, var_pop(x_ret) AS s11, var_pop(x_body) AS s22, covar_pop(x_ret, x_body) AS s12, covar_pop(x_ret, y) AS s1y, covar_pop(x_body, y) AS s2y FROM ltr GROUP BY 1),
lco AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM lmo),
lrs AS (SELECT series, y - (my + b1 * (x_ret - m1) + b2 * (x_body - m2)) AS r FROM ltr JOIN lco USING (series)), lzs AS (SELECT series, avg(r) AS zm, stddev_pop(r) AS zd FROM lrs GROUP BY 1),
lft AS (SELECT series, avg(r) AS loc, stddev_pop(r) AS scale FROM lrs JOIN lzs USING (series) WHERE abs((r - zm) / zd) < 2.1 GROUP BY 1), lin AS (SELECT * FROM lco JOIN lft USING (series))"""


def scored_sql(until: str, newest: str) -> str:
    """``newest``: the last bar of each series at every scoring, as rows of ``rets``."""
    return f"""{linear_sql(until)}, nw AS ({newest}), nf AS (SELECT series, ts + INTERVAL 1 HOUR AS ts, price AS open, my + b1 * ("return" - m1) + b2 * ((price - open) / open - m2) AS f, loc, scale FROM nw JOIN lin USING (series)),
nz AS (SELECT *, (-f - loc) / scale AS zz FROM nf), nc AS (SELECT *, {cdf_sql('zz')} AS dc FROM nz), nk AS (SELECT *, greatest(dc, 1 - dc) AS certainty, CASE WHEN 1 - dc >= dc THEN 'long' ELSE 'short' END AS kind FROM nc)
SELECT series, ts, f AS return_forecast, certainty, kind, CASE WHEN certainty > 0.9 THEN 3 ELSE 1 END AS leverage, CASE WHEN certainty > 0.55 THEN greatest(0.5, least(ln(100 * certainty - 49) / ln(41) + 0.1, 1)) ELSE 0 END AS exposure,
 open * (1 + CASE WHEN kind = 'long' THEN 0.012 ELSE -0.012 END) AS tp_price, open * (1 + CASE WHEN kind = 'long' THEN -0.016 ELSE 0.016 END) AS sl_price FROM nk"""


def linear_features(moved):
    """The features of ``LINEAR`` from columns that moved one bar forward."""
    return moved.withColumns({"x_ret": F.col("return"), "x_body": F.try_divide(F.col("price") - F.col("open"), F.col("open"))})


def stored_model(spark, d, until):
    """A store whose newest version was fitted on the rows before ``until``."""
    store = ml.Versions(spark, fresh_path(spark, "models"))
    store.put(ml.fit_state(feat(spark, d).where(f"ts < timestamp_ntz'{until}'"), ["series"], LINEAR, "y"), f"linear, rows before {until}")
    return store


@query("inference_row", "series:s ts:t return_forecast:d certainty:d kind:s leverage:d exposure:d tp_price:d sl_price:d", scored_sql(
    "2024-01-25", "SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) = 1"))
def _(spark, d):
    _, state = stored_model(spark, d, "2024-01-25").get()
    rows = ml.next_bars(hour_returns(spark, d), HOUR, linear_features, LINEAR_COLS)
    return ml.scored_bars(rows, state, ["series"], LINEAR, SETS[0])


# ---- leaderboard -------------------------------------------------------------------------------

# Models of the registry: the swept parameter sets of every series.
MODELS_SQL = f"""{SWEEP_SQL}, mreg AS MATERIALIZED (SELECT series || '-' || pid AS model_id, series, CASE WHEN pid % 7 = 0 THEN 'production' WHEN pid % 3 = 0 THEN 'staging' ELSE 'development' END AS stage0, pid, pid % 2 AS leverage_class, pid // 8 AS threshold_class,
 round(weighted_ml_accuracy, 9) AS val_metric, round(weighted_trading_accuracy, 9) AS opt_metric, est_monthly_ret AS opt_monthly_ret, n_trade_perc - 0.5 AS val_tuning, long_rate < 0.6 AS checks_pass FROM perf),
md AS MATERIALIZED (SELECT * EXCLUDE (stage0), CASE WHEN stage0 = 'production' AND row_number() OVER (PARTITION BY series, stage0 ORDER BY pid) > 1 THEN 'development' ELSE stage0 END AS stage FROM mreg)"""


@stage_table
def models(spark, d):
    p = F.col("pid")
    m = swept(spark, d).select(
        F.concat_ws("-", "series", p.cast("string")).alias("model_id"), "series",
        F.when(p % 7 == 0, "production").when(p % 3 == 0, "staging").otherwise("development").alias("stage"), "pid",
        (p % 2).alias("leverage_class"), F.floor(p / 8).alias("threshold_class"), F.round("weighted_ml_accuracy", 9).alias("val_metric"),
        F.round("weighted_trading_accuracy", 9).alias("opt_metric"), F.col("est_monthly_ret").alias("opt_monthly_ret"),
        (F.col("n_trade_perc") - 0.5).alias("val_tuning"), (F.col("long_rate") < 0.6).alias("checks_pass"))
    spare = (F.col("stage") == "production") & (F.row_number().over(Window.partitionBy("series", "stage").orderBy("pid")) > 1)
    return m.withColumn("_s", spare).withColumn("stage", F.when(F.col("_s"), "development").otherwise(F.col("stage"))).drop("_s")


@query("rank_models", "model_id:s rank:i val_metric:d", f"{MODELS_SQL} SELECT model_id, row_number() OVER (ORDER BY coalesce(val_metric, 0) DESC, model_id) AS rank, val_metric FROM md")
def _(spark, d):
    return lb.rank_models(models(spark, d), "val_metric")


@query("dedup_models", "model_id:s val_metric:d", f"{MODELS_SQL} SELECT model_id, val_metric FROM md QUALIFY row_number() OVER (PARTITION BY series, leverage_class, threshold_class ORDER BY coalesce(val_metric, 0) DESC, model_id) = 1")
def _(spark, d):
    return lb.dedup_models(models(spark, d), ["series", "leverage_class", "threshold_class"], "val_metric")


@query("promote_stages", "model_id:s stage:s new_stage:s", f"""{MODELS_SQL}, ot AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY coalesce(val_metric, 0) DESC, model_id) AS rv FROM md WHERE stage <> 'production'),
sg AS (SELECT *, rv <= 6 AND checks_pass AS staged FROM ot), ch AS (SELECT * FROM sg WHERE staged QUALIFY row_number() OVER (PARTITION BY series ORDER BY coalesce(opt_metric, 0) DESC, model_id) = 1), cp AS (SELECT * FROM md WHERE stage = 'production'),
wi AS (SELECT coalesce(ch.series, cp.series) AS series, CASE WHEN cp.model_id IS NULL OR (ch.opt_metric > cp.opt_metric AND ch.opt_monthly_ret > 1.05 * cp.opt_monthly_ret) THEN ch.model_id ELSE cp.model_id END AS winner FROM ch FULL OUTER JOIN cp ON cp.series = ch.series),
rs2 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY coalesce(val_metric, 0) DESC, model_id) AS rd FROM sg WHERE NOT staged),
al AS (SELECT model_id, series, stage, staged, NULL AS rd, val_tuning FROM sg WHERE staged UNION ALL SELECT model_id, series, stage, staged, rd, val_tuning FROM rs2 UNION ALL SELECT model_id, series, stage, true, NULL, val_tuning FROM cp)
SELECT model_id, stage, CASE WHEN model_id = winner THEN 'production' WHEN staged THEN 'staging' WHEN rd <= 5 AND val_tuning > 0 THEN 'development' ELSE 'dropped' END AS new_stage FROM al JOIN wi USING (series)""")
def _(spark, d):
    return lb.promote(models(spark, d), ["series"], 6)


@query("candidate_admission", "series:s model_id:s rank:i", f"""{MODELS_SQL} SELECT series, model_id, row_number() OVER (PARTITION BY series ORDER BY coalesce(opt_metric, 0) DESC, pid % 2 DESC, model_id) AS rank FROM md WHERE pid % 2 = 1 OR opt_metric > 0 QUALIFY rank <= 10""")
def _(spark, d):
    m = models(spark, d)
    return lb.admit(m.where("pid % 2 = 1"), m.where("pid % 2 = 0"), ["series"], "opt_metric", 10)
