"""Back-test queries (survey sections 2.12 and the state windows of 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import aggregate as ag, backtest as bt
from barloom.operators.blocks import Grid
from barloom.operators.windows import cumulative_return
from barloom.plans.base import HOUR, RET, W, hour_returns, stage_table
from barloom.plans.q_scalars import cdf_sql
from barloom.plans.q_sources import STAMP, uniform_sql
from barloom.plans.registry import query
from barloom.session import stage

PID = Grid(keys=("series", "pid"))
_BASE = {"follow_flow": True, "certainty_threshold": 0.55, "ltp": None, "stp": None, "lsl": None, "ssl": None,
         "long_permission": True, "short_permission": True, "max_leverage": 3.0, "fee": -0.0004}
SETS = [
    {**_BASE, "pid": 1, "ltp": 0.012, "stp": -0.012, "lsl": -0.016, "ssl": 0.016},
    {**_BASE, "pid": 2, "follow_flow": False, "certainty_threshold": 0.6, "lsl": -0.01, "ssl": 0.01, "short_permission": False},
]
SWEEP = [
    {**_BASE, "pid": i, "follow_flow": f, "certainty_threshold": t, "ltp": tp, "stp": None if tp is None else -tp, "lsl": -0.015, "ssl": 0.015, "max_leverage": lev}
    for i, (f, t, tp, lev) in enumerate((f, t, tp, lev) for f in (True, False) for t in (0.55, 0.575, 0.6, 0.65) for tp in (0.012, None) for lev in (1.0, 3.0))
]

# Bars with moves of at most two percent made from the hourly bars.
INPUT_SQL = f"""{RET}, raw AS (SELECT series, ts, open, 0.02 * coalesce("return", 0) / (1 + abs(coalesce("return", 0))) AS r, 0.02 * (high - low) / (high + low) AS w FROM rets),
pin AS (SELECT series, ts, open, r AS real_return, open * (1 + r) AS price, greatest(open, open * (1 + r)) * (1 + w) AS high, least(open, open * (1 + r)) * (1 - w) AS low FROM raw),
mo AS (SELECT series, avg(real_return) FILTER (real_return >= 0) AS lm, stddev_samp(real_return) FILTER (real_return >= 0) AS ls, avg(real_return) FILTER (real_return < 0) AS sm, stddev_samp(real_return) FILTER (real_return < 0) AS ss FROM pin GROUP BY 1),
un AS (SELECT *, {uniform_sql("series", STAMP, "'a'")} AS ua, sqrt(-2 * ln(1 - {uniform_sql("series", STAMP, "'b'")})) * cos(2 * pi() * {uniform_sql("series", STAMP, "'c'")}) AS z FROM pin),
inp AS (SELECT u.series, ts, open, high, low, price, real_return, CASE WHEN (ua < 0.55) = (real_return >= 0) THEN abs(lm + ls * z) ELSE -abs(sm + ss * z) END AS return_forecast FROM un u JOIN mo USING (series))"""


@stage_table
def trading_input(spark, d):
    c = F.coalesce("return", F.lit(0.0))
    raw = hour_returns(spark, d).withColumns({"real_return": 0.02 * c / (1 + F.abs(c)), "_w": F.coalesce(0.02 * F.try_divide(F.col("high") - F.col("low"), F.col("high") + F.col("low")), F.lit(0.0))})
    close = F.col("open") * (1 + F.col("real_return"))
    bars = raw.select("series", "ts", "open", (F.greatest("open", close) * (1 + F.col("_w"))).alias("high"),
                      (F.least("open", close) * (1 - F.col("_w"))).alias("low"), close.alias("price"), "real_return")
    return bt.simulated_forecast(bars, ["series"])


CERT_SQL = f"""{INPUT_SQL}, rs AS (SELECT *, real_return - return_forecast AS return_residual FROM inp),
zs AS (SELECT series, avg(return_residual) AS m, stddev_pop(return_residual) AS s FROM rs GROUP BY 1),
fit AS (SELECT rs.series, avg(return_residual) AS loc, stddev_pop(return_residual) AS scale, count(*) AS n FROM rs JOIN zs USING (series) WHERE abs((return_residual - m) / s) < 2.1 GROUP BY 1),
ce0 AS (SELECT rs.*, (-return_forecast - loc) / scale AS zz FROM rs JOIN fit USING (series)),
ce AS (SELECT * EXCLUDE (zz), {cdf_sql('zz')} AS decrease_chance FROM ce0),
cert AS (SELECT *, 1 - decrease_chance AS increase_chance, greatest(1 - decrease_chance, decrease_chance) AS certainty, CASE WHEN 1 - decrease_chance >= decrease_chance THEN 'long' ELSE 'short' END AS kind FROM ce)"""


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)


def bt_sql(sets: list[dict], params: str | None = None, prefix: str = CERT_SQL) -> str:
    """The back-test with its state carried row by row in a recursive table ``st``; result table ``tab``."""
    names = list(bt.RULES)
    values = ", ".join("(" + ", ".join(_lit(s[n]) for n in names) + ")" for s in sets)
    par = params or f"SELECT s.series, v.* FROM (SELECT DISTINCT series FROM inp) s, (VALUES {values}) v({', '.join(names)})"
    return prefix.replace("WITH bars", "WITH RECURSIVE bars", 1) + f""", par AS ({par}),
nr AS MATERIALIZED (SELECT c.*, p.* EXCLUDE (series), row_number() OVER (PARTITION BY c.series, pid ORDER BY ts) AS rn, certainty > certainty_threshold AS sure FROM cert c JOIN par p ON p.series = c.series),
st AS (SELECT series, pid, rn, kind AS flow, sure AS sig, coalesce(CASE WHEN kind = 'long' THEN high > open * (1 + ltp) ELSE low < open * (1 + stp) END, false) AS tp, coalesce(CASE WHEN kind = 'long' THEN low < open * (1 + lsl) ELSE high > open * (1 + ssl) END, false) AS sl FROM nr WHERE rn = 1
 UNION ALL SELECT n.series, n.pid, n.rn, n.fl, n.sure OR (n.follow_flow AND n.psig AND NOT n.ptp AND NOT n.psl),
 coalesce(CASE WHEN n.sd = 'long' THEN high > open * (1 + ltp) ELSE low < open * (1 + stp) END, false), coalesce(CASE WHEN n.sd = 'long' THEN low < open * (1 + lsl) ELSE high > open * (1 + ssl) END, false)
 FROM (SELECT q.*, CASE WHEN q.follow_flow THEN q.fl ELSE q.kind END AS sd FROM (SELECT r.*, CASE WHEN r.sure THEN r.kind ELSE s.flow END AS fl, s.sig AS psig, s.tp AS ptp, s.sl AS psl FROM st s JOIN nr r ON r.series = s.series AND r.pid = s.pid AND r.rn = s.rn + 1) q) n),
t1 AS (SELECT nr.*, st.flow, CASE WHEN follow_flow THEN st.flow ELSE kind END AS sd, st.tp AS tp_triggered, st.sl AS sl_triggered, st.sig AND CASE WHEN CASE WHEN follow_flow THEN st.flow ELSE kind END = 'long' THEN long_permission ELSE short_permission END AS trading_signal FROM nr JOIN st USING (series, pid, rn)),
t2 AS (SELECT *, CASE WHEN ltp IS NOT NULL AND stp IS NOT NULL THEN open * (1 + CASE WHEN sd = 'long' THEN ltp ELSE stp END) END AS tp_price, CASE WHEN lsl IS NOT NULL AND ssl IS NOT NULL THEN open * (1 + CASE WHEN sd = 'long' THEN lsl ELSE ssl END) END AS sl_price,
 follow_flow AND trading_signal AND NOT sure AS passive_trading, CASE WHEN trading_signal THEN greatest(0.5, least(ln(100 * certainty - 49) / ln(41) + 0.1, 1)) ELSE 0 END AS exposure, CASE WHEN certainty > 0.9 THEN max_leverage ELSE 1 END AS leverage FROM t1),
t3 AS (SELECT *, coalesce(exposure - lag(exposure) OVER pw, 0) AS exposure_adj, coalesce(lag(trading_signal) OVER pw, false) AS psig, lag(sd) OVER pw AS psd, coalesce(lag(exposure * leverage) OVER pw, 0) AS pel FROM t2 WINDOW pw AS (PARTITION BY series, pid ORDER BY ts)),
t4 AS (SELECT *, CASE WHEN trading_signal THEN CASE WHEN psig AND sd = psd THEN fee * abs(exposure_adj) * leverage WHEN psig THEN fee * pel + fee * exposure * leverage ELSE fee * exposure * leverage END + CASE WHEN tp_triggered OR sl_triggered THEN fee * exposure * leverage ELSE 0 END
 WHEN psig THEN fee * pel ELSE 0 END AS fees, CASE WHEN NOT trading_signal OR (tp_triggered AND sl_triggered) THEN 0 ELSE (CASE WHEN sd = 'long' THEN 1 ELSE -1 END) * (CASE WHEN tp_triggered THEN tp_price WHEN sl_triggered THEN sl_price ELSE price END - open) / open * exposure * leverage END AS trading_return FROM t3),
tab AS MATERIALIZED (SELECT *, trading_return + fees AS real_trading_return, exp(sum(ln(1 + trading_return + fees)) OVER (PARTITION BY series, pid ORDER BY ts)) - 1 AS total_cum_returns, trading_return + fees >= 0 AS trading_accuracy,
 CASE WHEN kind = 'long' THEN real_return >= abs(fees) ELSE real_return <= abs(fees) END AS ml_accuracy, CASE WHEN trading_signal AND kind = 'long' THEN CASE WHEN real_return > 0 THEN 'long_point' ELSE 'long_fail' END WHEN trading_signal THEN CASE WHEN real_return < 0 THEN 'short_point' ELSE 'short_fail' END WHEN kind = 'long' THEN 'long_missed' ELSE 'short_missed' END AS trade_class FROM t4)"""


BT_SQL = bt_sql(SETS)


@stage_table
def certain_rows(spark, d):
    """Bars under both parameter sets with the chances of their forecast."""
    rows = bt.residuals(trading_input(spark, d))
    return bt.certainty(bt.with_rules(rows, SETS), bt.fit_normal(rows, ["series"]), ["series"])


@stage_table
def flowed(spark, d):
    return bt.position_flow(certain_rows(spark, d), PID)


@stage_table
def charged(spark, d):
    """Signals, exposure and fees of every bar."""
    return bt.fees(bt.exposures(bt.trading_signal(bt.take_profit_stop_loss(flowed(spark, d)), PID)), PID)


@stage_table
def table(spark, d):
    """Back-test table of both parameter sets."""
    return bt.cumulative_return(bt.returns(charged(spark, d)), PID, "real_trading_return", "total_cum_returns")


LAYOUT = ("series:s pid:i ts:t open:d high:d low:d price:d return_forecast:d real_return:d return_residual:d increase_chance:d decrease_chance:d certainty:d kind:s "
          "tp_price:d sl_price:d tp_triggered:b sl_triggered:b trading_signal:b passive_trading:b flow:s exposure:d exposure_adj:d leverage:d fees:d "
          "trading_return:d real_trading_return:d total_cum_returns:d ml_accuracy:b trading_accuracy:b trade_class:s")


def _part(key: str, columns: str, build):
    """A query on one step of the back-test."""
    layout = "series:s pid:i ts:t " + " ".join(p for p in LAYOUT.split() if p.split(":")[0] in columns.split())
    query(key, layout, BT_SQL + " SELECT * FROM tab")(build)


@query("backtest_table", LAYOUT, BT_SQL + " SELECT * FROM tab")
def _(spark, d):
    rows = trading_input(spark, d)
    return bt.backtest(bt.with_rules(rows, SETS), PID, bt.fit_normal(bt.residuals(rows), ["series"]), ["series"])


_part("position_flow", "flow", lambda spark, d: bt.position_flow(certain_rows(spark, d), PID))
_part("take_profit_stop_loss", "tp_price sl_price tp_triggered sl_triggered", lambda spark, d: bt.take_profit_stop_loss(flowed(spark, d)))
_part("trading_signal", "trading_signal", lambda spark, d: bt.trading_signal(bt.take_profit_stop_loss(flowed(spark, d)), PID))
_part("passive_trading", "passive_trading", lambda spark, d: bt.trading_signal(bt.take_profit_stop_loss(flowed(spark, d)), PID))
_part("fees_by_transition", "fees exposure_adj", lambda spark, d: bt.fees(bt.exposures(bt.trading_signal(bt.take_profit_stop_loss(flowed(spark, d)), PID)), PID))
_part("trading_return", "trading_return", lambda spark, d: bt.returns(charged(spark, d)))
_part("real_trading_return", "real_trading_return total_cum_returns", lambda spark, d: bt.cumulative_return(bt.returns(charged(spark, d)), PID, "real_trading_return", "total_cum_returns"))
_part("accuracy_flags", "trading_accuracy ml_accuracy", lambda spark, d: bt.returns(charged(spark, d)))
_part("trade_class", "trade_class", lambda spark, d: bt.returns(charged(spark, d)))


@query("linear_return_weight", "series:s pid:i ts:t ret_weight:d weighted:d", f"""{BT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series, pid ORDER BY ts) / CAST(count(*) OVER (PARTITION BY series, pid) AS DOUBLE) AS q FROM tab WHERE trading_signal)
SELECT series, pid, ts, 0.8 + q * 0.4 AS ret_weight, (0.8 + q * 0.4) * real_trading_return AS weighted FROM n""")
def _(spark, d):
    traded = stage(table(spark, d).where("trading_signal"))
    return bt.return_weights(traded, PID, 1.5).withColumn("weighted", F.col("ret_weight") * F.col("real_trading_return"))


@query("simulated_forecast", "series:s ts:t return_forecast:d", f"{INPUT_SQL} SELECT * FROM inp")
def _(spark, d):
    return trading_input(spark, d)


@query("forecast_residual", "series:s ts:t return_residual:d", f"{INPUT_SQL} SELECT series, ts, real_return - return_forecast AS return_residual FROM inp")
def _(spark, d):
    return bt.residuals(trading_input(spark, d))


@query("fit_residual_normal", "series:s loc:d scale:d n:i", f"{CERT_SQL} SELECT * FROM fit")
def _(spark, d):
    return bt.fit_normal(bt.residuals(trading_input(spark, d)), ["series"])


def _simpson(f: str, upto: str, n: int = 2000) -> str:
    """Integral of ``f`` (of ``@``) from 0 to ``upto``."""
    return f"(({upto}) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f.replace('@', f'(i * ({upto}) / {n})')})))"


# Regularized incomplete gamma and beta functions, after the substitutions by a square and by the square of a sine: no end of the integrals is steep.
_GAMMA = f"2 * exp(-lgamma(gk)) * {_simpson('pow(@, 2 * gk - 1) * exp(-@ * @)', 'sqrt(gx)')}"
_BETA = f"2 * exp(lgamma(ba + bb) - lgamma(ba) - lgamma(bb)) * {_simpson('pow(sin(@), 2 * ba - 1) * pow(cos(@), 2 * bb - 1)', 'asin(sqrt(bt))')}"


@query("fit_residual_best", "series:s family:s distance:d best:b", f"""{CERT_SQL}, k AS MATERIALIZED (SELECT rs.series, return_residual AS x FROM rs JOIN zs USING (series) WHERE abs((return_residual - m) / s) < 2.1),
e AS (SELECT series, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM k GROUP BY 1), g AS (SELECT k.series, avg(ln(x - lo + 0.01 * (hi - lo))) AS lm, stddev_pop(ln(x - lo + 0.01 * (hi - lo))) AS ls FROM k JOIN e USING (series) GROUP BY 1),
v AS (SELECT k.series, x, n, lo, hi, m, s, lm, ls, (x - m) / s AS z1, (ln(x - lo + 0.01 * (hi - lo)) - lm) / ls AS z2, pow(m - lo + 0.01 * (hi - lo), 2) / (s * s) AS gk, (x - lo + 0.01 * (hi - lo)) * (m - lo + 0.01 * (hi - lo)) / (s * s) AS gx,
 (x - lo) / (hi - lo) AS bt, (m - lo) / (hi - lo) AS b1, (m - lo) * (hi - m) / (s * s) - 1 AS bc, rank() OVER (PARTITION BY k.series ORDER BY x) - 1 AS a, count(*) OVER (PARTITION BY k.series ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM k JOIN e USING (series) JOIN g USING (series)),
w AS (SELECT *, b1 * bc AS ba, (1 - b1) * bc AS bb FROM v),
f AS (SELECT series, x, n, a, b, unnest(['norm', 'expon', 'uniform', 'lognorm', 'gamma', 'beta']) AS family, unnest([{cdf_sql('z1')}, 1 - exp(-(x - lo) / (m - lo)), (x - lo) / (hi - lo), {cdf_sql('z2')}, {_GAMMA}, {_BETA}]) AS c FROM w),
dd AS (SELECT series, family, max(greatest(abs(b / CAST(n AS DOUBLE) - c), abs(c - a / CAST(n AS DOUBLE)))) AS distance FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY series ORDER BY distance, family) = 1 AS best FROM dd""")
def _(spark, d):
    return bt.fit_best(bt.residuals(trading_input(spark, d)), ["series"])


@query("forecast_certainty", "series:s ts:t decrease_chance:d increase_chance:d certainty:d kind:s", f"{CERT_SQL} SELECT * FROM cert")
def _(spark, d):
    rows = bt.residuals(trading_input(spark, d))
    return bt.certainty(rows, bt.fit_normal(rows, ["series"]), ["series"])


# Two-sided p-value of Student's t by numeric integration of its density.
def t_sql(t: str, v: str) -> str:
    h = f"(abs({t}) / 4000)"
    f = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * pow(1 + pow(i * {h}, 2) / {v}, -({v} + 1) / 2.0)"
    return f"(1 - 2 * {h} / 3 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f})))"


def measure_sql(prefix: str) -> str:
    """Performance rows as table ``perf``."""
    return f"""{prefix}, ms AS (SELECT series, pid, avg(real_trading_return) AS m, stddev_samp(real_trading_return) AS s FROM tab WHERE trading_signal GROUP BY 1, 2),
sm AS (SELECT t.*, CASE WHEN real_trading_return > m + 1.96 * s THEN m + 1.96 * s + (real_trading_return - m - 1.96 * s) * 0.4 WHEN real_trading_return < m - 1.96 * s THEN m - 1.96 * s - (m - 1.96 * s - real_trading_return) * 0.4 ELSE real_trading_return END AS rt FROM tab t JOIN ms USING (series, pid)),
li AS (SELECT series, pid, regr_slope(total_cum_returns, rn) AS b, regr_intercept(total_cum_returns, rn) AS a FROM tab GROUP BY 1, 2),
se AS (SELECT t.series, t.pid, sqrt(avg(pow(total_cum_returns - a - b * rn, 2))) AS rmse, any_value(b) * 720 AS est FROM tab t JOIN li USING (series, pid) GROUP BY 1, 2),
ag AS (SELECT series, pid, avg(ml_accuracy::INT) FILTER (certainty >= certainty_threshold) AS ml_accuracy, sum(abs(real_trading_return) * certainty) FILTER (certainty >= certainty_threshold AND ml_accuracy) / sum(abs(real_trading_return) * certainty) FILTER (certainty >= certainty_threshold) AS weighted_ml_accuracy,
 avg(trading_accuracy::INT) FILTER (trading_signal) AS trading_accuracy, coalesce(sum(abs(rt)) FILTER (trading_signal AND trading_accuracy), 0) / sum(abs(rt)) FILTER (trading_signal) AS weighted_trading_accuracy, avg(trading_signal::INT) AS n_trade_perc,
 avg(rt) FILTER (trading_signal) AS avg_real_trading_return, avg(rt) FILTER (trading_signal) / (stddev_samp(rt) FILTER (trading_signal) / sqrt(count(*) FILTER (trading_signal))) AS t, CAST(count(*) FILTER (trading_signal) - 1 AS DOUBLE) AS v,
 arg_max(total_cum_returns, ts) FILTER (trading_signal) AS cum_ret, 100 * sum(abs(return_residual)) FILTER (trading_signal) / sum(abs(real_return)) FILTER (trading_signal) AS wape,
 count(*) FILTER (trade_class = 'long_point') / nullif(count(*) FILTER (trade_class IN ('long_point', 'long_fail')), 0)::DOUBLE AS lsr, count(*) FILTER (trade_class = 'short_point') / nullif(count(*) FILTER (trade_class IN ('short_point', 'short_fail')), 0)::DOUBLE AS ssr, avg((kind = 'long')::INT) FILTER (trading_signal) AS long_rate FROM sm GROUP BY 1, 2),
perf AS MATERIALIZED (SELECT ag.* EXCLUDE (t, v), est AS est_monthly_ret, rmse / est AS est_stand_error, est / (rmse / est) AS est_sharpe_ratio, CASE WHEN t > 0 THEN {t_sql('t', 'v')} / 2 ELSE 1 END AS ret_pvalue FROM ag JOIN se USING (series, pid))"""


PERF_SQL = measure_sql(BT_SQL)


def performance(spark, d):
    return bt.metrics(bt.measure(table(spark, d), PID))


def _measured(key: str, columns: str):
    query(key, "series:s pid:i " + " ".join(f"{c}:d" for c in columns.split()), PERF_SQL + " SELECT * FROM perf")(lambda spark, d: performance(spark, d))


_measured("trend_return_metrics", "est_monthly_ret est_stand_error est_sharpe_ratio")
_measured("accuracy_metrics", "ml_accuracy weighted_ml_accuracy trading_accuracy weighted_trading_accuracy")
_measured("trade_metrics", "n_trade_perc ret_pvalue cum_ret avg_real_trading_return wape lsr ssr long_rate")


@query("smooth_returns", "series:s pid:i ts:t ret:d", f"""{BT_SQL}, ms AS (SELECT series, pid, avg(real_trading_return) AS m, stddev_samp(real_trading_return) AS s FROM tab WHERE trading_signal GROUP BY 1, 2)
SELECT series, pid, ts, CASE WHEN x > m + 1.96 * s THEN m + 1.96 * s + (x - m - 1.96 * s) * 0.4 WHEN x < m - 1.96 * s THEN m - 1.96 * s - (m - 1.96 * s - x) * 0.4 ELSE x END AS ret FROM (SELECT *, real_trading_return AS x FROM tab WHERE trading_signal) JOIN ms USING (series, pid)""")
def _(spark, d):
    traded = table(spark, d).where("trading_signal")
    m = traded.groupBy("series", "pid").agg(F.avg("real_trading_return").alias("m"), F.stddev_samp("real_trading_return").alias("s"))
    return traded.join(m, ["series", "pid"]).withColumn("ret", bt.smooth(F.col("real_trading_return"), F.col("m"), F.col("s")))


_GATE = "est_monthly_ret > 0.12 AND ml_accuracy > 0.51 AND weighted_ml_accuracy > 0.51 AND trading_accuracy > 0.51 AND weighted_trading_accuracy > 0.51 AND cum_ret > 0.12 AND ret_pvalue < 0.15"


def _score(acc: str, cap: str, div: int) -> str:
    reward = "round(round(est_monthly_ret * 100, 3) * greatest(0, 1 - est_stand_error), 3)"
    return f"(round_even({acc} * 100, 0) - 50) * n_trade_perc * (1 - ret_pvalue) + {cap.format(reward)} / {div}"


_METRICS = f"""SELECT *, {_GATE} AS meets_minimum, CASE WHEN {_GATE} THEN {_score('weighted_ml_accuracy', '{}', 9)} ELSE 0 END AS tuning_metric,
 CASE WHEN {_GATE} THEN {_score('weighted_trading_accuracy', 'least(100, {})', 7)} ELSE 0 END AS trading_metric FROM perf"""


@query("minimum_criteria", "series:s pid:i meets_minimum:b", f"{PERF_SQL} {_METRICS}")
def _(spark, d):
    return performance(spark, d)


@query("tuning_metric", "series:s pid:i tuning_metric:d", f"{PERF_SQL} {_METRICS}")
def _(spark, d):
    return performance(spark, d)


@query("trading_metric", "series:s pid:i trading_metric:d", f"{PERF_SQL} {_METRICS}")
def _(spark, d):
    return performance(spark, d)


SWEEP_SQL = measure_sql(bt_sql(SWEEP))


@stage_table
def swept(spark, d):
    return bt.sweep(trading_input(spark, d), HOUR, SWEEP)


@query("parameter_sweep", "series:s pid:i trading_metric:d avg_real_trading_return:d weighted_trading_accuracy:d", f"""{SWEEP_SQL} SELECT * FROM ({_METRICS}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(trading_metric, 12) DESC, round(avg_real_trading_return, 12) DESC NULLS LAST, pid) = 1""")
def _(spark, d):
    return bt.best_sets(swept(spark, d), ["series"])


_RULES = {**_BASE, "follow_flow": False, "max_leverage": 1.0}
# Per field: its side of the pair, the fixed rate of the other side, and where candidates come from.
_PAIRS = {"ltp": ("stp", -0.9), "lsl": ("ssl", 1.0), "stp": ("ltp", 1.0), "ssl": ("lsl", -0.9)}


def _search_sql() -> str:
    """Every candidate of every field as a parameter set of the whole back-test; field and quantile make the id."""
    cand, sets = [], []
    for i, (n, f) in enumerate(bt.STOP_FIELDS.items()):
        qs = list(f.quantiles)
        cand.append(f"""SELECT series, '{n}' AS field, {100 * i} + unnest(range(1, {len(qs) + 1})) AS pid, unnest({qs!r}::DOUBLE[]) AS q, unnest(quantile_cont({f.extreme} / open - 1, {qs!r})) AS value FROM inp WHERE real_return {'>=' if f.of_long else '<'} 0 GROUP BY series""")
        fixed = {**_RULES, _PAIRS[n][0]: _PAIRS[n][1]}
        sets.append("SELECT series, CAST(pid AS INT) AS pid, " + ", ".join(
            f"value AS {c}" if c == n else f"CAST({_lit(fixed[c])} AS {'BOOLEAN' if t == 'boolean' else 'DOUBLE'}) AS {c}" for c, t in bt.RULES.items() if c != "pid") + f" FROM cand WHERE field = '{n}'")
    text = bt_sql([], " UNION ALL ".join(sets)).replace(", par AS (", f", cand AS MATERIALIZED ({' UNION ALL '.join(cand)}), par AS (", 1)
    return f"""{text}, ms AS (SELECT series, pid, avg(real_trading_return) AS m, stddev_samp(real_trading_return) AS s FROM tab WHERE trading_signal GROUP BY 1, 2),
sc AS (SELECT series, pid, avg(CASE WHEN x > m + 1.96 * s THEN m + 1.96 * s + (x - m - 1.96 * s) * 0.4 WHEN x < m - 1.96 * s THEN m - 1.96 * s - (m - 1.96 * s - x) * 0.4 ELSE x END) FILTER (trading_signal) AS avg_real_trading_return, avg((trading_signal AND (tp_triggered OR sl_triggered))::INT) AS triggers
 FROM (SELECT *, real_trading_return AS x FROM tab) JOIN ms USING (series, pid) GROUP BY 1, 2)
SELECT series, field, q, value, avg_real_trading_return, triggers FROM sc JOIN cand USING (series, pid) QUALIFY row_number() OVER (PARTITION BY series, field ORDER BY round(avg_real_trading_return, 12) DESC NULLS LAST, q) = 1"""


@query("threshold_search", "series:s field:s q:d value:d avg_real_trading_return:d triggers:d", _search_sql())
def _(spark, d):
    return bt.threshold_search(trading_input(spark, d), HOUR, _RULES)


@query("backtest_extend", "series:s pid:i ts:t certainty:d trading_signal:b total_cum_returns:d", BT_SQL.replace(
    "FROM rs JOIN zs USING (series) WHERE abs((return_residual - m) / s) < 2.1 GROUP BY 1)", "FROM rs JOIN zs USING (series) WHERE abs((return_residual - m) / s) < 2.1 AND ts < TIMESTAMP '2024-01-24' GROUP BY 1)").replace(
    "stddev_pop(return_residual) AS s FROM rs GROUP BY 1)", "stddev_pop(return_residual) AS s FROM rs WHERE ts < TIMESTAMP '2024-01-24' GROUP BY 1)") + " SELECT * FROM tab")
def _(spark, d):
    x = trading_input(spark, d)
    old, new = x.where("ts < timestamp_ntz'2024-01-24'"), x.where("ts >= timestamp_ntz'2024-01-24'")
    fit = stage(bt.fit_normal(bt.residuals(old), ["series"]))
    return bt.extend(bt.with_rules(old, SETS), bt.with_rules(new, SETS), PID, fit, ["series"])


RES_SQL = f"{INPUT_SQL}, rs AS (SELECT *, real_return - return_forecast AS x, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM inp)"


@query("residual_correlation", "series:s correlation:d", f"{RES_SQL} SELECT series, corr(return_forecast, x) AS correlation FROM rs GROUP BY 1")
def _(spark, d):
    return bt.residual_correlation(bt.residuals(trading_input(spark, d)), ["series"])


@query("residual_drift", "series:s t:d p_value:d alpha:d beta:d", f"""{RES_SQL}, y AS (SELECT series, k, n, x + CASE WHEN series = 'view' THEN 0.00001 * k ELSE 0 END AS x FROM rs),
h AS (SELECT series, count(*) FILTER (k < n - n // 2) AS n1, count(*) FILTER (k >= n - n // 2) AS n2, avg(x) FILTER (k < n - n // 2) AS m1, avg(x) FILTER (k >= n - n // 2) AS m2, var_samp(x) FILTER (k < n - n // 2) AS v1, var_samp(x) FILTER (k >= n - n // 2) AS v2, regr_intercept(x, k) AS a, regr_slope(x, k) AS b FROM y GROUP BY 1),
t AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS v FROM h), p AS (SELECT *, {t_sql('t', 'v')} AS p_value FROM t)
SELECT series, t, p_value, CASE WHEN p_value < 0.05 THEN a END AS alpha, CASE WHEN p_value < 0.05 THEN b END AS beta FROM p""")
def _(spark, d):
    rows = stage(bt.residuals(trading_input(spark, d)))
    start = rows.groupBy("series").agg(F.min("ts").alias("_t0"))
    hours = F.timestamp_diff("HOUR", F.col("_t0"), F.col("ts"))
    bent = rows.join(start, "series").withColumn("return_residual", F.col("return_residual") + F.when(F.col("series") == "view", 0.00001 * hours).otherwise(0.0))
    return bt.residual_drift(stage(bent.select("series", "ts", "return_residual")), HOUR)


@query("residual_heteroskedasticity", "series:s f:d4 heteroskedastic:b", f"""{RES_SQL}, q AS (SELECT series, x * x AS u, real_return AS a FROM rs), r AS (SELECT series, regr_r2(u, a) AS r2, count(*) AS n FROM q GROUP BY 1)
SELECT series, r2 / ((1 - r2) / (n - 2)) AS f, r2 / ((1 - r2) / (n - 2)) > 3.8548 AS heteroskedastic FROM r""")
def _(spark, d):
    return bt.heteroskedasticity(bt.residuals(trading_input(spark, d)), ["series"], ["real_return"])


@query("residual_autocorrelation", "series:s lag:i acf:d q:d4", f"""{RES_SQL}, c AS (SELECT series, k, x - avg(x) OVER (PARTITION BY series) AS c, n FROM rs), z AS (SELECT series, sum(c * c) AS c0, any_value(n) AS n FROM c GROUP BY 1),
l AS (SELECT a.series, a.k - b.k AS lag, sum(a.c * b.c) / any_value(c0) AS acf, any_value(z.n) AS n FROM c a JOIN c b ON b.series = a.series AND b.k BETWEEN a.k - 10 AND a.k - 1 JOIN z ON z.series = a.series GROUP BY 1, 2)
SELECT series, lag, acf, n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY series ORDER BY lag) AS q FROM l""")
def _(spark, d):
    return bt.autocorrelation(bt.residuals(trading_input(spark, d)), HOUR)


_ZQ = {"50": 0.6744897501960817, "10": 1.6448536269514722, "5": 1.959963984540054}


@query("cumulative_return_forecast", "series:s pid:i ts:t forecast:d " + " ".join(f"lower_{a}:d upper_{a}:d" for a in _ZQ), f"""{BT_SQL}, f AS (SELECT series, pid, regr_slope(total_cum_returns, rn) AS b, regr_intercept(total_cum_returns, rn) AS a, count(*) AS n, max(ts) AS last FROM tab GROUP BY 1, 2),
e AS (SELECT t.series, t.pid, sqrt(avg(pow(total_cum_returns - a - b * rn, 2))) AS se FROM tab t JOIN f USING (series, pid) GROUP BY 1, 2),
s AS (SELECT *, unnest(range(1, 25)) AS k FROM f), l AS (SELECT series, pid, last + to_hours(CAST(k AS INT)) AS ts, b * (k - 1) - (a + b * (n + 24)) * 0.1 * (k - 1) / 23.0 AS y FROM s)
SELECT l.*, y AS forecast, {", ".join(f"y - {z} * se AS lower_{a}, y + {z} * se AS upper_{a}" for a, z in _ZQ.items())} FROM l JOIN e USING (series, pid)""")
def _(spark, d):
    return bt.cumulative_forecast(table(spark, d), PID, 24, 0.1)


@query("returns_curve", "series:s pid:i ts:t part:s curve:d", f"""{BT_SQL}, c AS (SELECT series, pid, ts, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'validation' ELSE 'optimized' END AS part, real_trading_return AS x FROM tab)
SELECT series, pid, ts, part, 100 * (exp(sum(ln(1 + x)) OVER (PARTITION BY series, pid ORDER BY ts)) - 1) AS curve FROM c""")
def _(spark, d):
    t = table(spark, d)
    val = t.where("ts < timestamp_ntz'2024-01-15'").withColumn("part", F.lit("validation"))
    opt = t.where("ts >= timestamp_ntz'2024-01-15'").withColumn("part", F.lit("optimized"))
    both = val.unionByName(opt).select("series", "pid", "ts", "part", "real_trading_return")
    return cumulative_return(both, PID, "real_trading_return", "_c").withColumn("curve", 100 * F.col("_c"))
