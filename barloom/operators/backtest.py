"""Back-test of long/short rules on forecasts: one plan for all series and parameter sets.

Input rows: keys, ts, ``return_forecast, real_return, open, high, low, price`` and a struct column
``param`` (see ``RULES``). A position only depends on the last certain row and on the last stop before
it, so the row-by-row loop of the method becomes carried positions (``blocks.running``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import stats
from barloom.functions.scalars import exposure, normal_cdf
from barloom.functions.time import epoch_seconds
from barloom.operators.aggregate import exact_quantiles, value_ranks
from barloom.operators.blocks import Grid, bounded, row_numbers, running
from barloom.operators.project import zscore_filter
from barloom.operators.windows import cumulative_return
from barloom.session import join_staged, stage
from barloom.sources.ingest import key_uniform

# Fields of a parameter set. Take profit and stop loss are rates for long and short sides, or null.
RULES = {
    "pid": "int", "follow_flow": "boolean", "certainty_threshold": "double", "ltp": "double", "stp": "double", "lsl": "double",
    "ssl": "double", "long_permission": "boolean", "short_permission": "boolean", "max_leverage": "double", "fee": "double",
}


def parameter_sets(rows: Sequence[dict]) -> Column:
    """Literal array of parameter sets."""
    return F.array(*[F.struct(*[F.lit(r[k]).cast(t).alias(k) for k, t in RULES.items()]) for r in rows])


def with_rules(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Every bar under every parameter set of a fixed list, with ``pid`` as key column."""
    return df.withColumn("param", F.explode(parameter_sets(rows))).withColumn("pid", F.col("param.pid"))


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("return_residual", F.col("real_return") - F.col("return_forecast"))


def fit_normal(df: DataFrame, keys: Sequence[str], limit: float = 2.1, least: int = 30) -> DataFrame:
    """Mean and population deviation of the residuals within ``limit`` deviations; null below ``least`` rows."""
    kept = zscore_filter(df.where(F.col("return_residual").isNotNull()), keys, "return_residual", limit)
    enough = F.count(F.lit(1)) >= least
    return kept.groupBy(*keys).agg(
        F.when(enough, F.avg("return_residual")).alias("loc"), F.when(enough, F.stddev_pop("return_residual")).alias("scale"),
        F.count(F.lit(1)).alias("n"))


FAMILIES = ("norm", "expon", "uniform", "lognorm", "gamma", "beta")


def fit_best(df: DataFrame, keys: Sequence[str], limit: float = 2.1, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Kolmogorov-Smirnov distance of the residuals to each fitted family, the closest one marked ``best``.

    Fits are closed form: moments, or the ends of the range. Log-normal and gamma start 1 % of the range
    below the minimum. All families see the same rows, so the smallest distance has the largest p-value.
    """
    kept = stage(zscore_filter(df.where(F.col("return_residual").isNotNull()), keys, "return_residual", limit).select(*keys, "return_residual"))
    x = F.col("return_residual")
    ends = kept.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.count(F.lit(1)).alias("_n"))
    start = F.col("_lo") - 0.01 * (F.col("_hi") - F.col("_lo"))
    logs = join_staged(kept, ends, keys).groupBy(*keys).agg(F.avg(F.ln(x - start)).alias("_lm"), F.stddev_pop(F.ln(x - start)).alias("_ls"))
    fit = stage(ends.join(logs, list(keys)))
    v = F.col("_v")
    span = F.col("_hi") - F.col("_lo")
    var = F.col("_s") * F.col("_s")
    mean0 = F.col("_m") - start
    mean1, var1 = F.try_divide(F.col("_m") - F.col("_lo"), span), F.try_divide(var, span * span)
    common = F.try_divide(mean1 * (1 - mean1), var1) - 1
    cdf = {
        "norm": lambda: normal_cdf(F.try_divide(v - F.col("_m"), F.col("_s"))),
        "expon": lambda: 1 - F.exp(-F.try_divide(v - F.col("_lo"), F.col("_m") - F.col("_lo"))),
        "uniform": lambda: F.try_divide(v - F.col("_lo"), span),
        "lognorm": lambda: normal_cdf(F.try_divide(F.ln(v - start) - F.col("_lm"), F.col("_ls"))),
        "gamma": lambda: stats.gamma_cdf(F.try_divide((v - start) * mean0, var), F.try_divide(mean0 * mean0, var)),
        "beta": lambda: stats.beta_cdf(F.try_divide(v - F.col("_lo"), span), mean1 * common, (1 - mean1) * common),
    }
    ranked = value_ranks(kept, keys, "return_residual").join(fit, list(keys)).withColumns({f"_f_{f}": cdf[f]() for f in families})
    above, below = (F.col("_last") + 1) / F.col("_total"), F.col("_first") / F.col("_total")
    wide = ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *[
        F.max(F.greatest(F.abs(above - F.col(f"_f_{f}")), F.abs(F.col(f"_f_{f}") - below))).alias(f) for f in families])
    long = wide.unpivot([*keys, "n"], list(families), "family", "distance").withColumn("p_value", stats.kolmogorov_upper(F.col("distance"), F.col("n")))
    w = Window.partitionBy(*keys).orderBy("distance", "family")
    return long.withColumn("best", F.row_number().over(w) == 1)


def certainty(df: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chances of a fall and a rise given the residual distribution, the larger one and its side."""
    both = join_staged(df, fit.select(*keys, "loc", "scale"), keys)
    chance = normal_cdf(F.try_divide(-F.col("return_forecast") - F.col("loc"), F.col("scale")))
    out = both.withColumn("decrease_chance", chance).withColumn("increase_chance", 1 - F.col("decrease_chance"))
    return out.withColumn("certainty", F.greatest("increase_chance", "decrease_chance")).withColumn(
        "kind", F.when(F.col("increase_chance") >= F.col("decrease_chance"), "long").otherwise("short")).drop("loc", "scale")


def _certain() -> Column:
    return F.col("certainty") > F.col("param.certainty_threshold")


def side() -> Column:
    """Side the position follows: the flow, or the kind of the bar."""
    return F.when(F.col("param.follow_flow"), F.col("flow")).otherwise(F.col("kind"))


def position_flow(df: DataFrame, g: Grid) -> DataFrame:
    """Flow (side kept until an opposite certain one) and the position of the last certain row."""
    placed = stage(df.withColumn("_at", F.floor(epoch_seconds(g.ts) / g.step)))
    out = running(placed, g, {
        "_turn": ("last", F.when(_certain(), F.col("kind"))), "_open": ("opening", F.col("kind")),
        "_sure": ("last", F.when(_certain(), F.col("_at"))),
    })
    return out.withColumn("flow", F.coalesce("_turn", "_open")).drop("_turn", "_open")


def take_profit_stop_loss(df: DataFrame) -> DataFrame:
    """Take-profit and stop-loss prices of the bar and whether its high or low reached them."""
    p, long = F.col("param"), side() == "long"
    target = lambda a, b: F.when(p[a].isNotNull() & p[b].isNotNull(), F.col("open") * (1 + F.when(long, p[a]).otherwise(p[b])))
    out = df.withColumns({"tp_price": target("ltp", "stp"), "sl_price": target("lsl", "ssl")})
    hit = lambda long_hit, short_hit: F.coalesce(F.when(long, long_hit).otherwise(short_hit), F.lit(False))
    return out.withColumns({
        "tp_triggered": hit(F.col("high") > F.col("tp_price"), F.col("low") < F.col("tp_price")),
        "sl_triggered": hit(F.col("low") < F.col("sl_price"), F.col("high") > F.col("sl_price")),
    })


def trading_signal(df: DataFrame, g: Grid) -> DataFrame:
    """Position on or off. Following the flow it stays on after a certain row until a bar hits a stop."""
    hit = F.col("tp_triggered") | F.col("sl_triggered")
    out = running(df, g, {"_stop": ("last_before", F.when(hit, F.col("_at")))})
    held = F.col("_sure").isNotNull() & (F.col("_stop").isNull() | (F.col("_stop") < F.col("_sure")))
    p = F.col("param")
    allowed = F.when(side() == "long", p["long_permission"]).otherwise(p["short_permission"])
    out = out.withColumn("trading_signal", F.when(p["follow_flow"], held).otherwise(_certain()) & allowed)
    return out.withColumn("passive_trading", p["follow_flow"] & F.col("trading_signal") & ~_certain()).drop("_stop", "_sure", "_at")


def exposures(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "exposure": exposure(F.col("certainty"), F.col("trading_signal")),
        "leverage": F.when(F.col("certainty") > 0.9, F.col("param.max_leverage")).otherwise(1.0),
    })


def fees(df: DataFrame, g: Grid) -> DataFrame:
    """Fee of the bar from the change of position, and the change of exposure."""
    fee = F.col("param.fee")
    paid = fee * F.col("exposure") * F.col("leverage")

    def exprs(w) -> dict[str, Column]:
        was = F.coalesce(F.lag("trading_signal").over(w), F.lit(False))
        before = F.coalesce(F.lag(fee * F.col("exposure") * F.col("leverage")).over(w), F.lit(0.0))
        change = F.coalesce(F.col("exposure") - F.lag("exposure").over(w), F.lit(0.0))
        kept = F.lag(side()).over(w) == side()
        opened = F.when(was & kept, fee * F.abs(change) * F.col("leverage")).when(was, before + paid).otherwise(paid)
        forced = F.when(F.col("tp_triggered") | F.col("sl_triggered"), paid).otherwise(0.0)
        return {
            "exposure_adj": change,
            "fees": F.when(F.col("trading_signal"), opened + forced).when(was, before).otherwise(0.0),
        }
    return bounded(df, g, exprs, back=1)


def returns(df: DataFrame) -> DataFrame:
    """Trading return of the bar (0 when both stops were hit), with fees, and its accuracy flags and class."""
    exit_price = (
        F.when(F.col("tp_triggered") & F.col("sl_triggered"), F.col("open")).when(F.col("tp_triggered"), F.col("tp_price"))
        .when(F.col("sl_triggered"), F.col("sl_price")).otherwise(F.col("price"))
    )
    move = F.try_divide(exit_price - F.col("open"), F.col("open")) * F.col("exposure") * F.col("leverage")
    signed = F.when(F.col("trading_signal"), F.when(side() == "long", move).otherwise(-move)).otherwise(0.0)
    out = df.withColumn("trading_return", signed).withColumn("real_trading_return", F.col("trading_return") + F.col("fees"))
    long, r, cost = F.col("kind") == "long", F.col("real_return"), F.abs("fees")
    return out.withColumns({
        "trading_accuracy": F.col("real_trading_return") >= 0,
        "ml_accuracy": F.when(long, r >= cost).otherwise(r <= cost),
        "trade_class": F.when(F.col("trading_signal") & long, F.when(r > 0, "long_point").otherwise("long_fail"))
        .when(F.col("trading_signal"), F.when(r < 0, "short_point").otherwise("short_fail"))
        .when(long, "long_missed").otherwise("short_missed"),
    })


def backtest(df: DataFrame, g: Grid, fit: DataFrame | None = None, fit_keys: Sequence[str] | None = None) -> DataFrame:
    """The whole back-test table. ``fit`` gives stored residual parameters (else they are fitted)."""
    fit_keys = list(fit_keys or g.keys)
    rows = residuals(df)
    fit = fit if fit is not None else fit_normal(rows, fit_keys)
    flowed = stage(position_flow(certainty(rows, fit, fit_keys), g))
    signals = trading_signal(take_profit_stop_loss(flowed), g)
    traded = stage(returns(fees(exposures(signals), g)))
    return cumulative_return(traded, g, "real_trading_return", "total_cum_returns")


def smooth(x: Column, mean: Column, std: Column, share: float = 0.40) -> Column:
    """Beyond mean +- 1.96 std a share of the excess is kept."""
    high, low = mean + 1.96 * std, mean - 1.96 * std
    return F.when(x > high, high + (x - high) * share).when(x < low, low - (low - x) * share).otherwise(x)


def return_weights(df: DataFrame, g: Grid, ratio: float) -> DataFrame:
    """Weight of each row, linear in its row number, with last/first = ``ratio`` and end points adding to 2."""
    x1 = 2 / (1 + ratio)
    x2 = 2 - x1
    out = row_numbers(df, g, "_rn", "_n")
    return out.withColumn("ret_weight", x1 + F.col("_rn") / F.col("_n") * (x2 - x1)).drop("_rn", "_n")


# Columns of a back-test table that its performance needs.
MEASURED = ["trading_signal", "real_trading_return", "total_cum_returns", "certainty", "param", "ml_accuracy", "trading_accuracy",
            "return_residual", "real_return", "trade_class", "kind"]


def measure(df: DataFrame, g: Grid, smooth_returns: bool = True, month: int = 720) -> DataFrame:
    """Performance of each key in one row."""
    keys = list(g.keys)
    traded = F.col("trading_signal")
    ret = F.col("real_trading_return")
    if smooth_returns:
        m = df.where(traded).groupBy(*keys).agg(F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
        df = join_staged(df, m, keys, "left").withColumn("_ret", F.coalesce(smooth(ret, F.col("_m"), F.col("_s")), ret))
    else:
        df = df.withColumn("_ret", ret)
    x = epoch_seconds(g.ts) / g.step
    y = F.col("total_cum_returns")
    certain = F.col("certainty") >= F.col("param.certainty_threshold")
    when = lambda cond, v: F.when(cond, v)
    weight = F.abs(ret) * F.abs("certainty")
    moved = F.abs("_ret")
    cls = lambda c: F.count_if(traded & (F.col("trade_class") == c))
    share = lambda num, den: F.try_divide(num.cast("double"), den.cast("double"))
    out = df.groupBy(*keys).agg(
        (F.regr_slope(y, x) * month).alias("est_monthly_ret"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x), F.count(F.lit(1))))).alias("_rmse"),
        F.avg(when(certain, F.col("ml_accuracy").cast("double"))).alias("ml_accuracy"),
        share(F.sum(when(certain & F.col("ml_accuracy"), weight)), F.sum(when(certain, weight))).alias("weighted_ml_accuracy"),
        F.avg(when(traded, F.col("trading_accuracy").cast("double"))).alias("trading_accuracy"),
        share(F.coalesce(F.sum(when(traded & F.col("trading_accuracy"), moved)), F.lit(0.0)), F.sum(when(traded, moved))).alias("weighted_trading_accuracy"),
        F.avg(traded.cast("double")).alias("n_trade_perc"),
        F.avg(when(traded, F.col("_ret"))).alias("avg_real_trading_return"),
        F.stddev_samp(when(traded, F.col("_ret"))).alias("_std"), F.count_if(traded).alias("_n"),
        F.max_by(y, when(traded, F.col(g.ts))).alias("cum_ret"),
        (100 * share(F.sum(when(traded, F.abs("return_residual"))), F.sum(when(traded, F.abs("real_return"))))).alias("wape"),
        share(cls("long_point"), cls("long_point") + cls("long_fail")).alias("lsr"),
        share(cls("short_point"), cls("short_point") + cls("short_fail")).alias("ssr"),
        F.avg(when(traded, (F.col("kind") == "long").cast("double"))).alias("long_rate"),
    )
    t = F.try_divide(F.col("avg_real_trading_return") * F.sqrt("_n"), F.col("_std"))
    out = out.withColumn("est_stand_error", F.try_divide("_rmse", "est_monthly_ret")).withColumn("_t", t)
    out = out.withColumn("est_sharpe_ratio", F.try_divide("est_monthly_ret", "est_stand_error"))
    out = out.withColumn("_p", stats.t_two_sided(F.col("_t"), (F.col("_n") - 1).cast("double")))
    out = out.withColumn("ret_pvalue", F.when(F.col("_t") > 0, F.col("_p") / 2).otherwise(1.0))
    return out.drop("_rmse", "_std", "_n", "_t", "_p")


def meets_minimum() -> Column:
    """Gate over a performance row. The limits."""
    c = F.col
    return F.coalesce(
        (c("est_monthly_ret") > 0.12) & (c("ml_accuracy") > 0.51) & (c("weighted_ml_accuracy") > 0.51)
        & (c("trading_accuracy") > 0.51) & (c("weighted_trading_accuracy") > 0.51) & (c("cum_ret") > 0.12)
        & (c("ret_pvalue") < 0.15), F.lit(False))


def score(accuracy: str, cap: float | None, divisor: float) -> Column:
    """Accuracy points times share of trades and significance, plus the risk-reward score."""
    points = (F.rint(F.col(accuracy) * 100) - 50) * F.col("n_trade_perc") * (1 - F.col("ret_pvalue"))
    reward = F.round(F.round(F.col("est_monthly_ret") * 100, 3) * F.greatest(F.lit(0.0), 1 - F.col("est_stand_error")), 3)
    return points + (F.least(F.lit(cap), reward) if cap else reward) / divisor


def metrics(df: DataFrame) -> DataFrame:
    gate = meets_minimum()
    return df.withColumns({
        "meets_minimum": gate,
        "tuning_metric": F.when(gate, score("weighted_ml_accuracy", None, 9)).otherwise(0.0),
        "trading_metric": F.when(gate, score("weighted_trading_accuracy", 100.0, 7)).otherwise(0.0),
    })


def sweep(df: DataFrame, g: Grid, rows: Sequence[dict], fit: DataFrame | None = None) -> DataFrame:
    """Performance of every parameter set on every series, all sets in one plan."""
    keyed = Grid(keys=(*g.keys, "pid"), ts=g.ts, step=g.step, block=g.block, dense=g.dense)
    fit = fit if fit is not None else fit_normal(residuals(df), list(g.keys))
    table = backtest(with_rules(df, rows), keyed, fit, list(g.keys)).select(*keyed.keys, g.ts, *MEASURED)
    return metrics(measure(stage(table), keyed))


def best_sets(performance: DataFrame, keys: Sequence[str], metric: str = "trading_metric") -> DataFrame:
    """The parameter set with the greatest metric per key; then average return, then the lower id.

    Values equal to 12 decimals are ties, so the order of a sum does not decide.
    """
    w = Window.partitionBy(*keys).orderBy(
        F.round(metric, 12).desc_nulls_last(), F.round("avg_real_trading_return", 12).desc_nulls_last(), "pid")
    return performance.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def simulated_forecast(df: DataFrame, keys: Sequence[str], ts: str = "ts", hit_rate: float = 0.55) -> DataFrame:
    """Synthetic forecast: the right side with probability ``hit_rate``, size from a half-normal fitted to
    the returns of that side. The randomness is a hash of the key, so it is the same on every run."""
    up = F.col("real_return") >= 0
    moments = df.groupBy(*keys).agg(
        F.avg(F.when(up, F.col("real_return"))).alias("_lm"), F.stddev_samp(F.when(up, F.col("real_return"))).alias("_ls"),
        F.avg(F.when(~up, F.col("real_return"))).alias("_sm"), F.stddev_samp(F.when(~up, F.col("real_return"))).alias("_ss"))
    u = lambda salt: key_uniform(*keys, ts, salt=salt)
    normal = F.sqrt(-2 * F.ln(1 - u("b"))) * F.cos(6.283185307179586 * u("c"))
    long = F.abs(F.col("_lm") + F.col("_ls") * normal)
    short = -F.abs(F.col("_sm") + F.col("_ss") * normal)
    right = u("a") < hit_rate
    return join_staged(df, moments, keys).withColumn(
        "return_forecast", F.when(right == up, long).otherwise(short)).drop("_lm", "_ls", "_sm", "_ss")


# Per stop field: the side it ends, the extreme of the bar that reaches it, the rows and quantiles its candidates come from (fixed values),
# and the rate of the other side, far out of reach.
@dataclass(frozen=True)
class StopField:
    side: str
    extreme: str
    of_long: bool
    quantiles: tuple[float, ...]
    other: float


def _spaced(lo: float, hi: float, n: int) -> tuple[float, ...]:
    return tuple(lo + (hi - lo) * i / (n - 1) for i in range(n))


STOP_FIELDS = {
    "ltp": StopField("long", "high", True, _spaced(0.7, 0.99, 29), -0.9), "lsl": StopField("long", "low", False, _spaced(0.01, 0.15, 14), 1.0),
    "stp": StopField("short", "low", False, _spaced(0.01, 0.3, 29), 1.0), "ssl": StopField("short", "high", True, _spaced(0.85, 0.99, 14), -0.9),
}


def stop_candidates(df: DataFrame, keys: Sequence[str], fields: dict[str, StopField] = STOP_FIELDS) -> DataFrame:
    """Per key and field the candidate rates ``cands`` (structs of q, v): quantiles of how far bars that rose (or fell) went up (or down) from their open."""
    rose = F.col("real_return") >= 0
    went = [("high", True), ("low", False)]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(e).alias("extreme"), F.when(rose == up, F.try_divide(e, "open") - 1).alias("r")) for e, up in went])).alias("_w")).select(*keys, "_w.*")
    every = {e: sorted({q for f in fields.values() if f.extreme == e for q in f.quantiles}) for e, _ in went}
    qs = sorted({q for v in every.values() for q in v})
    found = exact_quantiles(long.where("r is not null"), [*keys, "extreme"], "r", qs)
    pick = lambda f: F.array(*[F.struct(F.lit(q).alias("q"), F.col("quantiles")[qs.index(q)].alias("v")) for q in f.quantiles])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(f.extreme).alias("e"), pick(f).alias("cands")) for n, f in fields.items()])
    return found.select(*keys, "extreme", F.explode(rows).alias("_c")).where("_c.e = extreme").select(*keys, "_c.field", "_c.cands")


def threshold_search(
    df: DataFrame, g: Grid, base: dict, candidates: DataFrame | None = None, smooth_returns: bool = True, fields: dict[str, StopField] = STOP_FIELDS,
) -> DataFrame:
    """For each take-profit and stop-loss field the candidate rate with the best average return: ``(keys, field, q, value, avg_real_trading_return, triggers)``.

    Only bars that are certain are traded, so all but the exit of a trade is the same for every candidate. Trades are ranked once by how many of the
    sorted candidates the bar went past; sums per rank, run from the end, are the trades that a candidate ends, and run from the front those it
    leaves alone. Neither rows nor tables are copied per candidate. Returns beyond the smoothing band of a candidate are counted in a second pass, which
    explodes those trades only. ``base`` gives the other rules; ``triggers`` is the share of all bars that a candidate ends.
    """
    keys = list(g.keys)
    if base["follow_flow"]:
        raise ValueError("following the flow, a stop changes later trades: sweep parameter sets instead")
    candidates = stage(candidates if candidates is not None else stop_candidates(df, keys, fields), "candidates")
    rules = {**base, "pid": 0, "ltp": None, "stp": None, "lsl": None, "ssl": None}
    fit = fit_normal(residuals(df), keys)
    rows = certainty(with_rules(residuals(df), [rules]).drop("pid"), fit, keys).withColumn("flow", F.col("kind"))
    permitted = F.when(side() == "long", F.col("param.long_permission")).otherwise(F.col("param.short_permission"))
    rows = rows.withColumn("trading_signal", _certain() & permitted).withColumns({"tp_triggered": F.lit(False), "sl_triggered": F.lit(False)})
    rows = stage(fees(exposures(stage(rows, "signals")), g).select(
        *keys, side().alias("side"), "trading_signal", "open", "high", "low", "price", (F.col("exposure") * F.col("leverage")).alias("size"), "fees", F.col("param.fee").alias("fee")), "trades")

    # every trade once per field; its rank is the number of candidates that end it, in the order in which bars reach them
    named = F.create_map(*[x for n, f in fields.items() for x in (F.lit(n), F.struct(F.lit(f.side).alias("side"), F.lit(f.extreme == "high").alias("high"), F.lit(f.other).alias("other")))])
    ordered = candidates.withColumn("_f", named[F.col("field")])
    far = F.when(F.col("_f.high"), F.col("v")).otherwise(-F.col("v"))
    ladder = ordered.select(*keys, "field", "_f", F.explode("cands").alias("_c")).select(*keys, "field", "_f", "_c.q", "_c.v").where("v is not null")
    ladder = ladder.withColumn("j", F.row_number().over(Window.partitionBy(*keys, "field").orderBy(far, "q")))  # at most 29 rows a key and field
    ladder = stage(ladder, "ladder")
    steps = ladder.groupBy(*keys, "field", "_f").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("steps"))
    trades = join_staged(rows.where("trading_signal"), steps.groupBy(*keys).agg(F.collect_list(F.struct("field", "_f", "steps")).alias("_fields")), keys)
    trades = trades.withColumn("_x", F.explode("_fields")).select("*", "_x.*").drop("_x", "_fields")
    passes = lambda v: F.when(F.col("_f.high"), F.col("high") > F.col("open") * (1 + v)).otherwise(F.col("low") < F.col("open") * (1 + v))
    own = F.col("side") == F.col("_f.side")
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    # the other side's exit is out of reach in all but broken prices, and then the same for every candidate
    crossed = ~own & F.when(F.col("_f.high") == (F.col("_f.side") == "long"), F.when(F.col("side") == "long", F.col("high") > F.col("open") * (1 + F.col("_f.other"))).otherwise(
        F.col("low") < F.col("open") * (1 + F.col("_f.other")))).otherwise(F.when(F.col("side") == "long", F.col("low") < F.col("open") * (1 + F.col("_f.other"))).otherwise(F.col("high") > F.col("open") * (1 + F.col("_f.other"))))
    move = F.try_divide(F.col("price") - F.col("open"), F.col("open"))
    plain = sign * F.when(crossed, F.col("_f.other")).otherwise(move) * F.col("size") + F.col("fees") + F.when(crossed, F.col("fee") * F.col("size")).otherwise(0.0)
    trades = trades.select(
        *keys, "field", F.when(own, F.size(F.filter("steps", lambda s: F.coalesce(passes(s["v"]), F.lit(False))))).otherwise(0).alias("rank"), plain.alias("plain"),
        (sign * F.col("size")).alias("slope"), (F.col("fees") + F.col("fee") * F.col("size")).alias("rest"), crossed.alias("crossed"))
    trades = stage(trades, "ranked")

    one = [*keys, "field"]
    a, b = F.col("slope"), F.col("rest")
    sums = trades.groupBy(*one, "rank").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("crossed").alias("x"), F.sum("plain").alias("p"), F.sum(F.col("plain") * F.col("plain")).alias("pp"), F.sum(a).alias("a"), F.sum(b).alias("b"),
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"))
    # sums over at most 30 ranks a key and field: candidate j ends the trades of rank j or more
    levels = ladder.select(*one, "j", "q", "v").join(stage(sums, "sums"), one, "left")
    ends = F.col("rank") >= F.col("j")
    at = lambda c: F.coalesce(F.sum(F.when(ends, F.col(c))), F.lit(0.0))
    left = lambda c: F.coalesce(F.sum(F.when(~ends, F.col(c))), F.lit(0.0))
    read = levels.groupBy(*one, "j", "q", "v").agg(
        F.sum("n").alias("n"), (at("n") + F.sum("x")).alias("hits"), (left("p") + F.col("v") * at("a") + at("b")).alias("total"),
        (left("pp") + F.col("v") * F.col("v") * at("aa") + 2 * F.col("v") * at("ab") + at("bb")).alias("squares"))
    mean = F.try_divide("total", "n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - F.col("n") * mean * mean, F.col("n") - 1)))
    read = read.withColumns({"mean": mean, "spread": spread})
    if smooth_returns:
        read = stage(read, "read")
        bands = read.groupBy(*one).agg(F.collect_list(F.struct("j", "v", (F.col("mean") - 1.96 * F.col("spread")).alias("lo"), (F.col("mean") + 1.96 * F.col("spread")).alias("hi"))).alias("bands"))
        value = lambda s: F.when(F.col("rank") >= s["j"], s["v"] * a + b).otherwise(F.col("plain"))
        beyond = lambda s: F.struct(s["j"].alias("j"), F.when(value(s) > s["hi"], s["hi"] - value(s)).when(value(s) < s["lo"], s["lo"] - value(s)).otherwise(0.0).alias("d"))
        out = join_staged(trades, bands, one).select(*one, F.explode(F.filter(F.transform("bands", beyond), lambda s: s["d"] != 0)).alias("_d")).select(*one, "_d.*")
        shrunk = out.groupBy(*one, "j").agg((0.6 * F.sum("d")).alias("shrunk"))  # 40 percent of what is beyond the band stays
        read = read.join(shrunk, [*one, "j"], "left").withColumn("mean", F.try_divide(F.col("total") + F.coalesce("shrunk", F.lit(0.0)), F.col("n")))
    bars = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"))
    best = Window.partitionBy(*one).orderBy(F.round("mean", 12).desc_nulls_last(), "q")
    out = read.join(bars, keys).withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    return out.select(*one, "q", F.col("v").alias("value"), F.col("mean").alias("avg_real_trading_return"), F.try_divide("hits", "bars").alias("triggers"))


def extend(stored: DataFrame, new: DataFrame, g: Grid, fit: DataFrame, fit_keys: Sequence[str]) -> DataFrame:
    """Append new bars and recompute with the stored residual parameters."""
    return backtest(stored.unionByName(new), g, fit, fit_keys)


def residual_correlation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr("return_forecast", "return_residual").alias("correlation"))


def residual_drift(df: DataFrame, g: Grid, level: float = 0.05) -> DataFrame:
    """t-test between the two halves of the residuals; a trend line where they differ."""
    numbered = row_numbers(df, g, "_rn", "_n")
    late = F.col("_rn") > F.col("_n") - F.floor(F.col("_n") / 2)
    x = (F.col("_rn") - 1).cast("double")
    r = F.col("return_residual")
    a = numbered.groupBy(*g.keys).agg(
        F.count_if(~late).alias("n1"), F.count_if(late).alias("n2"), F.avg(F.when(~late, r)).alias("m1"), F.avg(F.when(late, r)).alias("m2"),
        F.var_samp(F.when(~late, r)).alias("v1"), F.var_samp(F.when(late, r)).alias("v2"),
        F.regr_intercept(r, x).alias("alpha"), F.regr_slope(r, x).alias("beta"))
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double"))
    out = a.withColumn("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))))
    out = out.withColumn("p_value", stats.t_two_sided(F.col("t"), (F.col("n1") + F.col("n2") - 2).cast("double")))
    drifts = F.col("p_value") < level
    return out.select(*g.keys, "t", "p_value", F.when(drifts, F.col("alpha")).alias("alpha"), F.when(drifts, F.col("beta")).alias("beta"))


def heteroskedasticity(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Breusch-Pagan F test: do the features explain the squared residuals?

    The normal equations come from one aggregation; only a k x k system per key is solved in Python.
    """
    cols = [*features]
    k = len(cols)
    u = F.col("return_residual") * F.col("return_residual")
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    gram = [F.sum(terms[i] * terms[j]) for i in range(k + 1) for j in range(k + 1)]
    known = df.where(F.col("return_residual").isNotNull())
    for c in cols:
        known = known.where(F.col(c).isNotNull())
    sums = known.groupBy(*keys).agg(
        F.array(*gram).alias("g"), F.array(*[F.sum(t * u) for t in terms]).alias("xy"), F.sum(u * u).alias("yy"),
        F.sum(u).alias("sy"), F.count(F.lit(1)).alias("n"))

    out = sums.withColumn("f", stats.regression_f("g", "xy", "yy", "sy", "n"))
    out = out.withColumn("p_value", stats.f_upper(F.col("f"), F.lit(float(k)), (F.col("n") - k - 1).cast("double")))
    return out.select(*keys, "f", "p_value", (F.col("p_value") < 0.05).alias("heteroskedastic"))


def autocorrelation(df: DataFrame, g: Grid, lags: int = 10) -> DataFrame:
    """Autocorrelation and Ljung-Box statistic per lag."""
    m = df.groupBy(*g.keys).agg(F.avg("return_residual").alias("_m"))
    centered = join_staged(df, m, g.keys).withColumn("_c", F.col("return_residual") - F.col("_m"))
    wide = bounded(centered, g, lambda w: {f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)}, back=lags)
    sums = wide.groupBy(*g.keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("c0"), *[F.sum(f"_p{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    cells, q = [], F.lit(0.0)
    for k in range(1, lags + 1):
        rho = F.try_divide(f"c{k}", "c0")
        q = q + F.try_divide(rho * rho, (n - k).cast("double"))
        cells.append(F.struct(F.lit(k).alias("lag"), rho.alias("acf"), (n * (n + 2) * q).alias("q")))
    out = sums.select(*g.keys, F.explode(F.array(*cells)).alias("_l")).select(*g.keys, "_l.*")
    return out.withColumn("p_value", stats.chi2_upper(F.col("q"), F.col("lag").cast("double")))


# Two-sided normal quantiles for 50, 10 and 5 percent.
Z_VALUES = {0.5: 0.6744897501960817, 0.1: 1.6448536269514722, 0.05: 1.959963984540054}


def cumulative_forecast(df: DataFrame, g: Grid, steps: int, pessimism: float | None = None) -> DataFrame:
    """Line through the cumulative return, continued ``steps`` bars with normal bands, starting at 0."""
    numbered = row_numbers(df.where(F.col("total_cum_returns").isNotNull()), g, "_rn", "_n")
    x, y = F.col("_rn").cast("double"), F.col("total_cum_returns")
    fit = numbered.groupBy(*g.keys).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.count(F.lit(1)).alias("_n"), F.max(g.ts).alias("_last"),
        F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / F.count(F.lit(1)))).alias("_se"))
    rows = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    value = F.col("_a") + F.col("_b") * (F.col("_n") + F.col("step"))
    start = F.col("_a") + F.col("_b") * (F.col("_n") + 1)
    end = F.col("_a") + F.col("_b") * (F.col("_n") + steps)
    less = (end * pessimism) * (F.col("step") - 1) / (steps - 1) if pessimism is not None else F.lit(0.0)
    line = value - start - less
    return rows.select(
        *g.keys, F.expr(f"timestampadd(SECOND, step * {g.step}, _last)").alias(g.ts), line.alias("forecast"),
        *[(line + sign * z * F.col("_se")).alias(f"{name}_{round(a * 100)}") for a, z in Z_VALUES.items() for name, sign in (("lower", -1), ("upper", 1))])
