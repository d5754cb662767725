"""Feature build of a panel in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from barloom.functions import scalars as sc
from barloom.functions.holidays import is_holiday
from barloom.operators import windows as win
from barloom.operators.aggregate import band_thresholds
from barloom.operators.blocks import Grid, bounded, ema
from barloom.session import stage

RAW = ["open", "high", "low", "price", "volume", "return", "acceleration", "jerk"]


def refine_panel(
    df: DataFrame, g: Grid, indicators: Sequence[int], lags: Sequence[int], windows: Sequence[int], fib_rows: int = 744,
) -> DataFrame:
    """All features of a panel with ``RAW`` columns.

    Rows move one bar forward, with one future bar per series for the forecast. Every look-back of known
    reach (lags, rolling frames, indicators, derivative inputs) is computed in one blocked pass, every
    exponential average in a second one. Nulls are filled forward, backward, then with 0; the backward
    fill leaks later values into the first rows of a series.
    """
    moved = stage(win.shift_with_forecast_row(df.select(*g.keys, g.ts, *RAW), g, RAW))
    ranged = stage(win.rolling_extremes(moved, g, fib_rows, {"_lo": ("min", "low"), "_hi": ("max", "high")}))

    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {
            **win.roc_exprs(w, indicators, "price"), **win.bollinger_exprs(w, indicators, "price"),
            **win.cum_exprs(w, "return", indicators),
            "_chg": F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0)), "_ha": win.ha_input(w),
            **{f"price_lag_{k}": F.lag("price", k).over(w) for k in lags},
            **win.rolling_exprs(w, ["price"], windows, lambda c, s, n: f"{c}_{s}_{n}", True),
        }
    flat = stage(bounded(ranged, g, exprs, back=max(*indicators, *lags, *windows), ahead=1))
    spans = sorted({s for n in indicators for s in (n, 2 * n)} | set(windows))
    smooth = ema(flat, g, {
        **{f"_ema{s}": (F.col("price"), 2 / (s + 1)) for s in spans}, **win.rsi_specs(indicators), "ha_open": (F.col("_ha"), 0.5)})
    shaped = win.with_ha_parts(smooth.withColumn("ha_price", win.ha_price())).withColumns({
        **sc.candle_shape(), **win.fib_group(F.col("price"), F.col("_lo"), F.col("_hi")),
        **{f"macd_{n}": F.col(f"_ema{n}") - F.col(f"_ema{2 * n}") for n in indicators},
        **{f"rsi_{n}": win.rsi_value(n) for n in indicators},
        **{f"price_ema_{n}_diff": F.try_divide(F.col("price") - F.col(f"_ema{n}"), F.col("price")) for n in indicators},
        **{f"price_ema_{n}": F.col(f"_ema{n}") for n in windows},
    })
    named = stage(shaped.drop(*[c for c in shaped.columns if c.startswith("_")]).withColumn("ha_code", sc.ha_candle_code()))
    trend = win.trend_state(named, g)
    bands = band_thresholds(df, list(g.keys), ["return", "acceleration", "jerk"], 1.96)
    classed = trend.join(bands, g.key_list).withColumns({
        "manual_is_candle_type": sc.candle_type(F.col("candle_body"), F.col("candle_top_wick"), F.col("candle_bot_wick"), F.col("return")),
        "manual_is_ha_candle_type": sc.value_map(F.col("ha_code"), {v: k for k, v in win.HA_CODES.items()}),
        "manual_trend_identifier": sc.value_map(F.col("trend"), win.TREND_NAMES),
        "manual_dummy_pred": F.when(F.col("trend") == 0, 1).when(F.col("trend") == 1, -1).otherwise(0),
        **{f"manual_{n}_outlier": sc.band_class(F.col(n), F.col(f"{n}_low"), F.col(f"{n}_high"), n) for n in ("return", "acceleration", "jerk")},
        **sc.cyclic_time(g.ts), **sc.calendar_parts(g.ts), "is_holiday": is_holiday(g.ts),
    }).drop("ha_code", "trend", *[f"{n}_{s}" for n in ("return", "acceleration", "jerk") for s in ("low", "high")])
    types = dict(classed.dtypes)
    numbers = [c for c in classed.columns if types[c] == "double"]
    clean = stage(classed.withColumns({c: sc.finite(F.col(c)) for c in numbers}))
    return win.fill_both(clean, g, numbers).fillna(0.0, numbers)
