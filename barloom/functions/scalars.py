"""Row expressions: candle classes, bands, calendar, exposure."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def band_class(x: Column, low: Column, high: Column, label: str) -> Column:
    """Right-closed bins: up to ``low`` is a low outlier, above ``high`` a top outlier, null none."""
    return (
        F.when(x.isNull(), f"{label}_no_outlier").when(x <= low, f"{label}_low_outlier")
        .when(x <= high, f"{label}_no_outlier").otherwise(f"{label}_top_outlier")
    )


def candle_shape() -> dict[str, Column]:
    """Log volume and the parts of a candle, relative to its open."""
    o, h, l, p = (F.col(c) for c in ("open", "high", "low", "price"))
    return {
        "log_volume": F.log1p("volume"),
        "candle_body": F.try_divide(F.abs(p - o), o),
        "candle_range": F.try_divide(F.abs(h - l), o),
        "candle_top_wick": F.try_divide(h - F.greatest(p, o), o),
        "candle_bot_wick": F.try_divide(F.least(p, o) - l, o),
    }


def candle_type(body: Column, top: Column, bot: Column, ret: Column) -> Column:
    """Candle class from the shares of body and wicks and the sign of the return."""
    # Share limits 0.78, 0.5, 0.6, 0.6, 0.38 and the class names.
    total = body + top + bot
    up = F.coalesce(ret >= 0, F.lit(False))
    pair = lambda bull, bear: F.when(up, bull).otherwise(bear)
    return (
        F.when(body >= 0.78 * total, pair("strong_bull_candle", "strong_bear_candle"))
        .when(body >= 0.5 * total, pair("bull_candle", "bear_candle"))
        .when(bot >= 0.6 * total, pair("hammer_candle", "hanging_man_candle"))
        .when(top >= 0.6 * total, pair("inverted_hammer_candle", "shooting_star_candle"))
        .when((top >= 0.38 * total) & (bot >= 0.38 * total), pair("indecision_bull_candle", "indecision_bear_candle"))
        .otherwise(pair("undefined_bull_candle", "undefined_bear_candle"))
    )


def ha_candle_code() -> Column:
    """Code 0..5 of a Heikin-Ashi candle (see ``windows.HA_CODES``)."""
    # Share limits 0.05, 0.5, 0.38.
    body, top, bot = F.col("ha_candle_body"), F.col("ha_top_wick"), F.col("ha_bot_wick")
    total = body + top + bot
    wavering = (top >= 0.38 * total) & (bot >= 0.38 * total)
    solid = body >= 0.5 * total
    bull = F.when((bot <= 0.05 * total) & solid, 0).when(wavering, 4).otherwise(2)
    bear = F.when((top <= 0.05 * total) & solid, 1).when(wavering, 5).otherwise(3)
    return F.when(F.col("ha_price") >= F.col("ha_open"), bull).otherwise(bear)


def value_map(x: Column, mapping: dict, default: Column | None = None) -> Column:
    """Recode values by a small dictionary."""
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(default) if default is not None else out


def cyclic_time(ts: str) -> dict[str, Column]:
    """Sine and cosine of hour of day, weekday (Monday 0) and day of month."""
    parts = {"hod": (F.hour(ts), 24, "hod_cos"), "dow": (F.weekday(ts), 7, "day_cos"), "dom": (F.dayofmonth(ts), 31, "dam_cos")}
    out = {}
    for name, (part, period, cosine) in parts.items():
        angle = part * (2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[cosine] = F.cos(angle)
    return out


def calendar_parts(ts: str) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "day": F.dayofmonth(ts)}


def partition_keys(ts: str) -> dict[str, Column]:
    """``Y_m``, ``Y_bimester`` and ``Y_q`` (numbers are not zero-padded)."""
    y = F.year(ts)
    return {
        "year_month": F.concat_ws("_", y, F.month(ts)),
        "year_bimester": F.concat_ws("_", y, F.ceil(F.month(ts) / 2).cast("int")),
        "year_quarter": F.concat_ws("_", y, F.quarter(ts)),
    }


def is_market_time(ts: str) -> Column:
    """Weekday between 13:30 and 19:30 UTC."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return (F.weekday(ts) < 5) & (minutes >= 13 * 60 + 30) & (minutes <= 19 * 60 + 30)


def soft_truncate(x: Column, low: Column, high: Column, keep: float = 0.25) -> Column:
    """Beyond a bound only a share of the excess is kept."""
    return F.when(x > high, high + (x - high) * keep).when(x < low, low - (low - x) * keep).otherwise(x)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def finite(x: Column) -> Column:
    """Infinities become null."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def exposure(certainty: Column, active: Column) -> Column:
    """Share of capital at risk: grows with the log of certainty, between 0.5 and 1, 0 when flat."""
    raw = F.ln(100 * certainty - 49) / math.log(90 - 49) + 0.1
    return F.when(active, F.greatest(F.lit(0.5), F.least(F.coalesce(raw, F.lit(0.5)), F.lit(1.0)))).otherwise(0.0)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 15 digits, as one expression.

    Rational approximation for |x| < 7.07 and a continued fraction beyond (published by Hart, 1968).
    """
    # Coefficients of the published approximation, highest power first.
    num = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376]
    den = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752]
    a = F.abs(x)

    def poly(coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    bell = F.exp(-a * a / 2)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, bell * poly(num) / poly(den)).otherwise(
        bell / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)
