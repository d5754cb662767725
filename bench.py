"""Headline timings: ``BENCH_SF_DIR`` (data), ``BENCH_CPUS`` (cores). Prints one JSON line.

Every query is timed alone, with the stage tables it needs rebuilt (``barloom.plans.base`` keeps them per
session; they are forgotten before each query), after one warm-up query for the JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from barloom.plans import CATALOG
from barloom.plans import base

QUERIES = [
    "resample_ohlcv", "returns", "rolling_stats", "lag_features", "ema_features", "rsi", "rolling_fib", "trend_state", "gap_fill_grid",
    "fills_vwap", "series_quantiles", "income_by_bucket", "dq_report", "clean_panel", "refine_panel", "backtest_table", "parameter_sweep",
    "target_feature_corr", "transform_panel", "lookup_last_price",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["lookup_last_price"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for key in QUERIES:
        base._TABLES.clear()
        start = time.perf_counter()
        CATALOG[key].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
