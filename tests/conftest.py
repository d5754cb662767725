import datetime as dt
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


T0 = dt.datetime(2024, 1, 1)


def hours(n, start=0):
    return [T0 + dt.timedelta(hours=start + i) for i in range(n)]


@pytest.fixture(scope="session")
def panel(spark):
    """Series of awkward shapes on an hourly grid; ``x`` has nulls, ``v`` has none."""
    rnd = random.Random(5)
    rows = []

    def add(name, values, start=0):
        for t, x in zip(hours(len(values), start), values):
            rows.append((name, t, x, float(round(rnd.uniform(1, 9), 3))))

    add("one", [4.0])
    add("null", [None] * 6)
    add("edges", [None, None, 1.0, None, None, 4.0, None, 2.0, None, None], start=3)
    add("const", [2.0] * 9)
    add("long", [None if rnd.random() < 0.4 else round(rnd.uniform(-5, 5), 3) for _ in range(61)], start=17)
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, x double, v double").cache()


def by_series(df, *cols):
    out = {}
    for r in df.orderBy("series", "ts").collect():
        out.setdefault(r.series, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out
