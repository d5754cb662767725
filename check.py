"""Compare catalog queries with their DuckDB oracle: ``python check.py [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from barloom.plans import CATALOG

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8, tz: str = "UTC") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", tz).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, key: str, folder: str) -> tuple[bool, str]:
    q = CATALOG[key]
    t0 = time.time()
    df = q.run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return len(rows) > 0, f"rows only: {len(rows)} rows, {t1 - t0:.2f}s"
    want = con.execute(q.oracle()).fetchall()
    t2 = time.time()
    a, b = Counter(rows), Counter(want)
    note = f"{len(rows)} rows, spark {t1 - t0:.2f}s, oracle {t2 - t1:.2f}s"
    if a == b:
        nulls = [c for i, (c, _) in enumerate(q.columns()) if all(r[i] is None for r in rows)]
        return len(rows) > 0, note + (f" ALL-NULL {nulls}" if nulls and rows else "") + (" EMPTY" if not rows else "")
    left, right = list((a - b).elements()), list((b - a).elements())
    s = lambda x: sorted(x, key=str)[:3]
    return False, f"{note}\n   got {len(rows)} want {len(want)}; only spark {len(left)}: {s(left)}\n   only oracle {len(right)}: {s(right)}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--tz", default="UTC", help="session time zone; results must not depend on it")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(tz=args.tz), duck(folder)
    bad = []
    for key in args.names or list(CATALOG):
        try:
            ok, note = compare(spark, con, key, folder)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        if not ok:
            bad.append(key)
        print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
