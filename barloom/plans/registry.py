"""Query catalog: a name, a result layout, a Spark plan and, where SQL can say it, an oracle.

The layout lists ``column:kind`` pairs and is applied to both sides, so results compare by value:
``s`` string, ``t`` time as text, ``i`` integer, ``b`` boolean, ``d`` double with 6 decimals, ``dN``
double with N decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# Decimal places are cut at x.50037 and not at x.5: values with few decimals then never sit on the
# border, where two engines could differ by the last bit.
BORDER = 0.50037


@dataclass(frozen=True)
class Query:
    key: str
    layout: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(p.split(":")) for p in self.layout.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(spark, folder)
        out = []
        for name, kind in self.columns():
            c = F.col(f"`{name}`")
            if kind == "s":
                c = c.cast("string")
            elif kind == "t":
                c = c.cast("string")
            elif kind == "i":
                c = c.cast("bigint")
            elif kind == "b":
                c = c.cast("boolean")
            else:
                scale = 10.0 ** int(kind[1:] or 6)
                c = F.floor(c.cast("double") * scale + BORDER) / scale
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for column, kind in self.columns():
            name = f'"{column}"'
            if kind == "s":
                e = f"CAST({name} AS VARCHAR)"
            elif kind == "t":
                e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
            elif kind == "i":
                e = f"CAST({name} AS BIGINT)"
            elif kind == "b":
                e = f"CAST({name} AS BOOLEAN)"
            else:
                scale = 10.0 ** int(kind[1:] or 6)
                e = f"floor(CAST({name} AS DOUBLE) * {scale!r} + {BORDER}) / {scale!r}"
            out.append(f"{e} AS {name}")
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS q"


CATALOG: dict[str, Query] = {}


def query(key: str, layout: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under ``key``."""
    def register(build):
        if key in CATALOG:
            raise ValueError(f"query {key} registered twice")
        CATALOG[key] = Query(key, layout, build, sql)
        return build
    return register
