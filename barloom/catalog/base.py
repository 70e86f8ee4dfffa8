"""Registry of runnable queries and the SQL that states their expected result.

``cols`` lists the compared columns, with ``name:digits`` for doubles, which are
rounded half up on both sides; infinite and NaN values are compared as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(cols: str) -> list[tuple[str, int | None]]:
    out = []
    for c in cols.split():
        name, _, d = c.partition(":")
        out.append((name, int(d) if d else None))
    return out


def shaped(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, d in _spec(cols):
        c = F.col(name)
        if d is not None:
            c = c.cast("double")
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(
                F.floor(c * float(10 ** d) + 0.5) / float(10 ** d))
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(sql: str, cols: str) -> str:
    out = []
    for name, d in _spec(cols):
        if d is None:
            out.append(name)
        else:
            v = f"CAST({name} AS DOUBLE)"
            out.append(f"CASE WHEN isnan({v}) OR isinf({v}) THEN NULL ELSE "
                       f"floor({v} * 1e{d} + 0.5) / 1e{d} END AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql.strip()}\n) _q"


def query(name: str, cols: str, sql: str | None = None, pre: str = ""):
    """Register ``fn(spark, dir)``; ``pre`` holds the WITH clause of ``sql``."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), cols)
        if sql is not None:
            ORACLES[name] = (pre.strip() + "\n" if pre else "") + shaped_sql(sql, cols)
        return fn

    return wrap
