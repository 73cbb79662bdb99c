"""Registered queries and their reference SQL.

Each entry is a function (spark, sf_dir) -> DataFrame over the whole driver
tables; the SQL next to it computes the same rows in DuckDB.  Numbers are
rounded on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("sources", "names", "joins", "aggregates", "windows", "scalars", "policies", "learners")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return fn

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name) if name else out


def round_columns(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Means are rounded to this many binary digits behind the point, about 14 decimal ones.  A mean of short decimals often
# ends in exactly 5 at some decimal digit, where engines round differently; it hardly ever lies halfway on a binary grid.
MEAN_GRID = 1 << 45


def rounded_mean(value: Column) -> Column:
    return F.round(value * F.lit(float(MEAN_GRID))) / F.lit(float(MEAN_GRID))


def round_means(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded_mean(F.col(c)) for c in columns})


def mean_sql(expr: str, name: str) -> str:
    return f"round({expr} * {MEAN_GRID}::DOUBLE) / {MEAN_GRID}::DOUBLE AS {name}"


def load() -> None:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
