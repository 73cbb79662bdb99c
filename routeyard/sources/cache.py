"""Incremental feature cache (S21): compute what is missing, keep the newest, restore an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.operators.registry import complete, not_in, ordered_as, upsert


def todo(requested: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Requested samples without a complete cache row."""
    return requested if force else not_in(requested, cache.filter(complete(cache)))


def refresh(requested: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame],
            force: bool = False, order: list[str] = ()) -> DataFrame:
    """The cache after computing the missing rows; absent numbers become 0.

    Of rows computed more than once the last in ``order`` stays.
    """
    merged = upsert(cache, compute(todo(requested, cache, force)), order=order)
    for c in V.EVIDENCE_COLUMNS:
        value = F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(0.0)) if c in merged.columns else F.lit(0.0)
        merged = merged.withColumn(c, value)
    return merged


def write_refreshed(refreshed: DataFrame, order: DataFrame, path: str) -> None:
    """Write to a new path: the old cache is still being read."""
    ordered_as(refreshed, order).drop("pos").write.parquet(path)
