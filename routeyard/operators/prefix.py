"""Running totals and row numbers over a whole table.

A window without PARTITION BY puts every row in one task.  These operators deal
the rows out in ranges of about equal row count, add up each range, and run a
window per range.  Only the range totals (one row per shuffle partition) meet
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeyard.runtime import persisted


def with_range(df: DataFrame, key: str, tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """The rows, stored, with ``__range``: the number of their range in the order of (key, tie).

    Spark samples the keys and deals the rows out by range, as many ranges as
    the session has shuffle partitions, which a cluster sizes to its data.  A
    key value that fills several ranges is spread over them by ``tie``.  The
    rows are written once, since two scans of a sampled exchange need not
    agree on its bounds.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *[F.col(c) for c in (key, tie) if c is not None])
    return persisted(placed.withColumn("__range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, key: str, totals: dict[str, Column], tie: Column | None = None,
                   then_by: list[str] = (), groups: list[str] = (), ranges: int | None = None,
                   overall: bool = False) -> DataFrame:
    """Add inclusive running sums ordered by (key, tie, then_by), per group.

    ``totals`` maps a new column name to the expression that is summed;
    ``overall`` also adds the sum of the whole group as ``{name}_total``.
    """
    rows = df.withColumn("__tie", tie) if tie is not None else df
    rows = with_range(rows, key, "__tie" if tie is not None else None, ranges)
    order = [key] + (["__tie"] if tie is not None else []) + list(then_by)
    return totals_in_ranges(rows, order, totals, groups, overall).drop("__tie")


def totals_in_ranges(rows: DataFrame, order: list[str], totals: dict[str, Column], groups: list[str] = (),
                     overall: bool = False) -> DataFrame:
    """``running_totals`` of rows that ``with_range`` has dealt already; several may read the same stored rows."""
    groups = list(groups)
    sums = rows.groupBy(*groups, "__range").agg(
        *[F.sum(e).alias(f"__{n}_sum") for n, e in totals.items()])
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sums.select(*groups, "__range", *[
        F.coalesce(F.sum(f"__{n}_sum").over(before), F.lit(0)).alias(f"__{n}_before") for n in totals], *[
        F.sum(f"__{n}_sum").over(whole).alias(f"{n}_total") for n in totals if overall])
    if not groups:
        # one row per range
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*groups, "__range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = rows.join(offsets, [*groups, "__range"])
    for n, e in totals.items():
        out = out.withColumn(n, F.sum(e).over(inside) + F.col(f"__{n}_before"))
    return out.drop("__range", *[f"__{n}_before" for n in totals])


def row_numbers(df: DataFrame, key: str, name: str = "row_num", groups: list[str] = (),
                ranges: int | None = None) -> DataFrame:
    """Dense row numbers from 0 in key order; the key must be numeric and unique per group."""
    out = running_totals(df, key, {name: F.lit(1)}, groups=groups, ranges=ranges)
    return out.withColumn(name, F.col(name).cast("bigint") - 1)
