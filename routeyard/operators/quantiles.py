"""Exact percentiles with linear interpolation, and the latency summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.operators.prefix import running_totals


def percentiles(df: DataFrame, value: str, points: list[float], groups: list[str] = ()) -> DataFrame:
    """One row per group with ``values``: an array of exact percentiles.

    Equal values are collapsed first, then ranked by distributed running
    counts, so neither a hot group nor a hot value is gathered in one task.
    NULLs do not take part.
    """
    groups = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_totals(counts, value, {"__last": F.col("__c")}, groups=groups, overall=True)
    ranked = ranked.withColumnRenamed("__last_total", "__n")
    picks = []
    for i, p in enumerate(points):
        at = F.lit(p / 100.0) * (F.col("__n") - 1).cast("double")
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (rank + 1 <= F.col("__last")) & (rank + 1 > F.col("__last") - F.col("__c"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{side}{i}"))
    picked = ranked.groupBy(*groups).agg(F.max("__n").alias("__n"), *picks)

    def value_at(i: int, p: float) -> Column:
        at = F.lit(p / 100.0) * (F.col("__n") - 1).cast("double")
        lo, hi = F.col(f"__lo{i}").cast("double"), F.col(f"__hi{i}").cast("double")
        return lo + (hi - lo) * (at - F.floor(at))

    return picked.select(*groups, F.array(*[value_at(i, p) for i, p in enumerate(points)]).alias("values"))


def token_percentiles(input_tokens: DataFrame, columns: list[str], points: list[int]) -> DataFrame:
    """One row per percentile with the value of each token column."""
    long = input_tokens.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x"))
    wide = percentiles(long.select("x.*"), "value", points, ["metric"])
    labelled = wide.select("metric", F.posexplode("values").alias("i", "value"))
    at = F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1)
    return (labelled.withColumn("percentile", at).groupBy("percentile")
            .pivot("metric", columns).agg(F.first("value")))


def latency_summary(log: DataFrame) -> DataFrame:
    """Latency statistics per router and batch size from a table of timed calls."""
    keys = ["router", "batch_size"]
    stats = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("ms_mean"), F.stddev_pop("ms").alias("ms_std"),
        F.min("ms").alias("ms_min"), F.max("ms").alias("ms_max"),
        F.sum("ms").alias("__ms"), F.sum("tokens").alias("__tokens"),
        F.avg(F.col("ms") / F.col("tokens")).alias("ms_per_token"))
    q = percentiles(log, "ms", [50, 95, 99], keys)
    return stats.join(q, keys).select(
        *keys, "runs", "ms_mean", "ms_std", "ms_min", "ms_max",
        F.col("values")[0].alias("p50"), F.col("values")[1].alias("p95"), F.col("values")[2].alias("p99"),
        (F.col("ms_mean") / F.col("batch_size")).alias("ms_per_sample"),
        "ms_per_token",
        (F.col("batch_size") * F.lit(1000.0) / F.nullif(F.col("ms_mean"), F.lit(0.0))).alias("samples_per_sec"),
        (F.col("__tokens") * F.lit(1000.0) / F.nullif(F.col("__ms"), F.lit(0.0))).alias("tokens_per_sec"))


def latency_headline(summary: DataFrame) -> DataFrame:
    """Per router the row of batch size 1, else of the smallest batch size."""
    return summary.groupBy("router").agg(
        F.min("batch_size").alias("batch_size"),
        F.min_by("ms_per_sample", "batch_size").alias("ms_per_sample"),
        F.min_by("ms_per_token", "batch_size").alias("ms_per_token"),
        F.min_by("tokens_per_sec", "batch_size").alias("tokens_per_sec"))
