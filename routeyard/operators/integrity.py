"""Data integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V


def _models_found(pairs: DataFrame, expected: list[str]) -> DataFrame:
    want = F.array(*[F.lit(m) for m in sorted(expected)])
    return (pairs.withColumn("missing_models", F.array_except(want, F.col("found_models")))
            .withColumn("extra_models", F.array_except(F.col("found_models"), want)))


def quality_coverage(scores: DataFrame, expected: list[str]) -> DataFrame:
    """Rows, samples and models per dataset, with missing and extra models.

    The row without a dataset covers everything.  (dataset, model) pairs are
    combined first; only model-sized sets are gathered.
    """
    sets = [["dataset", "model_id"], ["model_id"]]
    per_model = scores.groupingSets([[F.col(c) for c in s] for s in sets], "dataset", "model_id").agg(
        F.count(F.lit(1)).alias("records"))
    models = per_model.groupBy("dataset").agg(
        F.sum("records").alias("records"), F.count("model_id").alias("models"),
        F.sort_array(F.collect_list("model_id")).alias("found_models"))
    samples = scores.select("dataset", "sample_id").distinct().rollup("dataset").agg(
        F.count("sample_id").alias("samples"))
    joined = models.alias("m").join(samples.alias("s"), F.col("m.dataset").eqNullSafe(F.col("s.dataset")))
    return _models_found(joined.select("m.*", "s.samples"), expected)


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.rollup("dataset").agg(F.count(F.lit(1)).alias("samples"))


def split_check(splits: DataFrame, expected: dict[str, float] = V.SPLIT_RATIOS, slack: float = 0.02) -> DataFrame:
    """Size and share of each split against the expected ratio."""
    want = splits.sparkSession.createDataFrame(list(expected.items()), "split string, expected double")
    n = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t")).scalar()
    return (want.join(n, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("ratio", F.col("n") / F.nullif(total, F.lit(0)))
            .withColumn("ok", F.abs(F.col("ratio") - F.col("expected")) < slack))


def token_cost_check(costs: DataFrame) -> DataFrame:
    return costs.groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.avg("total_cost").alias("avg_cost"))


def cost_shape(outcomes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Matrix shape, cost range and mean, and the bounds in use."""
    per_model = outcomes.groupBy("model_id").agg(
        F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.sum("cost").alias("s"), F.count("cost").alias("n"))
    shape = per_model.agg(F.count(F.lit(1)).alias("num_models"), F.min("lo").alias("min_cost"),
                          F.max("hi").alias("max_cost"), (F.sum("s") / F.sum("n")).alias("mean_cost"))
    n = outcomes.groupBy("sample_id").agg(F.lit(1).alias("x")).agg(F.count("x").alias("n")).scalar()
    return (shape.withColumn("num_samples", n).withColumn("cmin", bounds.select("cmin").scalar())
            .withColumn("cmax", bounds.select("cmax").scalar()))


def files_per_model(paths: DataFrame, models: list[str]) -> DataFrame:
    """Result files under each model's folder; models without any are listed with 0."""
    pool = paths.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    parts = F.filter(F.split("path", "/"), lambda p: p.isin(list(models)))
    found = paths.select(F.try_element_at(parts, F.lit(1)).alias("model_id")).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"))
    return pool.join(found, "model_id", "left").select(
        "model_id", F.coalesce("n", F.lit(0)).alias("result_files"), F.col("n").isNotNull().alias("exists"))


def difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of ``left`` that ``right`` does not have."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def intersection(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))
