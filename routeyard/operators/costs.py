"""Token and cost tables and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.tokens import image_count, output_token_estimate, text_tokens, token_cost
from routeyard.runtime import finite, literal_map, once


def input_token_table(samples: DataFrame) -> DataFrame:
    """Text, image and total input tokens of each sample."""
    images = image_count(F.col("assets")) if "assets" in samples.columns else F.lit(0)
    return (samples.select("sample_id", "dataset", "task_type",
                           once(text_tokens(F.col("prompt"))).alias("text_tokens"),
                           images.cast("bigint").alias("num_images"))
            .withColumn("image_tokens", F.col("num_images") * V.TOKENS_PER_IMAGE)
            .withColumn("total_input_tokens", F.col("text_tokens") + F.col("image_tokens"))
            .select("sample_id", "dataset", "task_type", "text_tokens", "image_tokens",
                    "total_input_tokens", "num_images"))


def output_token_table(samples: DataFrame, models: list[str], actual: DataFrame | None = None) -> DataFrame:
    """Every (sample, model) with its actual output tokens, else an estimate.

    The model pool is a literal array, so the product is an explode and needs
    no join.
    """
    grid = samples.select("sample_id", output_token_estimate(F.col("task_type")).alias("__estimate"),
                          F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    if actual is None:
        return grid.select("sample_id", "model", F.col("__estimate").alias("output_tokens"),
                           F.lit(False).alias("is_actual"))
    have = actual.select("sample_id", "model", F.col("output_tokens").alias("__actual"))
    return grid.join(have, ["sample_id", "model"], "left").select(
        "sample_id", "model", F.coalesce("__actual", "__estimate").alias("output_tokens"),
        F.col("__actual").isNotNull().alias("is_actual"))


def with_input_tokens(output: DataFrame, inputs: DataFrame) -> DataFrame:
    return output.join(inputs.select("sample_id", "total_input_tokens"), "sample_id", "left")


def _costed(df: DataFrame, input_price: Column, output_price: Column) -> DataFrame:
    return (df.withColumn("input_cost", token_cost(F.col("total_input_tokens"), input_price))
            .withColumn("output_cost", token_cost(F.col("output_tokens"), output_price))
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
            .select("sample_id", "model", "total_input_tokens", "output_tokens",
                    "input_cost", "output_cost", "total_cost"))


def strict_costs(output: DataFrame, inputs: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Costs of models with a token price and samples with input tokens; others drop out.

    The price list comes from a configuration file and is a literal map.
    """
    known = output.filter(F.col("model").isin(list(prices)))
    joined = with_input_tokens(known, inputs).filter(F.col("total_input_tokens").isNotNull())
    return _costed(joined, literal_map({m: p[0] for m, p in prices.items()})[F.col("model")],
                   literal_map({m: p[1] for m, p in prices.items()})[F.col("model")])


def lenient_costs(output: DataFrame, inputs: DataFrame,
                  prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Costs of every row; a model without a price gets the fallback price."""
    prices = V.DEFAULT_PRICES if prices is None else prices
    price = lambda i, fallback: F.coalesce(
        literal_map({m: p[i] for m, p in prices.items()})[F.col("model")], F.lit(fallback))
    return _costed(with_input_tokens(output, inputs), price(0, V.FALLBACK_INPUT_PRICE),
                   price(1, V.FALLBACK_OUTPUT_PRICE))


def unpriced_models(output: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    return output.filter(~F.col("model").isin(list(prices))).groupBy("model").agg(
        F.count(F.lit(1)).alias("records"))


def token_stats(inputs: DataFrame) -> DataFrame:
    """Token statistics by dataset and by task type in one pass."""
    def five(c: str) -> list[Column]:
        return [F.bround(F.avg(c), 2).alias(f"{c}_mean"), F.bround(F.stddev_samp(c), 2).alias(f"{c}_std"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum")]

    keyed = inputs.groupingSets([["dataset"], ["task_type"]], "dataset", "task_type")
    return keyed.agg(F.count("sample_id").alias("num_samples"), *five("text_tokens"), *five("image_tokens"),
                     *five("total_input_tokens"), F.bround(F.avg("num_images"), 2).alias("num_images_mean"),
                     F.sum("num_images").alias("num_images_sum"))


def token_totals(inputs: DataFrame, output: DataFrame) -> DataFrame:
    """Grand totals and averages over all samples and models."""
    i = inputs.agg(F.count(F.lit(1)).alias("samples"), F.sum("text_tokens").alias("text_tokens"),
                   F.sum("image_tokens").alias("image_tokens"),
                   F.sum("total_input_tokens").alias("input_tokens"))
    # models first, so that no distinct count runs over every record
    o = (output.groupBy("model").agg(F.sum("output_tokens").alias("t"))
         .agg(F.count(F.lit(1)).alias("models"), F.sum("t").alias("output_tokens")))
    return (i.withColumn("models", o.select("models").scalar())
            .withColumn("output_tokens", o.select("output_tokens").scalar())
            .withColumn("grand_total", F.col("input_tokens") + F.col("output_tokens"))
            .withColumn("avg_input", F.col("input_tokens") / F.nullif(F.col("samples"), F.lit(0)))
            .withColumn("avg_output", F.col("output_tokens")
                        / F.nullif(F.col("samples") * F.col("models"), F.lit(0))))


def output_by_model(output: DataFrame) -> DataFrame:
    return output.groupBy("model").agg(
        F.avg("output_tokens").alias("avg_output_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.avg(F.col("is_actual").cast("double")).alias("actual_ratio")).orderBy(
        F.col("avg_output_tokens").desc(), "model")


def cost_by_model(costs: DataFrame) -> DataFrame:
    """Cost sums per model, dearest first; the row without a model is the grand total."""
    return costs.rollup("model").agg(
        F.sum("input_cost").alias("total_input_cost"), F.sum("output_cost").alias("total_output_cost"),
        F.avg("total_cost").alias("avg_cost_per_sample"), F.sum("total_cost").alias("total_cost")).orderBy(
        F.col("model").isNull(), F.col("total_cost").desc(), "model")


def cost_spread(costs: DataFrame) -> DataFrame:
    """Mean, smallest and largest cost per model; the row without a model is overall."""
    return costs.rollup("model").agg(
        F.avg("input_cost").alias("avg_input"), F.avg("output_cost").alias("avg_output"),
        F.avg("total_cost").alias("avg_total"), F.min("total_cost").alias("min_cost"),
        F.max("total_cost").alias("max_cost"), F.sum("total_cost").alias("sum_cost"))


def cost_health(outcomes: DataFrame, samples: DataFrame, n_models: int) -> DataFrame:
    """Share of zero and non-zero cells of the sample-by-model grid, and positive-cost statistics.

    A cell that is missing altogether counts as zero.
    """
    from routeyard.operators.quantiles import percentiles

    positive = outcomes.filter(finite("cost") & (F.col("cost") > 0))
    median = percentiles(positive, "cost", [50]).select(F.col("values")[0].alias("m")).scalar()
    cells = samples.agg((F.count(F.lit(1)) * n_models).alias("c")).scalar()
    return (positive.agg(F.count(F.lit(1)).alias("nonzero"), F.min("cost").alias("min_cost"),
                         F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))
            .withColumn("zero", cells - F.col("nonzero"))
            .withColumn("nonzero_share", F.col("nonzero") / F.nullif(cells, F.lit(0)))
            .withColumn("median_cost", median))


def cost_bounds(outcomes: DataFrame, model: str = "model_id") -> DataFrame:
    """Cheapest and dearest model by mean positive cost, with all the means.

    One row.  The map has one entry per model.
    """
    means = (outcomes.filter(finite("cost") & (F.col("cost") > 0))
             .groupBy(F.col(model).alias("m")).agg(F.avg("cost").alias("c")))
    return means.agg(
        F.min("c").alias("cmin"), F.max("c").alias("cmax"),
        F.min_by("m", F.struct(F.col("c"), F.col("m"))).alias("cmin_model"),
        F.min_by("m", F.struct(-F.col("c"), F.col("m"))).alias("cmax_model"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("m", "c")))).alias("per_model_avg_costs"))


def finite_cost_bounds(outcomes: DataFrame) -> DataFrame:
    """Bounds from the costs themselves; no finite cost gives (0, 1), equal bounds are widened by 1."""
    c = outcomes.filter(finite("cost")).agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    lo = F.coalesce("lo", F.lit(0.0))
    hi = F.coalesce("hi", F.lit(1.0))
    return c.select(lo.alias("cmin"), F.when(hi <= lo, lo + 1.0).otherwise(hi).alias("cmax"))
