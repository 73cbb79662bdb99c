"""Routing labels and targets.

All operators read the long table ``outcomes(sample_id, model_id, quality,
cost)`` with unique (sample_id, model_id), so a sample never has more rows
than there are models and a window over one sample is always small.  Choices
of one row per sample are aggregates, which combine before the shuffle.
Ties go to the model whose id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from routeyard.runtime import finite, persisted

def per_sample() -> WindowSpec:
    return Window.partitionBy("sample_id")


def cheapest(correct: Column, usable: Column, cost: Column) -> Column:
    """Sort key of a cell: correct and usable first, then usable, then the rest."""
    tier = F.when(correct & usable, 0).when(usable, 1).otherwise(2)
    return F.struct(tier.alias("tier"), F.when(usable, cost).otherwise(F.lit(0.0)).alias("c"),
                    F.col("model_id").alias("m"))


def is_correct() -> Column:
    return F.coalesce(F.col("quality") > 0, F.lit(False))


def hard_labels(outcomes: DataFrame, no_correct: str = "cheapest") -> DataFrame:
    """Cheapest correct model per sample.

    A sample nobody answers gets its cheapest model, or is left out with
    ``no_correct="drop"``.  Cells without a cost are used last.
    """
    usable = F.col("cost").isNotNull() & ~F.isnan("cost")
    picked = outcomes.groupBy("sample_id").agg(
        F.min_by("model_id", cheapest(is_correct(), usable, F.col("cost"))).alias("model_id"),
        F.max(is_correct()).alias("solvable"))
    if no_correct == "drop":
        picked = picked.filter("solvable")
    return picked.select("sample_id", "model_id")


def oracle_route(outcomes: DataFrame) -> DataFrame:
    """Cheapest correct model over finite costs, with its outcome."""
    key = cheapest(is_correct(), finite("cost"), F.col("cost"))
    best = outcomes.groupBy("sample_id").agg(
        F.min_by(F.struct("model_id", "quality", "cost"), key).alias("b"))
    return best.select("sample_id", "b.*")


def solvable(outcomes: DataFrame) -> DataFrame:
    """Outcomes of the samples at least one model answers correctly."""
    ok = F.max(is_correct()).over(per_sample())
    return outcomes.withColumn("__ok", ok).filter("__ok").drop("__ok")


def soft_targets(outcomes: DataFrame, lam: float | None = 0.0, scheme: str = "exp",
                 eps: float = 1e-12, fallback: str = "cheapest", cost_scale: float = 100.0) -> DataFrame:
    """Probability of each model: cheaper correct models get more.

    Weights are taken in log space, so a large ``lam`` cannot underflow.
    ``lam=None`` gives the hard label as a one-hot row.
    """
    if scheme not in ("exp", "power") or fallback not in ("cheapest", "cost_soft"):
        raise ValueError(f"unknown scheme or fallback: {scheme}, {fallback}")
    usable = F.col("cost").isNotNull() & ~F.isnan("cost")
    scaled = F.col("cost") * F.lit(float(cost_scale))
    rate = F.lit(-float(lam or 0.0))
    log_weight = rate * (scaled if scheme == "exp" else F.log(scaled + F.lit(eps)))
    first = F.min(F.struct(F.col("__key"))).over(per_sample())
    cells = (outcomes.withColumn("__key", cheapest(is_correct(), usable, F.col("cost")))
             .withColumn("__any", F.max(is_correct()).over(per_sample()))
             .withColumn("__first", first["__key"]["m"] == F.col("model_id")))
    one_hot = F.col("__first").cast("double")
    if lam is None:
        return cells.select("sample_id", "model_id", one_hot.alias("target"))
    soft_pool = usable & (is_correct() | ~F.col("__any")) if fallback == "cost_soft" else usable & is_correct()
    cells = cells.withColumn("__lw", F.when(soft_pool, log_weight))
    cells = cells.withColumn("__w", F.exp(F.col("__lw") - F.max("__lw").over(per_sample())))
    share = F.coalesce(F.col("__w"), F.lit(0.0)) / F.nullif(F.sum("__w").over(per_sample()), F.lit(0.0))
    return cells.select("sample_id", "model_id", F.coalesce(share, one_hot).alias("target"))


def normalized_scores(outcomes: DataFrame) -> DataFrame:
    """Quality over the number of correct models of the sample; 0 if none."""
    q = is_correct().cast("double")
    share = q / F.nullif(F.sum(q).over(per_sample()), F.lit(0.0))
    return outcomes.select("sample_id", "model_id", F.coalesce(share, F.lit(0.0)).alias("target"))


def softmax(scores: DataFrame, score: str = "score") -> DataFrame:
    """Softmax of the scores of each sample."""
    e = F.exp(F.col(score) - F.max(score).over(per_sample()))
    return (scores.withColumn("__e", e)
            .withColumn("probability", F.col("__e") / F.sum("__e").over(per_sample())).drop("__e"))


def argmax(scores: DataFrame, score: str = "score") -> DataFrame:
    """Best-scoring model per sample, ties to the first model id; a score that is NULL or NaN comes last."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    best = F.min_by("model_id", F.struct(s.isNull().alias("none"), (-s).alias("s"), F.col("model_id").alias("m")))
    return scores.groupBy("sample_id").agg(best.alias("model_id"))


def argmin(scores: DataFrame, score: str, keys: list[str] = ("sample_id",)) -> DataFrame:
    """Lowest-scoring model per key, ties to the first model id; a score that is NULL or NaN comes last."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    best = F.min_by("model_id", F.struct(s.isNull().alias("none"), s.alias("s"), F.col("model_id").alias("m")))
    return scores.groupBy(*keys).agg(best.alias("model_id"))


def contrast_sets(targets: DataFrame, k_plus: int = 3, k_minus: int = 3) -> DataFrame:
    """The best ``k_plus`` and the worst ``k_minus`` models of each sample."""
    best = Window.partitionBy("sample_id").orderBy(F.col("target").desc(), "model_id")
    worst = Window.partitionBy("sample_id").orderBy("target", "model_id")
    ranked = (targets.withColumn("up", F.row_number().over(best))
              .withColumn("down", F.row_number().over(worst)))
    signs = F.array(F.struct(F.lit("positive").alias("side"), F.col("up").alias("position"),
                             F.lit(k_plus).alias("k")),
                    F.struct(F.lit("negative").alias("side"), F.col("down").alias("position"),
                             F.lit(k_minus).alias("k")))
    return (ranked.withColumn("x", F.explode(signs)).filter("x.position <= x.k")
            .select("sample_id", "x.side", "x.position", "model_id"))


def target_diagnostics(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row describing how concentrated the targets are."""
    from routeyard.operators.quantiles import percentiles

    usable = F.col("cost").isNotNull() & ~F.isnan("cost")
    t = F.col("target")
    rows = (targets.join(outcomes, ["sample_id", "model_id"])
            .groupBy("sample_id").agg(
                F.sum(-t * F.log(t + F.lit(1e-12))).alias("entropy"),
                F.min_by("target", cheapest(is_correct(), usable, F.col("cost"))).alias("on_cheapest"),
                F.sum((t > 0.01).cast("int")).alias("active"),
                F.count(F.lit(1)).alias("models"),
                F.max(is_correct()).alias("any")))
    sample_rows = persisted(rows, "target-rows")     # read by the median and by the averages
    median = percentiles(sample_rows, "on_cheapest", [50]).select(F.col("values")[0].alias("m")).scalar()
    return sample_rows.agg(
        F.avg("entropy").alias("mean_entropy"), F.stddev_pop("entropy").alias("std_entropy"),
        F.log(F.max("models").cast("double")).alias("max_entropy"),
        F.avg(F.exp("entropy")).alias("mean_effective_k"),
        F.avg("on_cheapest").alias("mean_prob_cheapest_correct"),
        F.avg(F.col("active").cast("double")).alias("mean_active_models"),
        (F.lit(100.0) * F.avg((~F.col("any")).cast("double"))).alias("pct_no_correct"),
    ).withColumn("median_prob_cheapest_correct", median)
