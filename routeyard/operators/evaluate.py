"""Scoring routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.functions.scores import rank_score
from routeyard.operators.labels import oracle_route


def gather(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome of the chosen model; an unknown model leaves quality and cost NULL."""
    return decisions.join(outcomes.select("sample_id", "model_id", "quality", "cost"),
                          ["sample_id", "model_id"], "left")


def bound(bounds: DataFrame, name: str) -> Column:
    """A cost bound as a scalar subquery: one row, no join."""
    return bounds.select(name).scalar()


def _scores(bounds: DataFrame, beta: float) -> list[Column]:
    """Accuracy, cost and rank score; a decision without an outcome counts as wrong at cost 0."""
    return [F.avg(F.coalesce("quality", F.lit(0)).cast("double")).alias("accuracy"),
            F.avg(F.coalesce("cost", F.lit(0.0))).alias("avg_cost"),
            F.sum(F.coalesce("quality", F.lit(0))).cast("bigint").alias("num_correct"),
            F.count(F.lit(1)).alias("num_samples")]


def _ranked(df: DataFrame, bounds: DataFrame, beta: float) -> DataFrame:
    """Add the rank score; the bounds become columns first, so each is looked up once."""
    score = rank_score(F.col("accuracy"), F.col("avg_cost"), F.col("__cmin"), F.col("__cmax"), beta)
    return (df.withColumns({"__cmin": bound(bounds, "cmin"), "__cmax": bound(bounds, "cmax")})
            .withColumn("rank_score", F.when(F.col("num_samples") > 0, score).otherwise(F.lit(0.0)))
            .drop("__cmin", "__cmax"))


def score(gathered: DataFrame, bounds: DataFrame, by: list[str] = (), beta: float = 0.1) -> DataFrame:
    """One score row per group of decisions."""
    return _ranked(gathered.groupBy(*by).agg(*_scores(bounds, beta)), bounds, beta)


def score_sets(gathered: DataFrame, bounds: DataFrame, sets: list[list[str]], beta: float = 0.1) -> DataFrame:
    """Score rows of several groupings in one pass over the decisions."""
    cols = sorted({c for s in sets for c in s})
    return _ranked(gathered.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
                   .agg(*_scores(bounds, beta)), bounds, beta)


def best_and_worst(by_dataset: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best rows by rank score and, when there are more rows than that, the ``n`` worst."""
    top = by_dataset.orderBy(F.col("rank_score").desc(), "dataset").limit(n).withColumn("place", F.lit("top"))
    low = by_dataset.orderBy("rank_score", F.col("dataset").desc()).limit(n).withColumn("place", F.lit("bottom"))
    more = by_dataset.agg((F.count(F.lit(1)) > n).alias("m")).scalar()
    return top.unionByName(low.filter(more))


def label_agreement(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of decisions that equal the sample's label."""
    joined = decisions.join(labels.select("sample_id", F.col("model_id").alias("label")), "sample_id")
    return joined.agg(F.avg((F.col("model_id") == F.col("label")).cast("double")).alias("agreement"),
                      F.count(F.lit(1)).alias("num_samples"))


def choice_distribution(decisions: DataFrame, models: list[str]) -> DataFrame:
    """How often each model of the pool is chosen, zero included."""
    pool = decisions.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    return pool.join(decisions.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")), "model_id", "left").select(
        "model_id", F.coalesce("n", F.lit(0)).alias("n"))


def summary(decisions: DataFrame, outcomes: DataFrame, bounds: DataFrame, frontier: DataFrame | None = None,
            risks: DataFrame | None = None, beta: float = 0.1, overhead: float = 0.0, ece_bins: int = 15) -> DataFrame:
    """One row with everything known about a router: score, oracle gap, frontier match, calibration.

    A decision without an outcome counts as wrong at cost 0, as in ``score``.
    """
    from routeyard.operators.calibration import frontier_match, risk_statistics

    g = gather(decisions, outcomes)
    known = F.coalesce("cost", F.lit(0.0))
    charged = known + F.lit(float(overhead))
    right = F.coalesce("quality", F.lit(0))
    base = g.agg(F.avg(right.cast("double")).alias("accuracy"), F.avg(charged).alias("avg_cost"),
                 F.avg(known).alias("model_avg_cost"), F.sum(charged).alias("total_cost"),
                 F.sum(right).cast("bigint").alias("num_correct"), F.count(F.lit(1)).alias("num_samples"))
    base = _ranked(base, bounds, beta)
    o = oracle_route(outcomes).agg(F.avg("quality").alias("a"), F.avg("cost").alias("c"))
    out = (base.withColumn("oracle_accuracy", o.select("a").scalar())
           .withColumn("oracle_avg_cost", o.select("c").scalar())
           .withColumn("oracle_gap", F.col("oracle_accuracy") - F.col("accuracy")))
    if frontier is not None:
        out = frontier_match(out, frontier)
    if risks is not None:
        packed = risk_statistics(risks, decisions, outcomes, ece_bins)
        out = out.withColumn("__r", packed.select(F.struct(*packed.columns)).scalar()).select("*", "__r.*").drop("__r")
    return out


def leaderboard(runs: DataFrame) -> DataFrame:
    """Runs by test rank score, best first; a run without one comes last."""
    key = F.coalesce("rank_score", F.lit(float("-inf")))
    return runs.orderBy(key.desc(), "run")


def best_run(runs: DataFrame) -> DataFrame:
    key = F.struct(-F.coalesce(F.col("rank_score"), F.lit(float("-inf"))), F.col("run"))
    return runs.agg(F.min_by(F.struct(*runs.columns), key).alias("b")).select("b.*")
