"""Whole reports: baselines, one fitted policy, a risk sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.operators import evaluate as E
from routeyard.operators.costs import cost_bounds
from routeyard.operators.labels import cheapest, is_correct, oracle_route
from routeyard.operators.learners import risk_route, route_scores
from routeyard.operators.policies import random_model
from routeyard.runtime import finite, persisted


def model_statistics(meta: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sums per (split, dataset, model): all that baselines and cost bounds need from the fact table, in one scan."""
    tagged = outcomes.join(meta.select("sample_id", "split", "dataset"), "sample_id", "left")
    known, paid = F.when(finite("cost"), F.col("cost")), F.when(finite("cost") & (F.col("cost") > 0), F.col("cost"))
    sums = tagged.groupBy("split", "dataset", "model_id").agg(
        F.sum("quality").alias("q"), F.count("quality").alias("nq"), F.sum(known).alias("c"), F.count(known).alias("nc"),
        F.sum(paid).alias("paid"), F.count(paid).alias("npaid"))
    return persisted(sums, "model-statistics")


def _mean(total: str, count: str) -> Column:
    return F.sum(total) / F.nullif(F.sum(count), F.lit(0))


def _least(stats: DataFrame, value: Column) -> Column:
    """The model of least value, as a scalar subquery; a model without a value comes last."""
    per_model = stats.groupBy("model_id").agg(value.alias("s"))
    return per_model.agg(F.min_by("model_id", F.struct(F.col("s").isNull(), "s", "model_id")).alias("m")).scalar()


def bounds_of(stats: DataFrame) -> DataFrame:
    """Cost bounds: the least and the largest mean positive cost of a model."""
    means = stats.groupBy("model_id").agg(_mean("paid", "npaid").alias("m"))
    return means.agg(F.min("m").alias("cmin"), F.max("m").alias("cmax"))


def _baseline_choices(meta: DataFrame, outcomes: DataFrame, stats: DataFrame, models: list[str], fit_split: str,
                      eval_split: str, seed: int) -> DataFrame:
    """(router, sample_id, dataset, model_id, quality, cost) of the five baselines on every sample of a split.

    The outcomes of a sample, one per model, travel as one small map that all five routers read.
    """
    test = meta.filter(F.col("split") == eval_split).select("sample_id", "dataset")
    fit = stats.filter(F.col("split") == fit_split)
    per_dataset = fit.groupBy("dataset", "model_id").agg((-_mean("q", "nq")).alias("s"))
    champions = per_dataset.groupBy("dataset").agg(
        F.min_by("model_id", F.struct(F.col("s").isNull(), "s", "model_id")).alias("champion"))
    first = champions.agg(F.min_by("champion", "dataset").alias("m")).scalar()
    cells = outcomes.join(test.select("sample_id"), "sample_id", "left_semi").groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model_id", F.struct("quality", "cost")))).alias("cells"),
        F.min_by("model_id", cheapest(is_correct(), finite("cost"), F.col("cost"))).alias("oracle"))
    rows = (test.join(champions, "dataset", "left").join(cells, "sample_id", "left")
            .withColumns({"strongest": _least(fit, -_mean("q", "nq")), "cheap": _least(fit, _mean("c", "nc")),
                          "first": first}))
    chosen = {"strongest_global": F.col("strongest"), "strongest_per_dataset": F.coalesce("champion", "first"),
              "cheapest_global": F.col("cheap"), "oracle": F.col("oracle"), "random": random_model(models, seed)}
    picks = F.array(*[F.struct(F.lit(n).alias("router"), m.alias("model_id")) for n, m in chosen.items()])
    out = rows.select("sample_id", "dataset", "cells", F.explode(picks).alias("x"))
    # the oracle decides only where there is an outcome
    out = out.filter((F.col("x.router") != "oracle") | F.col("x.model_id").isNotNull())
    cell = F.col("cells")[F.col("x.model_id")]
    return out.select("x.router", "sample_id", "dataset", "x.model_id", cell["quality"].alias("quality"),
                      cell["cost"].alias("cost"))


def baseline_report(meta: DataFrame, outcomes: DataFrame, models: list[str], fit_split: str = "train",
                    eval_split: str = "test", seed: int = 42, beta: float = 0.1) -> DataFrame:
    """The five baselines scored overall and per dataset, from two scans of the fact table.

    The row without a dataset is the overall score.
    """
    stats = model_statistics(meta, outcomes)
    chosen = _baseline_choices(meta, outcomes, stats, models, fit_split, eval_split, seed)
    return E.score_sets(chosen, bounds_of(stats), [["router"], ["router", "dataset"]], beta)


def baseline_samples(meta: DataFrame, outcomes: DataFrame, models: list[str], fit_split: str = "train",
                     eval_split: str = "test", seed: int = 42) -> DataFrame:
    """Choice, correctness and cost of every baseline on every sample."""
    index = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model_id")).cast("int") - 1
    stats = model_statistics(meta, outcomes)
    return _baseline_choices(meta, outcomes, stats, models, fit_split, eval_split, seed).select(
        "router", "sample_id", "dataset", index.alias("pred_model_idx"), F.col("model_id").alias("pred_model"),
        F.col("quality").alias("correct"), "cost")


def run_report(decisions: DataFrame, meta: DataFrame, outcomes: DataFrame, beta: float = 0.1) -> DataFrame:
    """Scores of one policy per split and per (split, dataset)."""
    gathered = E.gather(decisions, outcomes).join(meta.select("sample_id", "split", "dataset"), "sample_id")
    return E.score_sets(gathered, cost_bounds(outcomes), [["split"], ["split", "dataset"]], beta)


def sweep_predictions(risks: DataFrame, outcomes: DataFrame, cmin: Column, cmax: Column,
                      lambdas: list[float], use_cost: bool = True) -> DataFrame:
    """Choice per (lambda, sample) with risk, normalised cost and route score."""
    return risk_route(route_scores(risks, outcomes, cmin, cmax, lambdas, use_cost))


def sweep_summary(chosen: DataFrame, outcomes: DataFrame, bounds: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row per lambda with its score and its distance to the oracle."""
    o = oracle_route(outcomes).agg(F.avg("quality").alias("a"), F.avg("cost").alias("c"))
    return (E.score(chosen, bounds, ["lambda_cost"], beta)
            .withColumn("oracle_gap", o.select("a").scalar() - F.col("accuracy"))
            .withColumn("router", F.concat(F.lit("risk-"), F.col("lambda_cost").cast("string"))))
