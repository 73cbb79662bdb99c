"""Fitted risk under many settings at once: seeds and cost weights, ablations, held-out types, datasets and models.

All settings share one design table and one pass per Newton step.  Scores of all settings are numbers per sample, type and
model, so routing needs one row per sample with its outcomes as a small array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.scores import normalize_cost, rank_score, stable_unit
from routeyard.operators.block_fits import RiskFit, RiskModel, design, fit_risks, risk_scores
from routeyard.operators.experiments import calibration_subset, heldout_splits, model_split
from routeyard.operators.features import ablation_switches, fit_standardizer, heldout_profiles, model_profiles, standardize
from routeyard.runtime import finite, persisted

BRIER = 0.3
#: Modes whose term of the training loss the convex fit doesn't have; they would repeat the full fit.
WITHOUT_TERM = ("no_ranking", "no_route_ce")


def poisson_weight(sample_id: Column, seed: int) -> Column:
    """How often a bootstrap sample draws a row: a Poisson number of mean 1 from a hashed uniform."""
    u, out, total, term = stable_unit(sample_id, f"bootstrap|{seed}"), F, 0.0, float(np.exp(-1.0))
    for k in range(8):
        total += term
        out = out.when(u < total, F.lit(float(k)))
        term /= k + 1
    return out.otherwise(F.lit(8.0))


def scaled_profiles(profiles: DataFrame, models: list[str], fitted_on: list[str]) -> np.ndarray:
    """One row per model, standardised by the models fitted on; a deviation under 1e-6 counts as 1."""
    by = {r["model_id"]: r["profile"] for r in profiles.collect()}
    seen = np.array([by[m] for m in fitted_on if m in by])
    std = seen.std(axis=0)
    width = seen.shape[1]
    return (np.array([by.get(m, [0.0] * width) for m in models]) - seen.mean(axis=0)) / np.where(std < 1e-6, 1.0, std)


def _cells(outcomes: DataFrame, models: list[str]) -> DataFrame:
    """Per sample the outcome of every model, in the order of ``models``; a missing one stays null."""
    cell = lambda m: F.max_by(F.struct("quality", "cost"), F.col("model_id") == m)
    have = lambda m: F.max(F.col("model_id") == m)
    return outcomes.filter(F.col("model_id").isin(models)).groupBy("sample_id").agg(
        F.array(*[F.when(have(m), cell(m)) for m in models]).alias("cells"))


def _choice(z: Column, cells: Column, models: list[str], low: Column, high: Column, weight: Column) -> Column:
    """The model of least risk plus weighted normalised cost, with its numbers; models without an outcome don't count."""
    names = F.array(*[F.lit(m) for m in models])
    priced = F.transform(F.arrays_zip(names.alias("m"), z.alias("z"), cells.alias("c")), lambda x: F.when(x["c"].isNotNull(), F.struct(
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-x["z"])) + weight * normalize_cost(x["c"]["cost"], low, high)).alias("route_score"),
        x["m"].alias("model_id"), x["c"]["quality"].alias("quality"), x["c"]["cost"].alias("cost"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-x["z"]))).alias("risk"),
        normalize_cost(x["c"]["cost"], low, high).alias("normalized_cost"))))
    return F.array_min(F.filter(priced, lambda x: x.isNotNull()))


@dataclass
class Sweep:
    """Models fitted on bootstrap samples of the training rows, one per seed, and their choices on the rows to judge."""

    models: list[str]
    profiles: np.ndarray
    scaler: DataFrame
    fitted: dict[int, RiskModel]
    choices: DataFrame          # seed, lambda_cost, sample_id, model_id, quality, cost, risk, normalized_cost, route_score


def learned_sweep(samples: DataFrame, outcomes: DataFrame, train: DataFrame, judged: DataFrame, profiles: DataFrame,
                  bounds: DataFrame, lambdas: list[float], seeds: list[int], reg: float = 1e-3, brier: float = 0.0) -> Sweep:
    """Fit one risk model per seed and route every judged sample under every cost weight.

    ``samples`` is (sample_id, query_type, vec), ``train`` and ``judged`` are sample ids, ``bounds`` has one row of cmin and
    cmax.  Every seed's bootstrap sample draws training rows by a hash of their id, so it doesn't depend on partitions.
    """
    models = sorted(r["model_id"] for r in profiles.select("model_id").collect())
    matrix = scaled_profiles(profiles, models, models)
    fit_rows = samples.join(train.select("sample_id"), "sample_id", "left_semi")
    scaler = persisted(fit_standardizer(fit_rows, "vec"), "sample-scaler")
    weights = [poisson_weight(F.col("sample_id"), s) for s in seeds]
    table = design(standardize(fit_rows, "vec", scaler), outcomes, F.lit(1) - F.col("quality"), models, weights, "sweep")
    fitted = dict(zip(seeds, fit_risks(table, [RiskFit(matrix, brier=brier) for _ in seeds], reg)))
    rows = standardize(samples.join(judged.select("sample_id"), "sample_id", "left_semi"), "vec", scaler)
    scored = risk_scores(rows, [(fitted[s], matrix) for s in seeds], models).join(_cells(outcomes, models), "sample_id")
    scored = scored.withColumns({"__low": bounds.select("cmin").scalar(), "__high": bounds.select("cmax").scalar()})
    pick = [F.struct(F.lit(s).alias("seed"), F.lit(float(x)).alias("lambda_cost"), _choice(
        F.col("z")[i], F.col("cells"), models, F.col("__low"), F.col("__high"), F.lit(float(x))).alias("best"))
        for i, s in enumerate(seeds) for x in lambdas]
    chosen = scored.select("sample_id", F.explode(F.array(*pick)).alias("p")).select("p.seed", "p.lambda_cost", "sample_id", "p.best.*")
    return Sweep(models, matrix, scaler, fitted, persisted(chosen, "sweep-choices"))


def seed_scores(choices: DataFrame, bounds: DataFrame, beta: float = 0.1) -> DataFrame:
    """One score row per seed and cost weight."""
    known = F.when(finite("cost"), F.col("cost"))
    out = choices.groupBy("seed", "lambda_cost").agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(F.col("quality").cast("double")).alias("accuracy"), F.avg(known).alias("avg_cost"),
        F.avg("normalized_cost").alias("avg_normalized_cost"), F.avg("risk").alias("avg_risk"))
    bounded = out.withColumns({"__low": bounds.select("cmin").scalar(), "__high": bounds.select("cmax").scalar()})
    return bounded.withColumn("rank_score", rank_score(F.col("accuracy"), F.col("avg_cost"), F.col("__low"), F.col("__high"), beta)).drop(
        "__low", "__high")


def seed_spread(scores: DataFrame) -> DataFrame:
    """Mean and spread over the seeds, per cost weight."""
    measures = ("accuracy", "avg_cost", "rank_score", "avg_risk")
    return scores.groupBy("lambda_cost").agg(F.count(F.lit(1)).alias("seeds"), F.max("num_samples").alias("num_samples"), *[
        f(c).alias(f"{c}_{name}") for c in measures for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


@dataclass
class Run:
    """One experiment: an ablation mode, samples to hold out, models to hold out."""

    name: str
    mode: str = "full"
    held: Column | None = None              # over sample_id, dataset, split and query_type
    heldout_models: tuple[str, ...] = ()
    calibration: int = 0


def feature_columns(mode: str, text_dim: int, image_dim: int, extras: int) -> np.ndarray:
    """Which columns an ablation sees of vectors made of embeddings, four numbers, the types, extras and random extras."""
    switches, _ = ablation_switches(mode)
    drawn = switches["include_extras"] and switches["random_extras"]
    real = switches["include_extras"] and not switches["random_extras"]
    blocks = [(text_dim + image_dim, switches["include_embeddings"]), (4, True), (len(V.QUERY_TYPES), switches["include_query_type"]),
              (extras, real), (extras, drawn)]
    return np.concatenate([np.full(n, bool(on)) for n, on in blocks])


def fitted_runs(samples: DataFrame, meta: DataFrame, outcomes: DataFrame, runs: list[Run], text_dim: int, image_dim: int, extras: int,
                reg: float = 1e-3, brier: float = BRIER) -> tuple[list[RiskModel], DataFrame]:
    """Fit all runs in one pass per step and score all their pairs.

    ``samples`` is (sample_id, query_type, vec) with the columns that ``feature_columns`` describes, ``meta`` (sample_id, dataset,
    split).  Returns the models and a table with one row per sample: its outcomes, per run its scores ``z``, and in ``sides``
    per run whether it trains or tests.  Vectors are standardised by the standard training rows.
    """
    models = sorted(r["model_id"] for r in outcomes.select("model_id").distinct().collect())
    rows = samples.join(meta.select("sample_id", "dataset", "split"), "sample_id")
    known = persisted(rows.select("sample_id", "dataset", "split", "query_type"), "run-samples")
    # per run: 1 trains, 2 tests, 0 neither; held-out samples may change sides
    marks = known.select("sample_id", F.when(F.col("split") == "train", 1).when(F.col("split") == "test", 2).otherwise(0).alias("standard"))
    names = []
    for i, run in enumerate(runs):
        if run.held is None:
            names.append(F.col("standard"))
            continue
        own = heldout_splits(known, run.held).filter("split IN ('train', 'test')").groupBy("sample_id").agg(
            F.max(F.when(F.col("split") == "test", 2).otherwise(1)).alias(f"__side{i}"))
        marks = marks.join(own, "sample_id", "left")
        names.append(F.coalesce(F.col(f"__side{i}"), F.lit(0)))
    sides = persisted(marks.select("sample_id", F.array(*names).alias("sides")), "run-sides")
    train = rows.filter(F.col("split") == "train").select("sample_id", "query_type", "vec")
    scaler = persisted(fit_standardizer(train, "vec"), "sample-scaler")
    scaled = standardize(rows.select("sample_id", "query_type", "vec"), "vec", scaler).join(sides, "sample_id")

    fits, types = [], known.select("sample_id", "query_type")
    for i, run in enumerate(runs):
        seen, out = model_split(models, list(run.heldout_models))
        _, switches = ablation_switches(run.mode)
        ids = sides.filter(F.col("sides")[i] == 1).select("sample_id")
        history = outcomes.join(ids, "sample_id", "left_semi")
        if out:
            few = calibration_subset(ids, run.calibration) if run.calibration else None
            profiles = heldout_profiles(history, types, seen, out, few, **switches)
        else:
            profiles = model_profiles(history, types, **switches)
        fits.append(RiskFit(scaled_profiles(profiles, models, seen), F.when(F.col("sides")[i] == 1, 1.0).otherwise(0.0),
                            feature_columns(run.mode, text_dim, image_dim, extras), np.isin(models, seen),
                            run.mode != "no_query_type", 0.0 if run.mode == "no_calibration" else brier))
    # the design drops the sides, so the weights are taken while the rows still have them
    weighted = scaled.withColumn("__w", F.array(*[f.weight for f in fits]))
    learnt = outcomes.filter(F.col("model_id").isin(models))
    table = design(weighted, learnt, F.lit(1) - F.col("quality"), models, [F.col("__w")[i] for i in range(len(fits))], "runs")
    fitted = fit_risks(table, fits, reg)
    scored = risk_scores(scaled, [(m, f.profiles) for m, f in zip(fitted, fits)], models)
    return fitted, persisted(scored.join(sides, "sample_id").join(_cells(outcomes, models), "sample_id").withColumn(
        "models", F.array(*[F.lit(m) for m in models])), "run-scores")


def run_scores(scored: DataFrame, runs: list[Run], bounds: DataFrame, lam: float = 0.1, beta: float = 0.1) -> DataFrame:
    """One row per run: its choices on its test samples, and how good its risks are there."""
    models = [x for x in (scored.select("models").first() or [[]])[0]]
    rows = scored.withColumns({"__low": bounds.select("cmin").scalar(), "__high": bounds.select("cmax").scalar()})
    picks = [F.struct(F.lit(r.name).alias("run"), F.lit(r.mode).alias("mode"), F.col("sides")[i].alias("side"), _choice(
        F.col("z")[i], F.col("cells"), models, F.col("__low"), F.col("__high"), F.lit(float(lam))).alias("best"),
        _errors(F.col("z")[i], F.col("cells")).alias("error")) for i, r in enumerate(runs)]
    chosen = rows.select("__low", "__high", F.explode(F.array(*picks)).alias("p")).filter("p.side = 2").select(
        "__low", "__high", "p.run", "p.mode", "p.best.*", "p.error")
    out = chosen.groupBy("run", "mode").agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(F.col("quality").cast("double")).alias("accuracy"), F.avg("cost").alias("avg_cost"),
        (F.sum("error.loss") / F.sum("error.n")).alias("log_loss"), (F.sum("error.square") / F.sum("error.n")).alias("brier"),
        F.any_value("__low").alias("__low"), F.any_value("__high").alias("__high"))
    return out.withColumn("rank_score", rank_score(F.col("accuracy"), F.col("avg_cost"), F.col("__low"), F.col("__high"), beta)).drop(
        "__low", "__high")


def _pairs(z: Column, cells: Column) -> Column:
    """(p, y) of the models that have an outcome."""
    both = F.filter(F.arrays_zip(z.alias("z"), cells.alias("c")), lambda x: x["c"].isNotNull())
    return F.transform(both, lambda x: F.struct((F.lit(1.0) / (F.lit(1.0) + F.exp(-x["z"]))).alias("p"),
                                                (F.lit(1) - x["c"]["quality"]).cast("double").alias("y")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _errors(z: Column, cells: Column) -> Column:
    pairs = _pairs(z, cells)
    loss = F.transform(pairs, lambda x: -F.log(F.greatest(F.when(x["y"] == 1, x["p"]).otherwise(1 - x["p"]), F.lit(1e-300))))
    return F.struct(_total(loss).alias("loss"), _total(F.transform(pairs, lambda x: (x["p"] - x["y"]) ** 2)).alias("square"),
                    F.size(pairs).alias("n"))


def run_moments(scored: DataFrame, runs: list[Run], brier: float = BRIER) -> DataFrame:
    """Per run: training pairs, and the mean of risk plus the slope of its squared error, which a finished fit makes the failure rate."""
    models = [x for x in (scored.select("models").first() or [[]])[0]]
    parts = []
    for i, r in enumerate(runs):
        seen, _ = model_split(models, list(r.heldout_models))
        keep = [m in seen for m in models]
        z = F.array(*[F.col("z")[i][k] for k, on in enumerate(keep) if on])
        cells = F.array(*[F.col("cells")[k] for k, on in enumerate(keep) if on])
        b = 0.0 if r.mode == "no_calibration" else brier
        pairs = _pairs(z, cells)
        moment = _total(F.transform(pairs, lambda x: x["p"])) + 2 * b * _total(
            F.transform(pairs, lambda x: (x["p"] - x["y"]) * x["p"] * (1 - x["p"])))
        parts.append(F.struct(F.lit(r.name).alias("run"), F.col("sides")[i].alias("side"), F.size(pairs).alias("n"), moment.alias("m")))
    return scored.select(F.explode(F.array(*parts)).alias("p")).filter("p.side = 1").groupBy("p.run").agg(
        F.sum("p.n").cast("bigint").alias("pairs"), (F.sum("p.m") / F.sum("p.n")).alias("moment"))
