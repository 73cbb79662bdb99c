"""Calibration, ranking quality and the accuracy-cost frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.functions.scores import hash_bucket
from routeyard.operators.prefix import running_totals, totals_in_ranges, with_range
from routeyard.runtime import finite


def _usable(pairs: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        pairs = pairs.filter(finite(F.col(c).cast("double")))
    return pairs


def brier_score(pairs: DataFrame) -> DataFrame:
    return _usable(pairs, "label", "p").agg(
        F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"))


def calibration_bins(pairs: DataFrame, n_bins: int = 15) -> DataFrame:
    """Mean confidence and frequency per equal-width bin; the last bin holds 1.0.

    Edges are compared as numbers, so a value on an edge opens the next bin.
    Probabilities outside [0, 1] are in no bin but count in the weights.
    """
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    p = F.col("p")
    inside = (p >= 0) & (p <= 1)
    bin_no = F.when(inside, F.size(F.filter(edges, lambda e: e <= p)))
    return _usable(pairs, "label", "p").withColumn("bin", bin_no).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("label").alias("frequency"))


def calibration_error(pairs: DataFrame, n_bins: int = 15) -> DataFrame:
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("confidence") - F.col("frequency")))
    return calibration_bins(pairs, n_bins).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def tied_ranks(pairs: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Average rank of each distinct score, with how many rows and positives share it."""
    by_score = _usable(pairs, "label", "p").groupBy(*groups, "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    ranked = running_totals(by_score, "p", {"upto": F.col("n")}, groups=groups)
    return ranked.withColumn("rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).drop("upto")


def failure_auc(pairs: DataFrame) -> DataFrame:
    """Chance that a failure scores above a success, ties counted half; NULL with one class only."""
    return _auc_of(tied_ranks(pairs))


def _auc_of(ranks: DataFrame) -> DataFrame:
    t = ranks.agg(F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    auc = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / F.lit(2.0)) / F.nullif(
        F.col("pos") * F.col("neg"), F.lit(0.0))
    return t.select(auc.alias("auc"))


def running_accuracy(chosen: DataFrame) -> DataFrame:
    """Accuracy over the rows up to each one, in ascending risk.

    Equal risks are ordered by a hash of the sample id, so a risk value shared
    by very many samples is still spread over several tasks.
    """
    rows = _usable(chosen, "risk", "correct").withColumn("tie", hash_bucket(F.col("sample_id")))
    run = running_totals(rows, "risk", {"seen": F.lit(1), "hits": F.col("correct")},
                         tie=F.col("tie") / F.lit(float(2 ** 32)), then_by=["sample_id"], overall=True)
    return run.select("sample_id", "risk", "correct", "seen", (F.col("hits") / F.col("seen")).alias("accuracy"),
                      F.col("seen_total").alias("total"))


def risk_coverage_auc(chosen: DataFrame) -> DataFrame:
    """Trapezoid area under running accuracy over coverage, from the closed form."""
    return _area_of(running_accuracy(chosen))


def _area_of(run: DataFrame) -> DataFrame:
    a = F.col("accuracy")
    ends = (F.max(F.when(F.col("seen") == 1, a)) - F.max(F.when(F.col("seen") == F.col("total"), a))) / F.lit(2.0)
    return run.agg(((F.sum(a) + ends) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("area"))


def risk_statistics(risks: DataFrame, decisions: DataFrame, outcomes: DataFrame, n_bins: int = 15) -> DataFrame:
    """One row: ranking, calibration and coverage of predicted risks, as the single operators give them.

    Risks meet outcomes and decisions once; the joined rows are dealt in ranges of risk and written, and every figure
    is summed from them.  Mean and deviation take all risks, the rest those with an outcome.
    """
    keys = ["sample_id", "model_id"]
    joined = (risks.select(*keys, F.col("risk").cast("double").alias("p"))
              .join(outcomes.select(*keys, "quality"), keys, "left")
              .join(decisions.select(*keys, F.lit(True).alias("__taken")), keys, "left"))
    rows = with_range(joined.select("sample_id", "p", (F.lit(1) - F.col("quality")).cast("double").alias("label"),
                                    F.col("quality").alias("correct"), F.coalesce("__taken", F.lit(False)).alias("taken"),
                                    (hash_bucket(F.col("sample_id")) / F.lit(float(2 ** 32))).alias("tie")), "p", "tie")
    pairs = _usable(rows, "label", "p")

    # a score that fills several ranges counts in the first of them, which keeps the ranges in order
    by_score = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.min("__range").alias("__range"))
    ranks = totals_in_ranges(by_score, ["p"], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0))
    run = totals_in_ranges(pairs.filter("taken"), ["p", "tie", "sample_id"], {"seen": F.lit(1), "hits": F.col("correct")}, overall=True)
    run = run.select("seen", (F.col("hits") / F.col("seen")).alias("accuracy"), F.col("seen_total").alias("total"))
    return (rows.agg(F.avg("p").alias("risk_mean"), F.stddev_pop("p").alias("risk_std"))
            .withColumn("failure_auc", _auc_of(ranks).select("auc").scalar())
            .withColumn("brier", brier_score(pairs).select("brier").scalar())
            .withColumn("ece", calibration_error(pairs, n_bins).select("ece").scalar())
            .withColumn("risk_coverage_auc", _area_of(run).select("area").scalar()))


def pareto(points: DataFrame, slack: float = 1e-12) -> DataFrame:
    """Flag points that beat the accuracy of every cheaper point.

    ``points`` has one row per router or run; the unpartitioned window sees
    only those.  A point counts against later ones only if it was kept, which
    for strict gains is the same as the running maximum.
    """
    acc = F.when(finite("accuracy"), F.col("accuracy"))
    cheapest_first = (Window.orderBy(
        F.when(finite("avg_cost"), F.col("avg_cost")).otherwise(F.lit(float("inf"))),
        (-F.coalesce(acc, F.lit(float("-inf")))), "router")
        .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.max(acc).over(cheapest_first), F.lit(float("-inf")))
    return points.withColumn("is_frontier", F.coalesce(acc > before + F.lit(slack), F.lit(False)).cast("int"))


def frontier_points(summary: DataFrame) -> DataFrame:
    """The accuracy-cost frontier of baseline routers, the oracle left out."""
    usable = summary.filter((F.lower("router") != "oracle") & finite("accuracy") & finite("avg_cost"))
    return pareto(usable).filter("is_frontier = 1").drop("is_frontier")


def frontier_match(points: DataFrame, frontier: DataFrame, slack: float = 1e-12) -> DataFrame:
    """Compare points with a frontier.

    Adds the best frontier accuracy at no more cost, and the relative saving
    against the cheapest frontier point of at least the same accuracy.  The
    frontier has one row per router at most and enters as one small array.
    """
    packed = frontier.filter(finite("accuracy") & finite("avg_cost")).agg(
        F.collect_list(F.struct(F.col("accuracy").alias("a"), F.col("avg_cost").alias("c"))).alias("f")).scalar()
    cost, acc = F.col("avg_cost"), F.col("accuracy")
    as_cheap = F.filter(F.col("__f"), lambda f: f["c"] <= cost + F.lit(slack))
    as_good = F.filter(F.col("__f"), lambda f: f["a"] >= acc - F.lit(slack))
    base = F.array_min(F.transform(as_good, lambda f: f["c"]))
    return (points.withColumn("__f", packed)
            .withColumn("matched_cost_accuracy", F.array_max(F.transform(as_cheap, lambda f: f["a"])))
            .withColumn("matched_accuracy_cost_reduction", F.when(base > 0, (base - cost) / base)).drop("__f"))


def frontier_table(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs and baseline points together, tagged by source, with the joint frontier flag."""
    both = runs.withColumn("source", F.lit("run")).unionByName(
        baseline.withColumn("source", F.lit("baseline")), allowMissingColumns=True)
    return pareto(both)
