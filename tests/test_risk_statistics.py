"""All figures of predicted risks from one ordered pass equal the single operators."""

import random

import pytest
from pyspark.sql import functions as F

from routeyard.operators import calibration as K

NAMES = ("failure_auc", "brier", "ece", "risk_coverage_auc", "risk_mean", "risk_std")


def apart(risks, decisions, outcomes, n_bins):
    keys = ["sample_id", "model_id"]
    pairs = risks.join(outcomes, keys).select(*keys, (1 - F.col("quality")).cast("double").alias("label"), F.col("risk").alias("p"))
    chosen = decisions.join(risks, keys).join(outcomes, keys).select("sample_id", "risk", F.col("quality").alias("correct"))
    s = risks.agg(F.avg("risk"), F.stddev_pop("risk")).first()
    return (K.failure_auc(pairs).first()[0], K.brier_score(pairs).first()[0], K.calibration_error(pairs, n_bins).first()[0],
            K.risk_coverage_auc(chosen).first()[0], s[0], s[1])


@pytest.mark.parametrize("kind", ["ties", "one value", "distinct", "gaps", "empty"])
def test_one_pass_equals_single_operators(spark, kind):
    rng = random.Random(3)
    draw = {"ties": lambda: rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]), "one value": lambda: 0.25}.get(kind, rng.random)
    ids, models = [f"s{i}" for i in range(300)], ["a", "b", "c"]
    risks = [(s, m, draw()) for s in ids for m in models]
    outcomes = [(s, m, rng.randint(0, 1)) for s in ids for m in models]
    if kind == "gaps":
        outcomes = [(s, m, None if rng.random() < 0.1 else q) for s, m, q in outcomes if rng.random() < 0.8]
        risks = [(s, m, None if rng.random() < 0.1 else p) for s, m, p in risks if rng.random() < 0.8]
    decisions = [(s, rng.choice([*models, "unknown"])) for s in ids]
    if kind == "empty":
        risks = outcomes = decisions = []
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    r = frame(risks, "sample_id string, model_id string, risk double")
    o = frame(outcomes, "sample_id string, model_id string, quality int")
    d = frame(decisions, "sample_id string, model_id string")
    for n_bins in (4, 15):
        got = K.risk_statistics(r, d, o, n_bins).first()
        assert [got[n] for n in NAMES] == [x if x is None else pytest.approx(x, abs=1e-12) for x in apart(r, d, o, n_bins)]


def test_figures_are_read_from_stored_rows(spark):
    rows = spark.createDataFrame([("s", "a", 0.5, 1)], "sample_id string, model_id string, risk double, quality int")
    plan = K.risk_statistics(rows.drop("quality"), rows.select("sample_id", "model_id"), rows.drop("risk"))._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan
