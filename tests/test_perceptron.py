"""The perceptron that learns whole target distributions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard.operators import labels as L
from routeyard.operators import learners as LN
from routeyard.operators import perceptron as PC
from routeyard.plans.catalog.aggregates import fused


@pytest.mark.parametrize("layers", [[3, 4], [3, 5, 4], [2, 3, 3, 2]])
def test_slope_equals_differences(layers):
    rng = np.random.default_rng(1)
    weights = PC.start_weights(layers, 7) + rng.normal(0, 0.1, len(PC.start_weights(layers, 7)))
    x, t = rng.normal(size=(9, layers[0])), rng.random((9, layers[-1]))
    t[0] = 0.0                                                       # a row without targets takes no part
    slope = PC.loss_and_slope(weights, layers, x, t)[1:]
    step = np.eye(len(weights)) * 1e-6
    by_hand = [(PC.loss_and_slope(weights + d, layers, x, t)[0] - PC.loss_and_slope(weights - d, layers, x, t)[0]) / 2e-6 for d in step]
    assert np.abs(slope - by_hand).max() < 1e-6


def test_minimise_finds_the_least_value():
    a = np.diag([1.0, 10.0, 100.0])
    point, losses = PC.minimise(lambda w: (float((w - 2) @ a @ (w - 2)), 2 * a @ (w - 2)), np.zeros(3), 200, 1e-15)
    assert np.abs(point - 2).max() < 1e-5 and losses == sorted(losses, reverse=True)
    flat, losses = PC.minimise(lambda w: (1.0, np.zeros(2)), np.ones(2), 10, 1e-6)
    assert list(flat) == [1, 1] and losses == [1.0]


def test_soft_perceptron_learns_the_distribution(spark, sf, tmp_path):
    o, f = D.outcomes(spark, sf), fused(spark, sf)
    policy = LN.MlpPolicy(D.MODEL_IDS, hidden=(8,), lam=10.0, max_iter=40).fit(o, f)
    assert policy.losses == sorted(policy.losses, reverse=True)

    kept = L.solvable(o)
    cells = policy.scores(f).join(L.soft_targets(kept, 10.0), ["sample_id", "model_id"])
    entropy = -F.avg(F.col("target") * F.log("score")) * len(D.MODEL_IDS)
    reached = cells.agg(entropy.alias("e")).first()["e"]
    assert abs(reached - policy.losses[-1]) < 1e-6                   # the classifier scores with the fitted weights
    shares = L.soft_targets(kept, 10.0).groupBy("model_id").agg(F.avg("target").alias("p")).collect()
    assert reached < -sum(r["p"] * np.log(r["p"]) for r in shares if r["p"] > 0)    # better than the mean distribution

    # the stored layers run forward give the classifier's probabilities
    rows = policy._vectors(f).select("sample_id", vector_to_array("features").alias("x"))
    got = policy.model.transform(policy._vectors(f)).select("sample_id", vector_to_array("probability").alias("p"))
    both = rows.join(got, "sample_id").collect()
    forward = PC.probabilities(policy.model.weights.toArray(), list(policy.model.getLayers()), np.array([r["x"] for r in both]))
    assert np.abs(forward - np.array([r["p"] for r in both])).max() < 1e-9

    path = str(tmp_path / "soft")
    policy.save(path)
    assert LN.MlpPolicy.load(spark, path).route(f).exceptAll(policy.route(f)).count() == 0


def test_soft_fit_does_not_depend_on_partitions(spark, sf):
    o, f = D.outcomes(spark, sf), fused(spark, sf)
    one, two = (LN.MlpPolicy(D.MODEL_IDS, hidden=(4,), lam=1.0, max_iter=3).fit(o.repartition(n), f.repartition(n)) for n in (1, 7))
    assert np.abs(one.model.weights.toArray() - two.model.weights.toArray()).max() < 1e-6
