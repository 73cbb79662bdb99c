"""Fits at their registered settings, saved; DuckDB scores every sample again from what was stored."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard.operators import labels as L
from routeyard.operators import learners as LN
from routeyard.operators import perceptron as PC
from routeyard.plans.catalog.aggregates import fused
from routeyard.plans.catalog.learners import _train_outcomes

# (sample_id, z): standardised features, from the stored scaler
STANDARD = """, z AS (SELECT sample_id, list_transform(range(1, len(v) + 1), lambda i: (v[i] - s.mean[i]) / s.std[i]) AS z
  FROM (SELECT sample_id, list_concat(text_vec, image_vec) AS v FROM features), read_parquet('{path}/scaler/*.parquet') s)"""


def frame(matrix, intercepts, names):
    return pd.DataFrame({"unit": names, "w": [list(map(float, r)) for r in matrix], "b": [float(x) for x in intercepts]})


def agree(duck, policy, loaded, f, scored_sql, path):
    """Same scores to 1e-9 and the same decision for every sample."""
    got = {(r["sample_id"], r["model_id"]): r["score"] for r in policy.scores(f).collect()}
    want = {(i, m): s for i, m, s in duck.execute(D.oracle(scored_sql)).fetchall()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in got) < 1e-9
    best = {}
    for (i, m), s in sorted(want.items()):
        if i not in best or round(s, 10) > round(best[i][1], 10):
            best[i] = (m, s)
    differ = [r for r in loaded.route(f).collect() if abs(want[r["sample_id"], r["model_id"]] - best[r["sample_id"]][1]) > 1e-9]
    assert not differ and len(best) == f.count()


@pytest.fixture(scope="module")
def history(spark, sf):
    return _train_outcomes(spark, sf), fused(spark, sf)


def saved(spark, policy, history, tmp_path):
    path = str(tmp_path / "policy")
    policy.fit(*history).save(path)
    return path, type(policy).load(spark, path)


def test_heads(spark, duck, history, tmp_path):
    policy = LN.OneVsRestPolicy(D.MODEL_IDS)
    path, loaded = saved(spark, policy, history, tmp_path)
    agree(duck, policy, loaded, history[1], STANDARD.format(path=path) + f""",
        h AS (SELECT model_id, list(value ORDER BY dim) AS w FROM read_parquet('{path}/heads/*.parquet') GROUP BY model_id)
        SELECT sample_id, model_id, 1 / (1 + exp(-(w[1] + list_dot_product(z, w[2:])))) FROM z, h""", path)


@pytest.mark.parametrize("lam", [None, 10.0])
def test_linear(spark, duck, history, tmp_path, lam):
    policy = LN.LinearPolicy(D.MODEL_IDS, lam=lam)
    path, loaded = saved(spark, policy, history, tmp_path)
    duck.register("stored", frame(loaded.model.coefficientMatrix.toArray(), loaded.model.interceptVector.toArray(), D.MODEL_IDS))
    agree(duck, policy, loaded, history[1], STANDARD.format(path=path) + """,
        e AS (SELECT sample_id, unit, exp(b + list_dot_product(z, w)) AS e FROM z, stored)
        SELECT sample_id, unit, e / sum(e) OVER (PARTITION BY sample_id) FROM e""", path)


def test_perceptron_layers(spark, duck, history, tmp_path):
    policy = LN.MlpPolicy(D.MODEL_IDS)
    path, loaded = saved(spark, policy, history, tmp_path)
    layers = list(loaded.model.getLayers())
    assert layers[1:-1] == [256]
    for name, (matrix, bias) in zip(("hidden", "last"), PC.unpacked(loaded.model.weights.toArray(), layers)):
        by_unit = np.asarray(matrix) if len(matrix) == len(bias) else np.asarray(matrix).T
        duck.register(name, frame(by_unit, bias, D.MODEL_IDS if name == "last" else list(range(len(bias)))))
    agree(duck, policy, loaded, history[1], STANDARD.format(path=path) + """,
        a AS (SELECT sample_id, list(1 / (1 + exp(-(b + list_dot_product(z, w)))) ORDER BY unit) AS a FROM z, hidden GROUP BY sample_id),
        e AS (SELECT sample_id, unit, exp(b + list_dot_product(a, w)) AS e FROM a, last)
        SELECT sample_id, unit, e / sum(e) OVER (PARTITION BY sample_id) FROM e""", path)


def test_clusters(spark, duck, sf):
    scores = L.normalized_scores(D.outcomes(spark, sf))
    part = lambda s: scores.join(D.meta(spark, sf).filter(F.col("split") == s).select("sample_id"), "sample_id", "left_semi")
    centres = LN.cluster_centres(part("train"), D.MODEL_IDS)
    duck.register("centres", pd.DataFrame([(r["cluster"], r["centre"]) for r in centres.collect()], columns=["cluster", "centre"]))
    cells = """, share AS (SELECT sample_id, model_id, COALESCE(quality / nullif(sum(quality) OVER (PARTITION BY sample_id), 0), 0) AS t FROM outcomes),
        v AS (SELECT sample_id, split, list(t::DOUBLE ORDER BY model_id) AS v FROM share JOIN meta USING (sample_id) GROUP BY ALL),
        own AS (SELECT sample_id, split, any_value(v) AS v, arg_min(cluster, row(round(list_distance(v, centre), 9), cluster)) AS cluster
                FROM v, centres GROUP BY ALL)"""
    own = dict(duck.execute(D.oracle(cells + " SELECT sample_id, cluster FROM own")).fetchall())
    for split in ("train", "dev"):
        placed = LN.behaviour_clusters(part("train"), D.MODEL_IDS, assign=part(split)).collect()
        assert placed and [r for r in placed if own[r["sample_id"]] != r["cluster"]] == []
    off = duck.execute(D.oracle(cells + """, m AS (SELECT cluster, i, avg(v[i]) AS m FROM own, range(1, 9) r(i) WHERE split = 'train' GROUP BY ALL)
        SELECT max(abs(m - centre[i])), count(DISTINCT cluster) FROM m JOIN centres USING (cluster)""")).fetchone()
    assert off[0] < 1e-12 and off[1] > 1


def test_clusters_of_few_and_no_samples(spark):
    rows = spark.createDataFrame([("a", "m0", 1.0), ("b", "m1", 1.0), ("b", "m0", None), ("c", "m1", 1.0)], "sample_id string, model_id string, target double")
    got = {r["sample_id"]: r["cluster"] for r in LN.behaviour_clusters(rows, ["m0", "m1"]).collect()}
    assert got["b"] == got["c"] != got["a"]
    assert LN.behaviour_clusters(rows.limit(0), ["m0", "m1"]).count() == 0
    none = LN.behaviour_clusters(rows.limit(0), ["m0", "m1"], assign=rows).collect()
    assert [r["cluster"] for r in none] == [None] * 3
