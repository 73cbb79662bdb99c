"""Learned policies: better than the cheapest model, repeatable, and unchanged by saving."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard.operators import block_fits as BF
from routeyard.operators import costs as C
from routeyard.operators import evaluate as E
from routeyard.operators import features as FT
from routeyard.operators import learners as LN
from routeyard.operators import policies as P
from routeyard.operators import risk_runs as RR
from routeyard.plans.catalog.aggregates import fused, typed
from routeyard.plans.catalog.scalars import feature_vectors
from routeyard.runtime import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    from routeyard.runtime import persisted

    f = persisted(fused(spark, SF), "vectors")
    o = persisted(D.outcomes(spark, SF).join(f.select("sample_id"), "sample_id", "left_semi"), "outcomes")
    return f, o


def accuracy(decisions, o):
    return E.score(E.gather(decisions, o), C.cost_bounds(o)).first()["accuracy"]


@pytest.mark.parametrize("make", [
    lambda: LN.OneVsRestPolicy(D.MODEL_IDS), lambda: LN.LinearPolicy(D.MODEL_IDS, max_iter=20),
    lambda: LN.LinearPolicy(D.MODEL_IDS, lam=0.0, max_iter=20), lambda: LN.MlpPolicy(D.MODEL_IDS, hidden=(8,), max_iter=20)])
def test_better_than_cheapest(data, make):
    f, o = data
    got = make().fit(o, f).route(f)
    assert got.count() == f.count()
    assert accuracy(got, o) > accuracy(P.cheapest_global(f, o), o)


def test_risk_policy(spark, data):
    f, o = data
    vectors = feature_vectors(spark, SF)
    profiles = FT.model_profiles(o, typed(spark, SF))
    policy = LN.RiskPolicy().fit(o, vectors, profiles)
    risks = policy.risks(vectors)
    assert risks.filter("risk < 0 OR risk > 1").count() == 0
    b = C.cost_bounds(o)
    chosen = LN.risk_route(LN.route_scores(risks, o, E.bound(b, "cmin"), E.bound(b, "cmax"), [0.0, 100.0]))
    score = {r["lambda_cost"]: r for r in E.score(chosen, b, ["lambda_cost"]).collect()}
    assert score[0.0]["accuracy"] > accuracy(P.cheapest_global(f, o), o)
    assert score[100.0]["avg_cost"] <= score[0.0]["avg_cost"]
    path = scratch_path(spark, "risk")
    policy.save(path)
    again = LN.RiskPolicy.load(spark, path).risks(vectors)
    r = lambda df: df.withColumn("risk", F.round("risk", 9))
    assert r(again).exceptAll(r(risks)).count() == 0
    # the wide rows of Spark's own learner give the same fit
    train = policy._pairs(vectors, policy.profiles).join(
        o.select("sample_id", "model_id", (F.lit(1) - F.col("quality")).cast("double").alias("label")), ["sample_id", "model_id"])
    wide = LogisticRegression(maxIter=1000, regParam=policy.reg, tol=1e-10, standardization=False).fit(train)
    whole = wide.transform(policy._pairs(vectors, policy.profiles)).select(
        "sample_id", "model_id", F.element_at(vector_to_array("probability"), 2).alias("whole"))
    assert whole.join(risks, ["sample_id", "model_id"]).filter(F.abs(F.col("whole") - F.col("risk")) > 1e-4).count() == 0
    # every risk again in SQL, from the stored coefficients row by row
    for name, df in {"coefficients": spark.read.parquet(f"{path}/coefficients"), "risks": risks,
                     "z": FT.standardize(vectors, "vec", policy.sample_scaler).select("sample_id", "query_type", F.posexplode("vec").alias("dim", "x")),
                     "p": FT.standardize(policy.profiles, "profile", policy.profile_scaler).select("model_id", F.posexplode("profile").alias("dim", "x"))}.items():
        df.write.parquet(f"{path}/sql/{name}")
    read = lambda name: f"read_parquet('{path}/sql/{name}/*.parquet')"
    off = duckdb.sql(f"""WITH c AS (SELECT * FROM {read('coefficients')}),
        own AS (SELECT sample_id, any_value(query_type) AS query_type, sum(x * value) AS s FROM {read('z')} JOIN c USING (dim) WHERE part = 'sample' GROUP BY sample_id),
        m AS (SELECT kind, model_id, sum(x * value) AS s FROM {read('p')} JOIN c USING (dim) WHERE part = 'model' GROUP BY ALL),
        r AS (SELECT own.sample_id, a.model_id, 1 / (1 + exp(-(own.s + a.s + b.s + (SELECT value FROM c WHERE part = 'intercept')))) AS risk
              FROM own, m a, m b WHERE a.kind = '' AND b.kind = own.query_type AND a.model_id = b.model_id)
        SELECT count(*), count(*) FILTER (abs(r.risk - q.risk) > 1e-9) FROM r JOIN {read('risks')} q USING (sample_id, model_id)""").fetchall()[0]
    assert off == (risks.count(), 0)
    assert policy.route(vectors).count() == vectors.count()


def test_saved_policy_decides_the_same(spark, data):
    f, o = data
    policy = LN.MlpPolicy(D.MODEL_IDS, hidden=(8,), max_iter=5).fit(o, f)
    path = scratch_path(spark, "policy")
    policy.save(path)
    assert LN.MlpPolicy.load(spark, path).route(f).exceptAll(policy.route(f)).count() == 0


def test_user_policy(spark, data):
    f, o = data
    policy = LN.ConstantPolicy().fit(o)
    path = scratch_path(spark, "constant")
    policy.save(path)
    assert LN.ConstantPolicy.load(spark, path).route(f).select("model_id").distinct().count() == 1
    assert policy.name() == "ConstantPolicy"
    with pytest.raises(NotImplementedError):
        LN.Policy().route(f)


def test_model_never_correct(spark, data):
    """A model without one correct answer has no head and is never chosen."""
    f, o = data
    o = o.withColumn("quality", F.when(F.col("model_id") == "m7", 0).otherwise(F.col("quality")))
    policy = LN.OneVsRestPolicy(D.MODEL_IDS).fit(o, f)
    assert policy.heads.filter("model_id = 'm7' AND dim = -1 AND value = double('-infinity')").count() == 1
    assert policy.route(f).filter("model_id = 'm7'").count() == 0


def small_design(spark, seed=3, n=300, d=4, k=3, parts=70):
    """Random rows with missing labels, over more parts than the driver adds up by itself."""
    rng = np.random.default_rng(seed)
    x, kind = rng.normal(size=(n, d)), rng.integers(-1, 3, n)
    y = np.where(rng.random((n, k)) < 0.1, np.nan, (rng.random((n, k)) < 1 / (1 + np.exp(-x[:, :1] + 0.3 * kind[:, None]))).astype(float))
    w = np.stack([np.ones(n), rng.integers(0, 3, n).astype(float)], axis=1)
    rows = [(str(i), int(kind[i]), x[i].tolist(), y[i].tolist(), w[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, kind int, x array<double>, y array<double>, w array<double>").repartition(parts), x, kind, y, w


def gradient(fit, model, x, kind, y, w, reg):
    """Slope of the penalised mean loss by the model's numbers, pair by pair."""
    z = (x * (1 if fit.columns is None else fit.columns)) @ model.sample
    offsets = model.offsets(fit.profiles)
    cells = fit.cells().reshape(offsets.shape[0], offsets.shape[1], -1)
    out, total = np.zeros(x.shape[1] + 1 + cells.shape[2]), 0.0
    for i in range(len(x)):
        for m in range(y.shape[1]):
            weight = w[i] * (1 if fit.models is None else fit.models[m])
            if np.isnan(y[i, m]) or not weight:
                continue
            p = 1 / (1 + np.exp(-(z[i] + offsets[kind[i], m])))
            slope = (p - y[i, m]) * (1 + 2 * fit.brier * p * (1 - p)) * weight
            total += weight
            out += slope * np.concatenate([x[i] * (1 if fit.columns is None else fit.columns), [1.0], cells[kind[i], m]])
    return out / total + reg * np.concatenate([model.sample, [0.0], model.model])


def test_fits_are_stationary(spark):
    """Several fits of one pass: weights, hidden columns, hidden models, one type for all, a squared error."""
    table, x, kind, y, w = small_design(spark)
    profiles = np.random.default_rng(1).normal(size=(3, 2))
    fits = [BF.RiskFit(profiles), BF.RiskFit(profiles, columns=np.array([1, 0, 1, 1]), brier=0.3),
            BF.RiskFit(profiles, models=np.array([1, 1, 0]), by_type=False)]
    table = table.withColumn("w", F.array(F.col("w")[0], F.col("w")[1], F.col("w")[1]))
    weights = [w[:, 0], w[:, 1], w[:, 1]]
    models = BF.fit_risks(table, fits, reg=0.01)
    for fit, model, weight in zip(fits, models, weights):
        assert np.abs(gradient(fit, model, x, kind, y, weight, 0.01)).max() < 1e-8
    assert models[1].sample[1] == 0
    again = BF.fitted_models(BF.coefficients(spark, models))
    for a, b in zip(models, again):
        assert (a.sample == b.sample).all() and (a.model == b.model).all() and (a.intercept, a.by_type) == (b.intercept, b.by_type)


def test_heads_without_both_labels(spark):
    rows = [(str(i), -1, [float(i % 3), 1.0], [1.0, 0.0, float(i % 2)], [1.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "sample_id string, kind int, x array<double>, y array<double>, w array<double>")
    heads, _ = BF.fit_heads(table)
    assert heads[0][-1] == np.inf and heads[1][-1] == -np.inf and np.isfinite(heads[2]).all()
    with pytest.raises(ValueError):
        BF.fit_heads(table.limit(0))


def test_sweep_choices_equal_brute_force(spark, data):
    """Seeds differ, choices follow risk plus weighted cost over the models with an outcome, spread follows the seeds."""
    f, o = data
    o = o.filter("NOT (model_id = 'm3' AND cast(sample_id AS bigint) % 5 = 0)")
    vectors = feature_vectors(spark, SF).join(f.select("sample_id"), "sample_id", "left_semi")
    m = D.meta(spark, SF).join(f.select("sample_id"), "sample_id", "left_semi")
    bounds = C.cost_bounds(o)
    profiles = FT.model_profiles(o, typed(spark, SF))
    sweep = RR.learned_sweep(vectors, o, m.filter("split = 'train'"), m.filter("split = 'test'"), profiles, bounds, [0.0, 0.5], [1, 2, 3])
    rows = sweep.choices.collect()
    assert len(rows) == 3 * 2 * m.filter("split = 'test'").count()
    low, high = bounds.first()["cmin"], bounds.first()["cmax"]
    cells = {(r["sample_id"], r["model_id"]): r for r in o.collect()}
    z = {r["sample_id"]: r["z"] for r in BF.risk_scores(FT.standardize(vectors, "vec", sweep.scaler), [
        (sweep.fitted[s], sweep.profiles) for s in (1, 2, 3)], sweep.models).collect()}
    for r in rows:
        best = min(((1 / (1 + np.exp(-x)) + r["lambda_cost"] * min(max((cells[r["sample_id"], name]["cost"] - low) / (high - low), 0), 1), name)
                    for x, name in zip(z[r["sample_id"]][r["seed"] - 1], sweep.models) if (r["sample_id"], name) in cells))
        assert r["model_id"] == best[1] and abs(r["route_score"] - best[0]) < 1e-12
    scores = RR.seed_scores(sweep.choices, bounds).collect()
    spread = {r["lambda_cost"]: r for r in RR.seed_spread(RR.seed_scores(sweep.choices, bounds)).collect()}
    for lam in (0.0, 0.5):
        a = [r["accuracy"] for r in scores if r["lambda_cost"] == lam]
        assert len(a) == spread[lam]["seeds"] == 3
        assert abs(spread[lam]["accuracy_mean"] - np.mean(a)) < 1e-12 and abs(spread[lam]["accuracy_std"] - np.std(a)) < 1e-12
    assert len({round(r["avg_risk"], 9) for r in scores if r["lambda_cost"] == 0.0}) == 3
    assert spread[0.5]["avg_cost_mean"] <= spread[0.0]["avg_cost_mean"]


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(20_000).select(RR.poisson_weight(F.col("id").cast("string"), 7).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_000 for r in w}
    assert abs(share[0.0] - np.exp(-1)) < 0.02 and abs(sum(k * v for k, v in share.items()) - 1) < 0.03


@pytest.mark.parametrize("mode,seen", [("full", 76), ("no_query_type", 69), ("no_extra_features", 75), ("sample_difficulty_only", 12),
                                       ("random_extra_features", 76)])
def test_ablations_hide_columns(mode, seen):
    columns = RR.feature_columns(mode, 32, 32, 1)
    assert len(columns) == 77 and columns.sum() == seen and columns[-1] == (mode == "random_extra_features")


def test_perceptron_rows_reach_every_core(spark, tmp_path, monkeypatch):
    """A training table of one file, all of whose rows would come in one piece, is dealt before the fit passes over it."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    seen, fit = [], MultilayerPerceptronClassifier.fit

    def watched(self, table, *rest):
        seen.append(table.groupBy(F.spark_partition_id()).count().count())
        return fit(self, table, *rest)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", watched)
    ids = spark.range(400, numPartitions=1).select(F.col("id").cast("string").alias("sample_id"))
    ids.select("sample_id", F.array(F.randn(1), F.randn(2)).alias("vec")).coalesce(1).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    o = ids.select("sample_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id")).withColumn(
        "quality", F.pmod(F.xxhash64("sample_id", "model_id"), F.lit(2)).cast("int")).withColumn("cost", F.lit(1.0))
    decided = LN.MlpPolicy(["a", "b"], hidden=(4,), max_iter=3).fit(o, f).route(f)
    assert decided.count() == 400 and seen == [spark.sparkContext.defaultParallelism]
