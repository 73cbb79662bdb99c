"""Iterative learners and pluggable parts; SQL cannot repeat them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.operators import block_fits as BF
from routeyard.operators import costs as C
from routeyard.operators import encoders as EN
from routeyard.operators import experiments as X
from routeyard.operators import features as FT
from routeyard.operators import labels as L
from routeyard.operators import learners as LN
from routeyard.operators import policies as P
from routeyard.operators import risk_runs as RR
from routeyard.operators.registry import union_all
from routeyard.plans.catalog import query
from routeyard.plans.catalog.aggregates import BOUNDS_SQL, TYPES_SQL, fused, soft_sql, typed
from routeyard.plans.catalog.policies import profile_sql
from routeyard.plans.catalog.scalars import FEATURE_VECTOR_SQL, feature_vectors
from routeyard.runtime import persisted, scratch_path


def _train_outcomes(spark, sf):
    train = D.meta(spark, sf).filter("split = 'train'").select("sample_id")
    have = D.features(spark, sf).select("sample_id")
    return persisted(D.outcomes(spark, sf).join(train.join(have, "sample_id"), "sample_id", "left_semi"), "history")


def _routed(spark, sf, policy):
    f = persisted(fused(spark, sf), "vectors")
    return policy.fit(_train_outcomes(spark, sf), f).route(f)


@query("r8_one_vs_rest")
def r8(spark, sf):
    return _routed(spark, sf, LN.OneVsRestPolicy(D.MODEL_IDS))


@query("r10_linear_hard")
def r10_hard(spark, sf):
    return _routed(spark, sf, LN.LinearPolicy(D.MODEL_IDS))


@query("r10_linear_soft")
def r10_soft(spark, sf):
    return _routed(spark, sf, LN.LinearPolicy(D.MODEL_IDS, lam=10.0))


@query("r11_mlp_hard")
def r11_hard(spark, sf):
    return _routed(spark, sf, LN.MlpPolicy(D.MODEL_IDS))


@query("r11_mlp_soft")
def r11_soft(spark, sf):
    return _routed(spark, sf, LN.MlpPolicy(D.MODEL_IDS, lam=10.0))


def _risk_policy(spark, sf, learner):
    o = _train_outcomes(spark, sf)
    vectors = persisted(feature_vectors(spark, sf), "vectors")
    profiles = FT.model_profiles(o, typed(spark, sf))
    return LN.RiskPolicy(learner).fit(o, vectors, profiles), vectors


@query("r12_pairwise_risk")
def r12(spark, sf):
    policy, vectors = _risk_policy(spark, sf, "logistic")
    return policy.risks(vectors)


@query("r12_pairwise_risk_trees")
def r12_trees(spark, sf):
    policy, vectors = _risk_policy(spark, sf, "gbt")
    return policy.risks(vectors)


# A logistic fit whose intercepts aren't penalised reproduces the mean of its targets, which SQL can compute.
TIGHT, CLOSE = 1e-9, 2e-3
OK_SQL = """train_ids AS (SELECT sample_id FROM meta JOIN features USING (sample_id) WHERE split = 'train'),
ok AS (SELECT o.* FROM outcomes o JOIN train_ids USING (sample_id)
       JOIN (SELECT sample_id FROM outcomes GROUP BY sample_id HAVING max(quality) > 0) USING (sample_id))"""


def _solvable_training(spark, sf):
    o = _train_outcomes(spark, sf)
    f = persisted(fused(spark, sf), "vectors")
    kept = persisted(L.solvable(o), "solvable")
    return o, f, kept, f.join(kept.select("sample_id").distinct(), "sample_id", "left_semi")


STANDARD_SQL = """fit_rows AS (SELECT DISTINCT sample_id, vec FROM ok JOIN vectors USING (sample_id)),
moments AS (SELECT i, avg(vec[i]) AS m, CASE WHEN stddev_pop(vec[i]) < FLOOR THEN 1 ELSE stddev_pop(vec[i]) END AS s
            FROM fit_rows, range(1, DIMS + 1) r(i) GROUP BY i),
z AS (SELECT sample_id, i - 1 AS dim, (vec[i] - m) / s AS x FROM fit_rows, moments UNION ALL SELECT sample_id, -1, 1 FROM fit_rows)"""


@query("r8_fit_moments", f""", {OK_SQL}, vectors AS (SELECT sample_id, list_concat(text_vec, image_vec) AS vec FROM features),
{STANDARD_SQL.replace('DIMS', '64').replace('FLOOR', '1e-12')},
heads AS (SELECT model_id FROM ok GROUP BY model_id HAVING min(quality) = 0 AND max(quality) > 0)
SELECT model_id, dim, round(avg(x) / 2, 6) + 0.0 AS moment FROM z JOIN ok USING (sample_id) JOIN heads USING (model_id)
WHERE quality > 0 GROUP BY ALL""")
def r8_moments(spark, sf):
    """What decides a balanced head: the mean of every feature times the probability, plus its penalty, is that of the labels.

    The fit minimises a strictly convex loss, so a head that meets all of its moments is the head.
    """
    o, f, kept, rows = _solvable_training(spark, sf)
    policy = LN.OneVsRestPolicy(D.MODEL_IDS).fit(o, f)
    z = FT.standardize(rows, "vec", policy.scaler).select("sample_id", F.concat(F.array(F.lit(1.0)), "vec").alias("x"))
    both = policy.scores(rows).join(kept.select("sample_id", "model_id", "quality"), ["sample_id", "model_id"]).join(z, "sample_id")
    weighted = F.transform("x", lambda x: x * F.col("score"))
    means = both.groupBy("model_id", (F.col("quality") > 0).alias("right")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(weighted))).alias("m"))
    halves = means.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("m").alias("m")).filter("n = 2")
    sums = halves.select("model_id", F.posexplode(F.zip_with(F.col("m")[0], F.col("m")[1], lambda a, b: (a + b) / 2)).alias("dim", "p"))
    penalty = F.when(F.col("dim") >= 0, policy.reg * F.col("value")).otherwise(0.0)
    return sums.withColumn("dim", F.col("dim") - 1).join(policy.heads, ["model_id", "dim"]).select(
        "model_id", F.col("dim").cast("bigint").alias("dim"), (F.round(F.col("p") + penalty, 6) + 0.0).alias("moment"))


@query("r10_fit_moments", f""", {OK_SQL}, {soft_sql(10.0)},
hard AS (SELECT arg_min(model_id, row(-quality, cost, model_id)) AS model_id FROM ok GROUP BY sample_id),
total AS (SELECT count(*) AS n FROM hard),
means AS (SELECT 'hard' AS kind, model_id, count(*) / (SELECT n FROM total) AS target FROM hard GROUP BY model_id
  UNION ALL SELECT 'soft', model_id, avg(target) FROM soft WHERE sample_id IN (SELECT sample_id FROM ok) GROUP BY model_id)
SELECT kind, model_id, round(target, 9) AS target, TRUE AS met FROM means WHERE target > 0""")
def r10_moments(spark, sf):
    """Every model's mean probability on the training rows is its mean target."""
    o, f, kept, rows = _solvable_training(spark, sf)
    parts = []
    for kind, lam in (("hard", None), ("soft", 10.0)):
        scores = LN.LinearPolicy(D.MODEL_IDS, lam=lam, max_iter=1000, tol=TIGHT).fit(o, f).scores(rows)
        both = scores.join(L.soft_targets(kept, lam), ["sample_id", "model_id"])
        parts.append(both.groupBy("model_id").agg(F.avg("target").alias("target"), F.avg("score").alias("p")).filter(
            "target > 0").select(F.lit(kind).alias("kind"), "model_id", F.round("target", 9).alias("target"),
                                 (F.abs(F.col("p") - F.col("target")) < CLOSE).alias("met")))
    return union_all(parts)


@query("r11_probabilities", f""", {OK_SQL}
SELECT count(*) AS samples, TRUE AS sums, TRUE AS better FROM features""")
def r11_probabilities(spark, sf):
    """A perceptron's probabilities add up to one, and it answers the training samples better than the cheapest model."""
    o, f, kept, rows = _solvable_training(spark, sf)
    policy = LN.MlpPolicy(D.MODEL_IDS).fit(o, f)
    scores = persisted(policy.scores(f), "scores")
    right = lambda d: d.join(kept, ["sample_id", "model_id"]).agg(F.avg("quality").alias("a")).scalar()
    sums = scores.groupBy("sample_id").agg(F.sum("score").alias("s"))
    return sums.agg(F.count(F.lit(1)).alias("samples"), F.every(F.abs(F.col("s") - 1) < 1e-9).alias("sums"),
                    (F.any_value(right(L.argmax(scores))) > F.any_value(right(P.cheapest_global(rows, o)))).alias("better"))


@query("r12_fit_moments", f""", {FEATURE_VECTOR_SQL},
train_ids AS (SELECT sample_id FROM meta JOIN features USING (sample_id) WHERE split = 'train'),
ok AS (SELECT o.* FROM outcomes o JOIN train_ids USING (sample_id)),
{STANDARD_SQL.replace('DIMS', '76').replace('FLOOR', '1e-6')}, {profile_sql("ok", "profiles")},
scales AS (SELECT i, avg(profile[i]) AS m, CASE WHEN stddev_pop(profile[i]) < 1e-6 THEN 1 ELSE stddev_pop(profile[i]) END AS s
           FROM profiles, range(1, 18) r(i) GROUP BY i),
scaled AS (SELECT model_id, i - 1 AS dim, (profile[i] - m) / s AS x FROM profiles, scales),
risk_cells AS (SELECT query_type, model_id, sum(1 - quality) / (SELECT count(*) FROM ok) AS y FROM ok JOIN types USING (sample_id) GROUP BY ALL),
rows_ AS (SELECT CASE dim WHEN -1 THEN 'intercept' ELSE 'sample' END AS part, '' AS kind, greatest(dim, 0) AS dim,
                 sum(x * (1 - quality)) / (SELECT count(*) FROM ok) AS moment FROM z JOIN ok USING (sample_id) GROUP BY dim
  UNION ALL SELECT 'model', '', dim, sum(x * y) FROM risk_cells JOIN scaled USING (model_id) GROUP BY dim
  UNION ALL SELECT 'model', query_type, dim, sum(x * y) FROM risk_cells JOIN scaled USING (model_id) GROUP BY ALL)
SELECT part, kind, dim, round(moment, 6) + 0.0 AS moment FROM rows_""")
def r12_moments(spark, sf):
    """The mean of everything the linear score multiplies times the risk, plus its penalty, is that of the failures."""
    o = _train_outcomes(spark, sf)
    vectors = persisted(feature_vectors(spark, sf), "vectors")
    policy = LN.RiskPolicy().fit(o, vectors, FT.model_profiles(o, typed(spark, sf)))
    both = persisted(policy.risks(vectors).join(o, ["sample_id", "model_id"]), "risks")
    total = both.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_sample = both.groupBy("sample_id").agg(F.sum("risk").alias("p")).join(
        FT.standardize(vectors, "vec", policy.sample_scaler), "sample_id")
    sums = lambda name: vector_to_array(Summarizer.sum(array_to_vector(F.transform(name, lambda x: x * F.col("p")))))
    of_sample = per_sample.withColumn("x", F.concat(F.array(F.lit(1.0)), "vec")).agg(sums("x").alias("m")).select(
        F.posexplode("m").alias("i", "m")).select(
        F.when(F.col("i") == 0, "intercept").otherwise("sample").alias("part"), F.lit("").alias("kind"),
        F.greatest(F.col("i") - 1, F.lit(0)).alias("dim"), "m")
    cells = both.join(vectors.select("sample_id", "query_type"), "sample_id").groupBy("query_type", "model_id").agg(
        F.sum("risk").alias("p")).join(FT.standardize(policy.profiles, "profile", policy.profile_scaler), "model_id")
    by_type = cells.groupBy("query_type").agg(sums("profile").alias("m")).select("query_type", F.posexplode("m").alias("dim", "m"))
    of_type = by_type.select(F.lit("model").alias("part"), F.col("query_type").alias("kind"), "dim", "m")
    of_model = by_type.groupBy("dim").agg(F.sum("m").alias("m")).select(F.lit("model").alias("part"), F.lit("").alias("kind"), "dim", "m")
    penalty = BF.coefficients(spark, [policy.model]).select("part", F.when(F.col("part") == "intercept", "").otherwise(F.col("kind")).alias("kind"),
        "dim", F.when(F.col("part") != "intercept", policy.reg * F.col("value")).otherwise(0.0).alias("penalty"))
    out = union_all([of_sample, of_type, of_model]).join(penalty, ["part", "kind", "dim"])
    return out.select("part", "kind", F.col("dim").cast("bigint").alias("dim"), (F.round(F.col("m") / total + F.col("penalty"), 6) + 0.0).alias("moment"))


SEEDS, SWEEP = (1, 2, 3, 4, 5), (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 1e12)


def _sweep(spark, sf):
    """Risk fitted per seed on the training split, judged on the test split."""
    m, o = D.meta(spark, sf), D.stored_outcomes(spark, sf)
    vectors = persisted(feature_vectors(spark, sf), "vectors")
    side = lambda name: m.filter(F.col("split") == name).select("sample_id").join(vectors.select("sample_id"), "sample_id")
    train = persisted(side("train"), "train")
    history = o.join(train, "sample_id", "left_semi")
    bounds = C.cost_bounds(o)
    profiles = FT.model_profiles(history, vectors.select("sample_id", "query_type"))
    return RR.learned_sweep(vectors, o, train, side("test"), profiles, bounds, list(SWEEP), list(SEEDS)), bounds


@query("r15_learned_sweep")
def r15_learned(spark, sf):
    """Mean and spread over the seeds of every score, per cost weight."""
    sweep, bounds = _sweep(spark, sf)
    return RR.seed_spread(RR.seed_scores(sweep.choices, bounds))


@query("r15_learned_limits", f""", {BOUNDS_SQL},
least AS (SELECT sample_id, min(least(greatest((cost - cmin) / (cmax - cmin), 0), 1)) AS u FROM outcomes JOIN meta USING (sample_id)
          JOIN features USING (sample_id), bounds WHERE split = 'test' GROUP BY sample_id)
SELECT seed, count(*) AS num_samples, round(avg(u), 9) AS avg_normalized_cost FROM least, (SELECT unnest({list(SEEDS)}) AS seed) GROUP BY seed""")
def r15_limits(spark, sf):
    """Where cost outweighs everything, every seed's choices cost the least that each sample allows."""
    sweep, bounds = _sweep(spark, sf)
    scores = RR.seed_scores(sweep.choices, bounds).filter(F.col("lambda_cost") == SWEEP[-1])
    return scores.select("seed", "num_samples", F.round("avg_normalized_cost", 9).alias("avg_normalized_cost"))


HELD_TYPE, HELD_DATASET, HELD_MODELS = "general", "src5", ("m2", "m6")
MODES = [m for m in V.ABLATIONS if m not in RR.WITHOUT_TERM]
RUNS = [*MODES, "heldout_type", "heldout_dataset", "heldout_model_mean", "heldout_model_calibrated"]


def _runs():
    held = {"heldout_type": X.matches_type(F.col("query_type"), [HELD_TYPE]), "heldout_dataset": X.matches_dataset(F.col("dataset"), [HELD_DATASET])}
    return [*[RR.Run(m, m) for m in MODES], *[RR.Run(name, held=c) for name, c in held.items()],
            RR.Run("heldout_model_mean", heldout_models=HELD_MODELS), RR.Run("heldout_model_calibrated", heldout_models=HELD_MODELS, calibration=100)]


def _fitted_runs(spark, sf):
    lab = D.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    rows = persisted(FT.attach_extras(D.features(spark, sf), lab, ["quality"]), "rows")
    drawn = FT.sample_features(rows, ["quality"], random_extras=True).select("sample_id", F.element_at("vec", -1).alias("drawn"))
    vectors = FT.sample_features(rows, ["quality"]).join(drawn, "sample_id").select(
        "sample_id", "query_type", F.concat("vec", F.array("drawn")).alias("vec"))
    o, runs = D.stored_outcomes(spark, sf), _runs()
    have = vectors.select("sample_id")
    fitted, scored = RR.fitted_runs(persisted(vectors, "vectors"), D.meta(spark, sf), o.join(have, "sample_id", "left_semi"), runs, 32, 32, 1)
    return fitted, scored, runs, C.cost_bounds(o)


@query("r16_ablation_scores")
def r16_scores(spark, sf):
    """Every ablation and every held-out experiment, fitted together and scored on its test samples."""
    _, scored, runs, bounds = _fitted_runs(spark, sf)
    return RR.run_scores(scored, runs, bounds)


@query("r16_fit_moments", f""", {TYPES_SQL}, known AS (SELECT m.sample_id, m.dataset, split, query_type FROM meta m JOIN features USING (sample_id) JOIN types USING (sample_id)),
runs AS (SELECT unnest({RUNS!r}) AS run),
pairs AS (SELECT run, quality FROM runs, known JOIN outcomes USING (sample_id) WHERE split = 'train'
  AND NOT (run = 'heldout_type' AND query_type = '{HELD_TYPE}') AND NOT (run = 'heldout_dataset' AND contains(dataset, '{HELD_DATASET}'))
  AND NOT (run LIKE 'heldout_model%' AND model_id IN {HELD_MODELS!r}))
SELECT run, count(*) AS pairs, round(avg(1 - quality), 6) AS moment FROM pairs GROUP BY run""")
def r16_moments(spark, sf):
    """A finished fit's mean risk, with the slope of its squared error, is the failure rate of the pairs it learns from."""
    _, scored, runs, _ = _fitted_runs(spark, sf)
    return RR.run_moments(scored, runs).select("run", "pairs", F.round("moment", 6).alias("moment"))


@query("r14_cluster_centres", """, t AS (SELECT sample_id FROM meta WHERE split = 'train' AND sample_id IN (SELECT sample_id FROM outcomes))
SELECT count(*) AS samples, TRUE AS nearest FROM t""")
def r14_centres(spark, sf):
    """Every training sample is nearest to the mean of its own cluster, but for what the fit's tolerance allows."""
    ids = D.meta(spark, sf).filter("split = 'train'").select("sample_id")
    scores = persisted(L.normalized_scores(D.outcomes(spark, sf)).join(ids, "sample_id", "left_semi"), "targets")
    placed = persisted(LN.behaviour_clusters(scores, D.MODEL_IDS), "clusters")
    cells = scores.join(placed, "sample_id")
    means = cells.groupBy("cluster", "model_id").agg(F.avg("target").alias("mean"))
    centres = means.groupBy("model_id").agg(F.collect_list(F.struct("cluster", "mean")).alias("centres"))    # clusters × models
    away = (cells.join(F.broadcast(centres), "model_id").select("sample_id", F.col("cluster").alias("own"), "target",
                                                                F.explode("centres").alias("c"))
            .groupBy("sample_id", "own", "c.cluster").agg(F.sum((F.col("target") - F.col("c.mean")) ** 2).alias("d")))
    own = F.sum(F.when(F.col("own") == F.col("cluster"), F.col("d")))
    per_sample = away.groupBy("sample_id").agg((own <= F.min("d") + 1e-2).alias("ok"))
    return per_sample.agg(F.count(F.lit(1)).alias("samples"), F.every("ok").alias("nearest"))


@query("r14_stored_centres", """, t AS (SELECT sample_id FROM meta WHERE split = 'train'),
share AS (SELECT sample_id, model_id, COALESCE(quality / nullif(sum(quality) OVER (PARTITION BY sample_id), 0), 0) AS target FROM outcomes)
SELECT model_id, count(*) AS samples, round(avg(target), 9) AS mean, 0::BIGINT AS away FROM share JOIN t USING (sample_id) GROUP BY model_id""")
def r14_stored(spark, sf):
    """Each stored centre is the mean of the samples nearest to it (``away`` counts those that aren't), so the centres
    weighted by their sizes give every model's mean."""
    ids = D.meta(spark, sf).filter("split = 'train'").select("sample_id")
    scores = persisted(L.normalized_scores(D.outcomes(spark, sf)).join(ids, "sample_id", "left_semi"), "targets")
    centres = LN.cluster_centres(scores, D.MODEL_IDS)
    placed = LN.nearest_centre(LN.behaviours(scores, D.MODEL_IDS), centres)
    own = F.array(*[F.lit(m) for m in D.MODEL_IDS])
    cells = placed.join(F.broadcast(centres), "cluster").select("cluster", F.explode(F.arrays_zip(                      # one row per cluster
        own.alias("model_id"), F.col("vec").alias("target"), F.col("centre").alias("centre"))).alias("x")).select("cluster", "x.*")
    per_cell = cells.groupBy("cluster", "model_id").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean"), F.first("centre").alias("centre"))
    wrong = F.when(F.abs(F.col("mean") - F.col("centre")) > 1e-9, F.col("n")).otherwise(0)
    return per_cell.groupBy("model_id").agg(F.sum("n").alias("samples"), F.round(F.sum(F.col("n") * F.col("centre")) / F.sum("n"), 9).alias("mean"),
                                            F.sum(wrong).alias("away"))


@query("r14_behaviour_clusters")
def r14(spark, sf):
    scores = L.normalized_scores(D.outcomes(spark, sf))
    in_split = lambda s: scores.join(D.meta(spark, sf).filter(F.col("split") == s).select("sample_id"), "sample_id", "left_semi")
    return LN.behaviour_clusters(in_split("train"), D.MODEL_IDS, assign=in_split("dev"))


@query("r19_text_vectors", f"""
, words AS (SELECT sample_id, unnest(list_filter(regexp_split_to_array(lower(prompt), '[^A-Za-z0-9]+'), lambda w: w <> '')) AS w FROM samples),
tf AS (SELECT sample_id, {D.bucket_sql("w")} % 128 AS i, count(*) AS n FROM words GROUP BY ALL),
idf AS (SELECT i, ln(((SELECT count(*) FROM samples) + 1) / (count(*) + 1)) AS x FROM tf GROUP BY i),
raw AS (SELECT sample_id, i, n * x AS x FROM tf JOIN idf USING (i)),
size AS (SELECT sample_id, sqrt(sum(x * x)) AS s FROM raw GROUP BY sample_id)
SELECT sample_id, i AS dim, round(x / s, 8) AS x FROM raw JOIN size USING (sample_id) WHERE abs(x / s) > 1e-7""")
def r19(spark, sf):
    """The components that aren't zero."""
    rows = EN.hashed_text_vectors(D.samples(spark, sf), 128)
    long = rows.select("sample_id", F.posexplode("embedding").alias("dim", "x")).filter(F.abs("x") > 1e-7)
    return long.select("sample_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 8).alias("x"))


@query("x1_user_policy", """
SELECT sample_id, (SELECT arg_min(model_id, row(-a, model_id)) FROM (SELECT model_id, avg(quality) AS a FROM outcomes GROUP BY model_id)) AS model_id FROM samples""")
def x1(spark, sf):
    return LN.ConstantPolicy().fit(D.outcomes(spark, sf)).route(D.samples(spark, sf))


@query("x2_saved_policy", """, pool(policy) AS (VALUES ('KnnPolicy'), ('LinearPolicy'), ('OneVsRestPolicy'), ('PreferenceKnnPolicy'), ('PrototypePolicy'))
SELECT policy, count(*) AS samples, 0::BIGINT AS differ FROM pool, features GROUP BY policy""")
def x2(spark, sf):
    """Fitted policies, saved, loaded and asked again: how many decisions differ."""
    f, o = persisted(fused(spark, sf), "vectors"), _train_outcomes(spark, sf)
    parts = []
    for policy in (P.KnnPolicy(), LN.LinearPolicy(D.MODEL_IDS), LN.OneVsRestPolicy(D.MODEL_IDS),
                   P.PreferenceKnnPolicy(), P.PrototypePolicy(D.MODEL_IDS)):
        path = scratch_path(spark, "x2")
        policy.fit(o, f).save(path)
        again = type(policy).load(spark, path).route(f).withColumnRenamed("model_id", "again")
        both = policy.route(f).join(again, "sample_id", "full")
        parts.append(both.agg(F.lit(policy.name()).alias("policy"), F.count(F.lit(1)).alias("samples"),
                              F.count_if(~F.col("model_id").eqNullSafe(F.col("again"))).alias("differ")))
    return union_all(parts)


@query("x2_saved_learners", """, pool(policy) AS (VALUES ('MlpPolicy'), ('RiskPolicy gbt'), ('RiskPolicy logistic'))
SELECT policy, count(*) AS samples, 0::BIGINT AS differ FROM pool, features GROUP BY policy""")
def x2_learners(spark, sf):
    """The same of the perceptron and of pairwise risk, which has features and profiles of its own."""
    f, o = persisted(fused(spark, sf), "vectors"), _train_outcomes(spark, sf)
    # the SQL counts the samples that have features
    vectors = persisted(feature_vectors(spark, sf).join(f.select("sample_id"), "sample_id", "left_semi"), "vectors")
    profiles = persisted(FT.model_profiles(o, typed(spark, sf)), "profiles")
    parts = []
    for name, policy, samples, meta in (("MlpPolicy", LN.MlpPolicy(D.MODEL_IDS), f, None),
                                        ("RiskPolicy gbt", LN.RiskPolicy("gbt"), vectors, profiles),
                                        ("RiskPolicy logistic", LN.RiskPolicy("logistic"), vectors, profiles)):
        path = scratch_path(spark, "x2")
        policy.fit(o, samples, meta).save(path)
        again = type(policy).load(spark, path).route(samples).withColumnRenamed("model_id", "again")
        both = policy.route(samples).join(again, "sample_id", "full")
        parts.append(both.agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("samples"),
                              F.count_if(~F.col("model_id").eqNullSafe(F.col("again"))).alias("differ")))
    return union_all(parts)


def _letter_shares():
    """A tiny encoder: how often each of five vowels occurs per character."""
    vowels = "aeiou"

    def run(texts):
        return np.array([[t.lower().count(v) / max(len(t), 1) for v in vowels] for t in texts])

    return run


_COUNT = ["(length(prompt) - length(replace(lower(prompt), '{0}', ''))) / greatest(length(prompt), 1)".format(v) for v in "aeiou"]


@query("x3_user_encoder", f"""
, v AS (SELECT sample_id, [{', '.join(_COUNT)}] AS v FROM samples)
SELECT sample_id, i - 1 AS dim, round(v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 8) AS x FROM v, range(1, 6) t(i)""")
def x3(spark, sf):
    s = D.samples(spark, sf).select("sample_id", EN.encode(F.col("prompt"), _letter_shares).alias("v"))
    return s.select("sample_id", F.posexplode("v").alias("dim", "x")).select(
        "sample_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 8).alias("x"))


@query("x3_encoded_conversations", f"""
, v AS (SELECT conv_id, turn, [{', '.join(c.replace('prompt', 'text') for c in _COUNT)}] AS v FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, i - 1 AS dim, round(v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 8) AS x FROM v, range(1, 6) t(i)""")
def x3_conversations(spark, sf):
    """Messages, many of which repeat: each different text is encoded once."""
    c = EN.encode_distinct(D.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", _letter_shares)
    return c.select("conv_id", "turn", F.posexplode("embedding").alias("dim", "x")).select(
        "conv_id", "turn", F.col("dim").cast("bigint").alias("dim"), F.round("x", 8).alias("x"))


def _ascii_words():
    import re

    pattern = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \n\t]")
    return lambda text: len(pattern.findall(text))


@query("x3_user_tokenizer", """
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0 ELSE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\n\\t]')) END::BIGINT AS tokens FROM conversations""")
def x3_tokens(spark, sf):
    c = D.table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 4 != 3, F.col("text"))
    return c.select("conv_id", "turn", EN.count_tokens(text, _ascii_words).alias("tokens"))
