"""Routing policies whose decisions SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.functions.vectors import fuse
from routeyard.operators import calibration as K
from routeyard.operators import costs as C
from routeyard.operators import experiments as X
from routeyard.operators import features as FT
from routeyard.operators import labels as L
from routeyard.operators import neighbors as NN
from routeyard.operators import policies as P
from routeyard.operators.registry import union_all
from routeyard.plans import reports as RP
from routeyard.runtime import persisted
from routeyard.plans.catalog import query, round_columns
from routeyard.plans.catalog.aggregates import (BOUNDS_SQL, PAIRS_SQL, PROFILE_COLS, SCORE_COLS, TYPES_SQL,
                                               _SCORE, fused, pairs, profile_columns, score_rounded, typed)

SPLIT_SQL = """train AS (SELECT o.* FROM outcomes o JOIN meta USING (sample_id) WHERE split = 'train'),
test AS (SELECT sample_id, dataset FROM meta WHERE split = 'test'),
model_means AS (SELECT model_id, avg(quality) AS a, avg(cost) AS c FROM train GROUP BY model_id),
champions AS (SELECT dataset, arg_min(model_id, row(-a, model_id)) AS model_id FROM
    (SELECT dataset, model_id, avg(quality) AS a FROM train JOIN meta USING (sample_id) GROUP BY ALL) GROUP BY dataset)"""
DECISIONS = {
    "strongest_global": "SELECT sample_id, (SELECT arg_min(model_id, row(-a, model_id)) FROM model_means) AS model_id FROM test",
    "cheapest_global": "SELECT sample_id, (SELECT arg_min(model_id, row(c, model_id)) FROM model_means) AS model_id FROM test",
    "strongest_per_dataset": "SELECT sample_id, COALESCE(model_id, (SELECT arg_min(model_id, dataset) FROM champions)) AS model_id FROM test LEFT JOIN champions USING (dataset)",
    "random": f"SELECT sample_id, ['m0', 'm1', 'm2', 'm3', 'm4', 'm5', 'm6', 'm7'][{D.bucket_sql('sample_id || ' + chr(39) + '|42' + chr(39))} % 8 + 1] AS model_id FROM test",
    "oracle": "SELECT sample_id, arg_min(model_id, row(-quality, cost, model_id)) AS model_id FROM outcomes JOIN test USING (sample_id) GROUP BY sample_id",
}


def _fit_and_test(spark, sf):
    m, o = D.meta(spark, sf), D.stored_outcomes(spark, sf)
    fit = o.join(m.filter("split = 'train'").select("sample_id"), "sample_id", "left_semi")
    return m, m.filter("split = 'test'"), fit, o


@query("r1_strongest_global", f", {SPLIT_SQL} {DECISIONS['strongest_global']}")
def r1(spark, sf):
    _, test, fit, _ = _fit_and_test(spark, sf)
    return P.strongest_global(test, fit)


@query("r2_cheapest_global", f", {SPLIT_SQL} {DECISIONS['cheapest_global']}")
def r2(spark, sf):
    _, test, fit, _ = _fit_and_test(spark, sf)
    return P.cheapest_global(test, fit)


@query("r3_strongest_per_dataset", f""", {SPLIT_SQL}, fewer AS (SELECT * FROM champions WHERE dataset <> 'src5')
SELECT sample_id, COALESCE(model_id, (SELECT arg_min(model_id, dataset) FROM fewer)) AS model_id FROM test LEFT JOIN fewer USING (dataset)""")
def r3(spark, sf):
    """One dataset is unseen in training."""
    m, test, fit, _ = _fit_and_test(spark, sf)
    seen = m.filter("dataset <> 'src5'")
    return P.strongest_per_dataset(test, fit, seen)


@query("r4_random", f", {SPLIT_SQL} {DECISIONS['random']}")
def r4(spark, sf):
    return P.random_route(D.meta(spark, sf).filter("split = 'test'"), D.MODEL_IDS)


@query("r5_oracle", "SELECT sample_id, arg_min(model_id, row(-quality, cost, model_id)) AS model_id FROM outcomes GROUP BY sample_id")
def r5(spark, sf):
    return P.oracle(D.outcomes(spark, sf))


KNN_SQL = """raw AS (SELECT sample_id, split, list_concat(list_transform(text_vec, lambda x: x / sqrt(list_dot_product(text_vec, text_vec))),
    list_transform(image_vec, lambda x: x / sqrt(list_dot_product(image_vec, image_vec)))) AS v FROM features JOIN meta USING (sample_id)),
known AS (SELECT sample_id FROM outcomes GROUP BY sample_id HAVING max(quality) > 0),
fit AS (SELECT sample_id, v FROM raw JOIN known USING (sample_id) WHERE split = 'train'),
dims AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM fit, range(1, 65) t(i) GROUP BY i),
packed AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM dims),
z0 AS (SELECT sample_id, split, list_transform(range(1, 65), lambda i: (v[i] - m[i]) / s[i]) AS z FROM raw, packed),
z AS (SELECT sample_id, split, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS z FROM z0),
dist AS (SELECT q.sample_id AS query_id, t.sample_id AS train_id, round(1 - list_dot_product(q.z, t.z), 9) AS distance
         FROM z q JOIN z t ON q.split <> 'train' AND t.sample_id IN (SELECT sample_id FROM fit)),
neighbors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM dist) WHERE rank <= 5)"""


def _knn_inputs(spark, sf):
    """Outcomes of the training samples, their fused vectors, and the vectors to route."""
    f = persisted(D.features(spark, sf).select(
        "sample_id", fuse(F.col("text_vec"), F.col("image_vec"), "normalize_concat").alias("vec")).join(
        D.meta(spark, sf).select("sample_id", "split"), "sample_id"), "vectors")
    train = f.filter("split = 'train'").select("sample_id")
    o = D.outcomes(spark, sf).join(train, "sample_id", "left_semi")
    return o, f.select("sample_id", "vec"), f.filter("split <> 'train'").select("sample_id", "vec")


@query("r6_knn", f""", {KNN_SQL}, label_rows AS (SELECT sample_id AS train_id, arg_min(model_id, row(-quality, cost, model_id)) AS model_id
    FROM outcomes GROUP BY sample_id),
votes AS (SELECT query_id, model_id, CASE WHEN min(distance) OVER (PARTITION BY query_id) = 0 THEN (distance = 0)::INT::DOUBLE
          ELSE 1 / distance END AS w FROM neighbors JOIN label_rows USING (train_id)),
shares AS (SELECT query_id AS sample_id, model_id, sum(w) / sum(sum(w)) OVER (PARTITION BY query_id) AS score FROM votes GROUP BY query_id, model_id)
SELECT sample_id, arg_min(model_id, row(-round(score, 7), model_id)) AS model_id, round(max(score), 7) AS share FROM shares GROUP BY sample_id""")
def r6(spark, sf):
    o, f, queries = _knn_inputs(spark, sf)
    shares = round_columns(P.KnnPolicy(k=5).fit(o, f).scores(queries), 7, "score")
    best = L.argmax(shares)
    return best.join(shares, ["sample_id", "model_id"]).select("sample_id", "model_id", F.col("score").alias("share"))


@query("r7_preference_knn", f""", {KNN_SQL},
wins AS (SELECT a.sample_id AS train_id, a.model_id, count(b.model_id) AS wins FROM outcomes a LEFT JOIN outcomes b
  ON a.sample_id = b.sample_id AND a.model_id <> b.model_id AND (a.quality > b.quality OR (a.quality = b.quality AND a.cost < b.cost)) GROUP BY ALL),
s AS (SELECT query_id AS sample_id, model_id, sum(wins / (1e-6 + distance)) AS score FROM neighbors JOIN wins USING (train_id) GROUP BY ALL),
e AS (SELECT *, exp(score / (SELECT greatest(max(score), 1) FROM s)) AS e FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 5) DESC, model_id) = 1 AS chosen FROM e)
SELECT sample_id, model_id, round(score, 4) AS score, round(e / sum(e) OVER (PARTITION BY sample_id), 7) AS probability, chosen FROM r""")
def r7(spark, sf):
    o, f, queries = _knn_inputs(spark, sf)
    policy = P.PreferenceKnnPolicy(k=5).fit(o, f)
    scores = persisted(policy.scores(queries), "scores")
    best = L.argmax(scores.withColumn("score", F.round("score", 5))).withColumn("chosen", F.lit(True))
    out = NN.preference_probabilities(scores).join(best, ["sample_id", "model_id"], "left")
    return out.select("sample_id", "model_id", F.round("score", 4).alias("score"), F.round("probability", 7).alias("probability"),
                      F.coalesce("chosen", F.lit(False)).alias("chosen"))


PROTOTYPE_SQL = """vecs AS (SELECT sample_id, list_concat(text_vec, image_vec) AS v FROM features),
ok AS (SELECT o.* FROM outcomes o JOIN (SELECT sample_id FROM outcomes GROUP BY sample_id HAVING max(quality) > 0) USING (sample_id)
       JOIN vecs USING (sample_id) JOIN meta USING (sample_id) WHERE split = 'train'),
fit AS (SELECT DISTINCT sample_id, v FROM ok JOIN vecs USING (sample_id)),
dims AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM fit, range(1, 65) t(i) GROUP BY i),
packed AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM dims),
z0 AS (SELECT sample_id, list_transform(range(1, 65), lambda i: (v[i] - m[i]) / s[i]) AS z FROM vecs, packed),
z AS (SELECT sample_id, list_transform(z, lambda x: x / greatest(sqrt(list_dot_product(z, z)), 1e-12)) AS z FROM z0),
p0 AS (SELECT model_id, i, avg(z[i]) AS x FROM ok JOIN z USING (sample_id), range(1, 65) t(i) WHERE quality > 0 GROUP BY ALL),
p1 AS (SELECT model_id, list(x ORDER BY i) AS p FROM p0 GROUP BY model_id),
p AS (SELECT model_id, list_transform(p, lambda x: x / greatest(sqrt(list_dot_product(p, p)), 1e-12)) AS p FROM p1),
s AS (SELECT sample_id, model_id, list_dot_product(z, p) AS score FROM z, p)"""


@query("r9_prototype_routing", f""", {PROTOTYPE_SQL}
SELECT sample_id, model_id, round(exp(score) / sum(exp(score)) OVER (PARTITION BY sample_id), 8) AS probability,
  row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 10) DESC, model_id) = 1 AS chosen FROM s""")
def r9(spark, sf):
    f = persisted(fused(spark, sf), "vectors")
    train = D.meta(spark, sf).filter("split = 'train'").select("sample_id").join(f.select("sample_id"), "sample_id")
    o = D.outcomes(spark, sf).join(train, "sample_id", "left_semi")
    policy = P.PrototypePolicy(D.MODEL_IDS).fit(o, f)
    scores = policy.scores(f)
    best = L.argmax(scores.withColumn("score", F.round("score", 10))).withColumn("chosen", F.lit(True))
    out = L.softmax(scores).join(best, ["sample_id", "model_id"], "left")
    return out.select("sample_id", "model_id", F.round("probability", 8).alias("probability"),
                      F.coalesce("chosen", F.lit(False)).alias("chosen"))


def profile_sql(outcomes, name):
    parts = ", ".join(f"COALESCE(avg(quality) FILTER (query_type = '{q}'), avg(quality)), "
                      f"COALESCE(avg(cost) FILTER (query_type = '{q}'), avg(cost))" for q in V.QUERY_TYPES)
    return f"""{name} AS (SELECT model_id, [avg(quality), avg(cost), stddev_pop(cost), {parts}] AS profile
        FROM {outcomes} JOIN types USING (sample_id) GROUP BY model_id)"""


@query("r13_heldout_profiles", f""", {TYPES_SQL}, calib AS (SELECT sample_id FROM samples ORDER BY {D.bucket_sql("'42|' || sample_id")}, sample_id LIMIT 100),
few AS (SELECT * FROM outcomes WHERE sample_id IN (SELECT sample_id FROM calib)),
{profile_sql("outcomes", "full_profiles")}, {profile_sql("few", "few_profiles")},
seen AS (SELECT * FROM full_profiles WHERE model_id NOT IN ('m2', 'm6')),
long AS (SELECT i, avg(profile[i]) AS x FROM seen, range(1, 18) t(i) GROUP BY i),
profiles AS (SELECT 'calibrated' AS how, * FROM seen UNION ALL SELECT 'calibrated', * FROM few_profiles WHERE model_id IN ('m2', 'm6')
  UNION ALL SELECT 'mean', * FROM seen UNION ALL SELECT 'mean', model_id, (SELECT list(x ORDER BY i) FROM long) FROM models WHERE model_id IN ('m2', 'm6'))
SELECT how, model_id, {PROFILE_COLS} FROM profiles""")
def r13(spark, sf):
    o, t = D.stored_outcomes(spark, sf), persisted(typed(spark, sf), "types")
    seen, held = X.model_split(D.MODEL_IDS, ["m2", "m6"])
    calib = X.calibration_subset(D.samples(spark, sf).select("sample_id"), 100)
    one = FT.heldout_profiles(o, t, seen, held, calib)
    two = FT.heldout_profiles(o, t, seen, held)
    tag = lambda df, how: profile_columns(df).withColumn("how", F.lit(how))
    return tag(one, "calibrated").unionByName(tag(two, "mean"))


LAMBDAS = [0.0, 0.25, 1.0, 4.0]
SWEEP_SQL = f"""{PAIRS_SQL}, {BOUNDS_SQL}, lam(lambda_cost) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in LAMBDAS)}),
unit AS (SELECT sample_id, model_id, p AS risk, quality, cost, least(greatest((cost - cmin) / (cmax - cmin), 0), 1) AS u
         FROM pairs JOIN outcomes USING (sample_id, model_id), bounds),
scored AS (SELECT *, risk + lambda_cost * u AS route_score FROM unit, lam),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lambda_cost, sample_id ORDER BY route_score, model_id) AS rn FROM scored) WHERE rn = 1)"""


def sweep(spark, sf):
    o = D.stored_outcomes(spark, sf)
    b = C.cost_bounds(o)
    risks = pairs(spark, sf, o).select("sample_id", "model_id", F.col("p").alias("risk"))
    return RP.sweep_predictions(risks, o, b.select("cmin").scalar(), b.select("cmax").scalar(), LAMBDAS), o, b


@query("r15_lambda_sweep_predictions", f""", {SWEEP_SQL}
SELECT lambda_cost, sample_id, model_id, quality, round(risk, 9) AS risk, round(u, 9) AS normalized_cost, round(route_score, 9) AS route_score FROM picked""")
def r15_predictions(spark, sf):
    out, _, _ = sweep(spark, sf)
    return round_columns(out.drop("cost"), 9, "risk", "normalized_cost", "route_score")


@query("r15_lambda_sweep_summary", f""", {SWEEP_SQL}, g AS (SELECT lambda_cost, {_SCORE} FROM picked GROUP BY lambda_cost),
o AS (SELECT avg(q) AS oa FROM (SELECT max(quality) AS q FROM outcomes GROUP BY sample_id)),
s AS (SELECT lambda_cost, {SCORE_COLS}, round(oa - accuracy, 8) AS oracle_gap FROM g, bounds, o)
SELECT *, (accuracy > COALESCE(max(accuracy) OVER (ORDER BY avg_cost, -accuracy, lambda_cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  '-inf'::DOUBLE) + 1e-12)::INT AS is_frontier FROM s""")
def r15_summary(spark, sf):
    out, o, b = sweep(spark, sf)
    s = round_columns(score_rounded(RP.sweep_summary(out, o, b)), 8, "oracle_gap")
    return K.pareto(s).drop("router")


@query("r16_ablations", f""", {TYPES_SQL}, {profile_sql("outcomes", "full_profiles")}
SELECT mode, model_id, CASE mode WHEN 'no_model_profile' THEN 1 WHEN 'no_query_type' THEN 3 ELSE 17 END::BIGINT AS profile_dim,
  CASE mode WHEN 'sample_difficulty_only' THEN 12 WHEN 'no_query_type' THEN 69 WHEN 'no_extra_features' THEN 75 ELSE 76 END::BIGINT AS sample_dim,
  round(CASE mode WHEN 'no_model_profile' THEN 1 WHEN 'no_query_type' THEN list_sum(profile[1:3])
    WHEN 'no_cost' THEN list_sum(list_transform(range(1, 18), lambda i: CASE WHEN i = 1 OR (i > 3 AND i % 2 = 0) THEN profile[i] ELSE 0 END))
    ELSE list_sum(profile) END, 8) AS profile_total
FROM full_profiles, (SELECT unnest({list(V.ABLATIONS)!r}) AS mode)""")
def r16(spark, sf):
    """The shape and content of the features under every ablation."""
    from routeyard.plans.catalog.scalars import feature_vectors

    o, t = D.stored_outcomes(spark, sf), persisted(typed(spark, sf), "types")
    dims, profiles, parts = {}, {}, []
    for mode in V.ABLATIONS:
        sample, profile = (tuple(x.items()) for x in FT.ablation_switches(mode))
        if sample not in dims:
            dims[sample] = feature_vectors(spark, sf, mode).agg(F.max(F.size("vec")).alias("d")).scalar()
        if profile not in profiles:
            profiles[profile] = FT.model_profiles(o, t, **dict(profile))
        parts.append(profiles[profile].select(
            F.lit(mode).alias("mode"), "model_id", F.size("profile").cast("bigint").alias("profile_dim"),
            dims[sample].cast("bigint").alias("sample_dim"),
            F.round(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x), 8).alias("profile_total")))
    return union_all(parts)


@query("r17_baseline_report", f", {SPLIT_SQL}, {BOUNDS_SQL}, decisions AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS router, sample_id, model_id FROM ({s})" for n, s in DECISIONS.items()) + f"""),
g AS (SELECT router, dataset, {_SCORE} FROM decisions JOIN test USING (sample_id) LEFT JOIN outcomes USING (sample_id, model_id)
      GROUP BY GROUPING SETS ((router), (router, dataset)))
SELECT router, dataset, {SCORE_COLS} FROM g, bounds""")
def r17(spark, sf):
    return score_rounded(RP.baseline_report(D.meta(spark, sf), D.stored_outcomes(spark, sf), D.MODEL_IDS))


@query("r17_baseline_samples", f", {SPLIT_SQL}, decisions AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS router, sample_id, model_id FROM ({s})" for n, s in DECISIONS.items()) + """)
SELECT router, sample_id, dataset, substr(model_id, 2)::INT AS pred_model_idx, model_id AS pred_model, quality AS correct,
       round(cost, 12) AS cost FROM decisions JOIN test USING (sample_id) JOIN outcomes USING (sample_id, model_id)""")
def r17_samples(spark, sf):
    out = RP.baseline_samples(D.meta(spark, sf), D.stored_outcomes(spark, sf), D.MODEL_IDS)
    return round_columns(out, 12, "cost")


@query("r18_run_report", f", {SPLIT_SQL}, {BOUNDS_SQL}, " + f"""
choice AS (SELECT sample_id, ['m0', 'm1', 'm2', 'm3', 'm4', 'm5', 'm6', 'm7'][{D.bucket_sql("sample_id || '|7'")} % 8 + 1] AS model_id FROM samples),
g AS (SELECT split, dataset, {_SCORE} FROM choice JOIN meta USING (sample_id) LEFT JOIN outcomes USING (sample_id, model_id)
      GROUP BY GROUPING SETS ((split), (split, dataset)))
SELECT split, dataset, {SCORE_COLS} FROM g, bounds""")
def r18(spark, sf):
    m = D.meta(spark, sf)
    return score_rounded(RP.run_report(P.random_route(m, D.MODEL_IDS, 7), m, D.stored_outcomes(spark, sf)))


@query("r18_fitted_report", f", {PROTOTYPE_SQL}, {BOUNDS_SQL}, " + f"""
choice AS (SELECT sample_id, arg_min(model_id, row(-round(score, 10), model_id)) AS model_id FROM s GROUP BY sample_id),
g AS (SELECT split, dataset, {_SCORE} FROM choice JOIN meta USING (sample_id) LEFT JOIN outcomes USING (sample_id, model_id)
      GROUP BY GROUPING SETS ((split), (split, dataset)))
SELECT split, dataset, {SCORE_COLS} FROM g, bounds""")
def r18_fitted(spark, sf):
    """A policy fitted on the training split, scored on every split."""
    m, o = D.meta(spark, sf), D.stored_outcomes(spark, sf)
    f = persisted(fused(spark, sf), "vectors")
    train = m.filter("split = 'train'").select("sample_id").join(f.select("sample_id"), "sample_id")
    policy = P.PrototypePolicy(D.MODEL_IDS).fit(o.join(train, "sample_id", "left_semi"), f)
    chosen = L.argmax(policy.scores(f).withColumn("score", F.round("score", 10)))
    return score_rounded(RP.run_report(chosen, m, o))
