"""Window functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard.operators import calibration as K
from routeyard.operators import costs as C
from routeyard.operators import evaluate as E
from routeyard.operators import experiments as X
from routeyard.operators import integrity as I
from routeyard.operators import labels as L
from routeyard.operators import prefix as PX
from routeyard.operators import registry as G
from routeyard.plans.catalog import query, round_columns
from routeyard.plans.catalog.aggregates import (BOUNDS_SQL, BY_DATASET_SQL, CHOSEN_SQL, PAIRS_SQL,
                                               SCORE_COLS, TYPES_SQL, _SCORE, by_dataset, chosen, pairs,
                                               score_rounded, soft_sql, typed)
from routeyard.plans.catalog.joins import NEIGHBORS_SQL, neighbor_rows
from routeyard.runtime import scratch_path
from routeyard.streaming.incremental import read_cache, upsert_stream


def uneven(spark, sf):
    """Outcomes with equal costs, lost costs and infinite costs among them."""
    i, m = F.col("sample_id").cast("bigint"), F.col("model_id")
    cost = (F.when((i % 7 == 0), F.lit(0.001)).when((i % 7 == 1) & (m < "m4"), F.lit(None))
            .when((i % 7 == 2) & (m == "m0"), F.lit(float("inf")))
            .when(i % 7 == 3, F.lit(float("nan"))).otherwise(F.col("cost")))
    return D.outcomes(spark, sf).withColumn("cost", cost)


UNEVEN_SQL = """uneven AS (SELECT sample_id, model_id, quality, CASE WHEN sample_id::BIGINT % 7 = 0 THEN 0.001
    WHEN sample_id::BIGINT % 7 = 1 AND model_id < 'm4' THEN NULL
    WHEN sample_id::BIGINT % 7 = 2 AND model_id = 'm0' THEN 'inf'::DOUBLE
    WHEN sample_id::BIGINT % 7 = 3 THEN 'nan'::DOUBLE ELSE cost END AS cost FROM outcomes)"""


@query("w1_hard_labels", f""", {UNEVEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY
    CASE WHEN cost IS NULL OR isnan(cost) THEN 2 WHEN quality > 0 THEN 0 ELSE 1 END,
    CASE WHEN cost IS NULL OR isnan(cost) THEN 0 ELSE cost END, model_id) AS rn FROM uneven)
SELECT sample_id, model_id FROM r WHERE rn = 1""")
def w1(spark, sf):
    return L.hard_labels(uneven(spark, sf))


@query("w2_oracle_routing", f""", {UNEVEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY
    CASE WHEN cost IS NULL OR NOT isfinite(cost) THEN 2 WHEN quality > 0 THEN 0 ELSE 1 END,
    CASE WHEN cost IS NULL OR NOT isfinite(cost) THEN 0 ELSE cost END, model_id) AS rn FROM uneven)
SELECT sample_id, model_id, quality, round(CASE WHEN isfinite(cost) THEN cost END, 12) AS cost FROM r WHERE rn = 1""")
def w2(spark, sf):
    from routeyard.runtime import finite

    out = L.oracle_route(uneven(spark, sf))
    return out.withColumn("cost", F.round(F.when(finite("cost"), F.col("cost")), 12))


@query("w3_soft_targets", f""", {soft_sql(10.0)}, {soft_sql(1, "powered", weight="-2::DOUBLE * ln(100 * cost + 1e-12)")},
{soft_sql(1, "plain", weight="-3::DOUBLE * 1 * cost")}, free AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY sample_id)) AS f FROM plain_lw)
SELECT s.sample_id, s.model_id, round(s.target, 8) AS exp10, round(p.target, 8) AS power2, h.sample_id IS NOT NULL AS is_hard,
       round(CASE WHEN f.any_ok > 0 THEN n.target ELSE f.f / sum(f.f) OVER (PARTITION BY s.sample_id) END, 8) AS cost_soft
FROM soft s JOIN powered p USING (sample_id, model_id) JOIN plain n USING (sample_id, model_id) JOIN free f USING (sample_id, model_id)
LEFT JOIN (SELECT sample_id, model_id FROM plain_lw WHERE first) h USING (sample_id, model_id)""")
def w3(spark, sf):
    o = D.stored_outcomes(spark, sf)
    keys = ["sample_id", "model_id"]
    a = L.soft_targets(o, 10.0).withColumnRenamed("target", "exp10")
    b = L.soft_targets(o, 2.0, scheme="power").withColumnRenamed("target", "power2")
    c = L.soft_targets(o, 3.0, fallback="cost_soft", cost_scale=1.0).withColumnRenamed("target", "cost_soft")
    h = L.soft_targets(o, None).select(*keys, (F.col("target") == 1).alias("is_hard"))
    return round_columns(a.join(b, keys).join(c, keys).join(h, keys), 8, "exp10", "power2", "cost_soft")


@query("w4_softmax", f""", {PAIRS_SQL}, e AS (SELECT sample_id, model_id, p, exp(p) AS e FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, model_id) = 1 AS best FROM e)
SELECT sample_id, model_id, round(e / sum(e) OVER (PARTITION BY sample_id), 9) AS probability, best FROM r""")
def w4(spark, sf):
    p = pairs(spark, sf).select("sample_id", "model_id", "p")
    best = L.argmax(p, "p").withColumn("best", F.lit(True))
    out = L.softmax(p, "p").join(best, ["sample_id", "model_id"], "left")
    return out.select("sample_id", "model_id", F.round("probability", 9).alias("probability"),
                      F.coalesce("best", F.lit(False)).alias("best"))


@query("w5_tied_ranks", f""", {PAIRS_SQL}
SELECT p, count(*) AS n, sum(label) AS pos, min(r) AS rank FROM (SELECT p, label, rank() OVER (ORDER BY p)
       + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pairs) GROUP BY p""")
def w5(spark, sf):
    return K.tied_ranks(pairs(spark, sf))


@query("w6_running_accuracy", f", {CHOSEN_SQL} SELECT sample_id, risk, seen, round(a, 10) AS accuracy FROM run")
def w6(spark, sf):
    return round_columns(K.running_accuracy(chosen(spark, sf)).select("sample_id", "risk", "seen", "accuracy"),
                         10, "accuracy")


def points(spark, sf):
    """One point per model and one per (model, task): the runs of an imagined benchmark."""
    p = D.predictions(spark, sf).join(D.samples(spark, sf).select("sample_id", "task_type"), "sample_id")
    return p.groupBy(F.concat_ws("-", "model_id", "task_type").alias("router")).agg(
        F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("cost"), 10).alias("avg_cost"))


POINTS_SQL = """points AS (SELECT model_id || '-' || task_type AS router, round(avg(quality), 6) AS accuracy,
    round(avg(cost), 10) AS avg_cost FROM predictions JOIN samples USING (sample_id) GROUP BY 1)"""


@query("w7_pareto_frontier", f""", {POINTS_SQL} SELECT router, accuracy, avg_cost,
(accuracy > COALESCE(max(accuracy) OVER (ORDER BY avg_cost, -accuracy, router ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 '-inf'::DOUBLE) + 1e-12)::INT AS is_frontier FROM points""")
def w7(spark, sf):
    return K.pareto(points(spark, sf))


@query("w8_contrast_sets", f""", {soft_sql(10.0)}, t AS (SELECT sample_id, model_id, round(target, 9) AS target FROM soft),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY target DESC, model_id) AS up,
      row_number() OVER (PARTITION BY sample_id ORDER BY target, model_id) AS down FROM t)
SELECT sample_id, 'positive' AS side, up AS position, model_id FROM r WHERE up <= 3 UNION ALL
SELECT sample_id, 'negative', down, model_id FROM r WHERE down <= 2""")
def w8(spark, sf):
    t = L.soft_targets(D.outcomes(spark, sf), 10.0).withColumn("target", F.round("target", 9))
    return L.contrast_sets(t, 3, 2)


@query("w9_top_k_by_distance", f""", {NEIGHBORS_SQL}
SELECT query_id, min(distance) AS nearest, max(distance) AS farthest, count(*) AS k FROM neighbors GROUP BY query_id""")
def w9(spark, sf):
    return neighbor_rows(spark, sf).groupBy("query_id").agg(
        F.min("distance").alias("nearest"), F.max("distance").alias("farthest"), F.count(F.lit(1)).alias("k"))


@query("w10_hash_splits", "SELECT sample_id, split FROM meta")
def w10(spark, sf):
    return G.hash_splits(D.samples(spark, sf))


@query("w11_dense_indices", """
SELECT 'model' AS side, model_id AS id, row_number() OVER (ORDER BY model_id) - 1 AS idx
FROM (SELECT DISTINCT model_id FROM sparse_outcomes)
UNION ALL SELECT 'sample', id::VARCHAR, row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem)""")
def w11(spark, sf):
    models = G.dense_model_index(D.sparse_outcomes(spark, sf))
    keys = D.table(spark, sf, "lineitem").select("l_orderkey").distinct()
    samples = PX.row_numbers(keys, "l_orderkey", "idx")
    return models.select(F.lit("model").alias("side"), F.col("model_id").alias("id"),
                         F.col("model_idx").cast("bigint").alias("idx")).unionByName(
        samples.select(F.lit("sample").alias("side"), F.col("l_orderkey").cast("string").alias("id"), "idx"))


@query("t1_best_and_worst", f""", {BY_DATASET_SQL}
(SELECT *, 'top' AS place FROM by_dataset ORDER BY rank_score DESC, dataset LIMIT 10) UNION ALL
(SELECT *, 'bottom' AS place FROM by_dataset ORDER BY rank_score, dataset DESC LIMIT 10)""")
def t1(spark, sf):
    return E.best_and_worst(by_dataset(spark, sf))


def runs(spark, sf):
    """One test run per (model, task); runs of m0 never reported a rank score."""
    o = D.outcomes(spark, sf)
    d = o.join(D.samples(spark, sf).select("sample_id", "task_type"), "sample_id").withColumn(
        "run", F.concat_ws("-", "model_id", "task_type"))
    out = score_rounded(E.score(d, C.cost_bounds(o), ["run"]))
    return out.withColumn("rank_score", F.when(~F.startswith("run", F.lit("m0")), F.col("rank_score")))


RUNS_SQL = f"""{BOUNDS_SQL}, g AS (SELECT model_id || '-' || task_type AS run, {_SCORE} FROM outcomes
    JOIN samples USING (sample_id) GROUP BY 1),
scored AS (SELECT run, {SCORE_COLS} FROM g, bounds),
runs AS (SELECT * REPLACE (CASE WHEN NOT starts_with(run, 'm0') THEN rank_score END AS rank_score) FROM scored)"""


@query("t2_sweep_leaderboard", f""", {RUNS_SQL}
SELECT *, row_number() OVER (ORDER BY rank_score DESC NULLS LAST, run) = 1 AS is_best FROM runs""")
def t2(spark, sf):
    r = runs(spark, sf)
    best = E.best_run(r).select("run").scalar()
    return E.leaderboard(r).withColumn("is_best", F.col("run") == best)


@query("t3_requested_order", """
SELECT sample_id, dataset, CASE WHEN sample_id::BIGINT % 2 = 0 THEN 100000 - sample_id::BIGINT END AS pos FROM samples""")
def t3(spark, sf):
    i = F.col("sample_id").cast("bigint")
    order = D.samples(spark, sf).filter(i % 2 == 0).select("sample_id", (F.lit(100000) - i).alias("pos"))
    return G.ordered_as(D.samples(spark, sf).select("sample_id", "dataset"), order)


@query("u1_union_of_tables", """
SELECT 'doc' AS kind, doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL
SELECT 'conv', conv_id, NULL, turn FROM conversations UNION ALL SELECT 'item', item_id, NULL, NULL FROM benchmark""")
def u1(spark, sf):
    t = lambda n: D.table(spark, sf, n)
    return G.union_all([
        t("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang"),
        t("conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), "turn"),
        t("benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))])


@query("u2_upsert", """
SELECT o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new2' ELSE o_orderstatus END AS state FROM orders
WHERE o_orderkey % 4 <> 1 OR o_orderkey % 3 = 0""")
def u2(spark, sf):
    o = D.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string").alias("sample_id")
    cache = o.filter("o_orderkey % 4 <> 1").select(key, F.col("o_orderstatus").alias("state"))
    times = F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("seq")
    fresh = o.filter("o_orderkey % 3 = 0").select(key, times).withColumn("state", F.concat(F.lit("new"), "seq"))
    return G.upsert(cache, fresh, order=["seq"]).drop("seq")


@query("u2_streamed_upsert", """
SELECT o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new2' ELSE o_orderstatus END AS state FROM orders
WHERE o_orderkey % 4 <> 1 OR o_orderkey % 3 = 0""")
def u2_streamed(spark, sf):
    """The upsert of every new file of a folder into a cache of buckets: three deliveries, each followed by a run of the stream."""
    o = D.table(spark, sf, "orders")
    root = scratch_path(spark, "u2-stream")
    key, schema = F.col("o_orderkey").cast("string").alias("sample_id"), "sample_id string, state string"
    o.filter("o_orderkey % 4 <> 1").select(key, F.col("o_orderstatus").alias("state")).write.parquet(f"{root}/start")
    for seq in range(3):
        o.filter("o_orderkey % 3 = 0").select(key, F.lit(f"new{seq}").alias("state")).write.mode("append").parquet(f"{root}/in")
        upsert_stream(spark, f"{root}/in", schema, f"{root}/cache", f"{root}/progress", start=f"{root}/start",
                      buckets=16).awaitTermination()
    return read_cache(spark, f"{root}/cache", schema)


@query("u3_intersection", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT c_nationkey FROM customer")
def u3(spark, sf):
    return I.intersection(D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")),
                          D.table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("k")), "k")


@query("u4_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def u4(spark, sf):
    return I.difference(D.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")),
                        D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("u5_frontier_table", f""", {POINTS_SQL}, base AS (SELECT model_id AS router, round(avg(quality), 6) AS accuracy,
    round(avg(cost), 10) AS avg_cost FROM outcomes GROUP BY model_id),
front AS (SELECT * FROM (SELECT *, max(accuracy) OVER (ORDER BY avg_cost, -accuracy, router ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
          FROM base) WHERE accuracy > COALESCE(b, '-inf'::DOUBLE) + 1e-12),
allp AS (SELECT 'run' AS source, router, accuracy, avg_cost FROM points UNION ALL SELECT 'baseline', router, accuracy, avg_cost FROM front)
SELECT source, router, accuracy, avg_cost, (accuracy > COALESCE(max(accuracy) OVER (ORDER BY avg_cost, -accuracy, router
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) + 1e-12)::INT AS is_frontier FROM allp""")
def u5(spark, sf):
    base = D.outcomes(spark, sf).groupBy(F.col("model_id").alias("router")).agg(
        F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("cost"), 10).alias("avg_cost"))
    return K.frontier_table(points(spark, sf), K.frontier_points(base))


def _heldout_sql(held):
    return f"""SELECT sample_id, split FROM meta JOIN flags USING (sample_id)
    WHERE CASE split WHEN 'test' THEN {held} ELSE NOT {held} END"""


@query("u6_heldout_datasets", ", flags AS (SELECT sample_id, contains(dataset, 'src1') AS held FROM samples) "
       + _heldout_sql("held"))
def u6_datasets(spark, sf):
    return X.heldout_splits(D.meta(spark, sf), X.matches_dataset(F.col("dataset"), ["SRC1"]))


@query("u6_heldout_types", f", {TYPES_SQL}, flags AS (SELECT sample_id, query_type IN ('spatial', 'ocr') AS held FROM types) "
       + _heldout_sql("held"))
def u6_types(spark, sf):
    m = D.meta(spark, sf).join(typed(spark, sf), "sample_id")
    return X.heldout_splits(m, X.matches_type(F.col("query_type"), ["Spatial", "ocr"]))


@query("u6_heldout_fallbacks", """
SELECT 'nothing' AS matched, sample_id, split FROM meta UNION ALL
SELECT 'train only', sample_id, CASE WHEN split = 'train' THEN s ELSE split END FROM meta, (VALUES ('train'), ('test')) v(s)
WHERE (split = 'train') OR (split = 'dev' AND s = 'test')""")
def u6_fallbacks(spark, sf):
    """No match changes nothing; matching all of train keeps train and makes it the test side too."""
    m = D.meta(spark, sf)
    none = X.heldout_splits(m, X.matches_dataset(F.col("dataset"), ["absent"]))
    train = X.heldout_splits(m, F.col("split") == "train")
    return none.select(F.lit("nothing").alias("matched"), "sample_id", "split").unionByName(
        train.select(F.lit("train only").alias("matched"), "sample_id", "split"))


@query("u7_heldout_models", """
SELECT model_id, CASE WHEN model_id IN ('m2', 'm5') THEN 'heldout' ELSE 'train' END AS side, count(*) AS records
FROM outcomes GROUP BY ALL""")
def u7(spark, sf):
    train, held = X.model_split(D.MODEL_IDS, ["2", "M5"])
    side = F.when(F.col("model_id").isin(held), "heldout").otherwise("train")
    return D.outcomes(spark, sf).filter(F.col("model_id").isin(train + held)).groupBy("model_id", side.alias("side")).agg(
        F.count(F.lit(1)).alias("records"))


@query("u8_calibration_subset", f"""
SELECT sample_id FROM meta WHERE split = 'train' ORDER BY {D.bucket_sql("'7|' || sample_id")}, sample_id LIMIT 64""")
def u8(spark, sf):
    return X.calibration_subset(D.meta(spark, sf).filter("split = 'train'").select("sample_id"), 64, seed=7)
