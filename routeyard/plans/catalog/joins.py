"""Joins (J1-J18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.operators import assets as A
from routeyard.operators import calibration as K
from routeyard.operators import costs as C
from routeyard.operators import evaluate as E
from routeyard.operators import features as FT
from routeyard.operators import neighbors as NN
from routeyard.operators import policies as P
from routeyard.operators import registry as G
from routeyard.plans.catalog import query, round_columns, rounded
from routeyard.plans.catalog.sources import INPUT_SQL, input_tokens

PRICES = {m: (i, o) for m, i, o, _ in D.MODELS if m != "m7"}


def output_tokens(spark, sf):
    """Actual output tokens, for the pairs whose model number and sample id agree modulo 3."""
    p = D.predictions(spark, sf).withColumnRenamed("model_id", "model")
    known = F.substr("model", F.lit(2)).cast("int") % 3 == F.col("sample_id").cast("bigint") % 3
    return p.filter(known).select("sample_id", "model", "output_tokens")


def full_output(spark, sf):
    return C.output_token_table(D.samples(spark, sf), D.MODEL_IDS, output_tokens(spark, sf))


_EST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.OUTPUT_TOKEN_ESTIMATES.items())
OUTPUT_SQL = f"""actual AS (SELECT sample_id, model_id AS model, output_tokens FROM predictions
    WHERE substr(model_id, 2)::INT % 3 = sample_id::BIGINT % 3),
outputs AS (SELECT s.sample_id, m.model_id AS model,
    COALESCE(a.output_tokens, CASE task_type {_EST} ELSE {V.DEFAULT_OUTPUT_TOKENS} END)::BIGINT AS output_tokens,
    a.output_tokens IS NOT NULL AS is_actual
    FROM samples s CROSS JOIN models m LEFT JOIN actual a ON a.sample_id = s.sample_id AND a.model = m.model_id)"""

_STRICT_ROWS = "(SELECT * FROM models WHERE model_id <> 'm7')"
COSTS_SQL = f"""{INPUT_SQL}, {OUTPUT_SQL},
strict_costs AS (SELECT o.sample_id, o.model, total_input_tokens, output_tokens,
    total_input_tokens::DOUBLE / 1000000 * input_price AS input_cost,
    output_tokens::DOUBLE / 1000000 * output_price AS output_cost,
    total_input_tokens::DOUBLE / 1000000 * input_price + output_tokens::DOUBLE / 1000000 * output_price AS total_cost
    FROM outputs o JOIN inputs i USING (sample_id) JOIN {_STRICT_ROWS} p ON p.model_id = o.model)"""


def strict(spark, sf):
    return C.strict_costs(full_output(spark, sf), input_tokens(spark, sf), PRICES)


@query("j1_tokens_join", f", {INPUT_SQL}, {OUTPUT_SQL} "
       "SELECT o.sample_id, model, output_tokens, total_input_tokens FROM outputs o LEFT JOIN inputs i USING (sample_id)")
def j1(spark, sf):
    return C.with_input_tokens(full_output(spark, sf), input_tokens(spark, sf)).select(
        "sample_id", "model", "output_tokens", "total_input_tokens")


_COST_COLS = "round(input_cost, 12) AS input_cost, round(output_cost, 12) AS output_cost, round(total_cost, 12) AS total_cost"


@query("j2_strict_prices", f", {COSTS_SQL} "
       f"SELECT sample_id, model, total_input_tokens, output_tokens, {_COST_COLS} FROM strict_costs")
def j2(spark, sf):
    return round_columns(strict(spark, sf), 12, "input_cost", "output_cost", "total_cost")


_DEFAULT = D.values_sql([(m, *p) for m, p in V.DEFAULT_PRICES.items()])


@query("j3_lenient_prices", f""", {INPUT_SQL}, prices(model, ip, op) AS {_DEFAULT},
named AS (SELECT sample_id, output_tokens, CASE model_id WHEN 'm0' THEN 'SmolVLM2' WHEN 'm1' THEN 'Pixtral-12B'
          WHEN 'm2' THEN 'deepseek_vl2' ELSE model_id END AS model FROM predictions),
c AS (SELECT sample_id, model, total_input_tokens, output_tokens,
      total_input_tokens::DOUBLE / 1000000 * COALESCE(ip, 1)::DOUBLE AS input_cost,
      output_tokens::DOUBLE / 1000000 * COALESCE(op, 3)::DOUBLE AS output_cost
      FROM named LEFT JOIN inputs USING (sample_id) LEFT JOIN prices USING (model))
SELECT sample_id, model, total_input_tokens, output_tokens, round(input_cost, 12) AS input_cost,
       round(output_cost, 12) AS output_cost, round(input_cost + output_cost, 12) AS total_cost FROM c""")
def j3(spark, sf):
    m = F.col("model_id")
    out = D.predictions(spark, sf).select("sample_id", "output_tokens", F.when(m == "m0", "SmolVLM2").when(
        m == "m1", "Pixtral-12B").when(m == "m2", "deepseek_vl2").otherwise(m).alias("model"))
    return round_columns(C.lenient_costs(out, input_tokens(spark, sf)), 12, "input_cost", "output_cost", "total_cost")


@query("j4_embedding_join", """
SELECT f.sample_id, split, round(list_sum(text_vec), 8) AS t, round(list_sum(image_vec), 8) AS v
FROM features f JOIN meta m USING (sample_id)""")
def j4(spark, sf):
    f = D.features(spark, sf)
    text = f.select("sample_id", F.col("text_vec").alias("embedding_text"))
    image = f.select("sample_id", F.col("image_vec").alias("embedding_vision"))
    both = text.join(image, "sample_id").join(D.meta(spark, sf).select("sample_id", "split"), "sample_id")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 8)
    return both.select("sample_id", "split", total("embedding_text").alias("t"), total("embedding_vision").alias("v"))


@query("j5_registry_alignment", """
SELECT sample_id, split, quality, toxic FROM meta LEFT JOIN
(SELECT doc_id::VARCHAR AS sample_id, quality, toxic FROM labels) USING (sample_id)""")
def j5(spark, sf):
    lab = D.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string")).drop("doc_id")
    return G.align_to_registry(D.meta(spark, sf), lab).select("sample_id", "split", "quality", "toxic")


@query("j6_cost_alignment", """
, known AS (SELECT * FROM outcomes WHERE sample_id::BIGINT % 10 <> 3 AND NOT (sample_id::BIGINT % 10 = 4 AND model_id = 'm2')),
means AS (SELECT model_id, avg(cost) AS c FROM known GROUP BY model_id),
have AS (SELECT DISTINCT sample_id FROM known)
SELECT s.sample_id, m.model_id, h.sample_id IS NULL AS is_mean,
       round(CASE WHEN h.sample_id IS NULL THEN means.c ELSE k.cost END, 10) AS cost
FROM samples s CROSS JOIN models m LEFT JOIN known k ON k.sample_id = s.sample_id AND k.model_id = m.model_id
LEFT JOIN have h ON h.sample_id = s.sample_id LEFT JOIN means ON means.model_id = m.model_id""")
def j6(spark, sf):
    i = F.col("sample_id").cast("bigint") % 10
    known = D.outcomes(spark, sf).filter((i != 3) & ~((i == 4) & (F.col("model_id") == "m2")))
    return round_columns(G.align_costs(D.meta(spark, sf), known, D.MODEL_IDS), 10, "cost")


@query("j7_output_token_grid", f", {OUTPUT_SQL} SELECT * FROM outputs")
def j7(spark, sf):
    return full_output(spark, sf)


@query("j8_valid_samples", """
SELECT sample_id, model_id FROM sparse_outcomes WHERE sample_id IN (SELECT sample_id FROM samples)""")
def j8(spark, sf):
    return G.only_samples(D.sparse_outcomes(spark, sf), D.samples(spark, sf)).select("sample_id", "model_id")


@query("j9_missing_samples", """
SELECT sample_id FROM samples WHERE sample_id NOT IN (SELECT doc_id::VARCHAR FROM labels)""")
def j9(spark, sf):
    done = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return G.not_in(D.samples(spark, sf).select("sample_id"), done)


@query("j10_attach_samples", """
SELECT doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text,
       CASE WHEN doc_id % 3 = 0 THEN 0 ELSE [0, 1, 2, 1][doc_id % 4 + 1] END::BIGINT AS assets,
       doc_id % 3 <> 0 AS matched, doc_id::VARCHAR || '?' AS own_text FROM documents""")
def j10(spark, sf):
    s = D.samples_with_assets(spark, sf)
    meta = D.meta(spark, sf).select("sample_id", F.concat("sample_id", F.lit("?")).alias("question"))
    some = A.attach_samples(meta, s.filter(F.col("sample_id").cast("bigint") % 3 != 0))
    none = A.attach_samples(meta, s.withColumn("sample_id", F.concat(F.lit("x"), "sample_id"))).select(
        "sample_id", F.col("text").alias("own_text"))
    return some.join(none, "sample_id").select(
        "sample_id", "text", F.size("assets").cast("bigint").alias("assets"), "matched", "own_text")


@query("j11_reference_resolution", """
SELECT a.index, CASE WHEN length(a.image) <= 64 AND length(b.image) > 64 THEN b.image ELSE a.image END AS image
FROM asset_rows a LEFT JOIN asset_rows b ON a.image = b.index""")
def j11(spark, sf):
    return A.resolve_references(D.asset_rows(spark, sf))


@query("j12_asset_row_numbers", """
, keyed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'HallusionBench' WHEN 1 THEN 'MMMU_DEV_VAL' ELSE 'DocVQA_VAL' END AS dataset FROM documents),
rows AS (SELECT doc_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1 AS row_num FROM keyed)
SELECT dataset || '/' || CASE WHEN dataset = 'DocVQA_VAL' THEN '00' || doc_id WHEN dataset = 'MMMU_DEV_VAL' THEN 'id' || doc_id
       ELSE doc_id::VARCHAR END AS sample_id, dataset, row_num FROM rows""")
def j12(spark, sf):
    from routeyard.operators.prefix import row_numbers

    i = F.col("doc_id")
    ds = F.when(i % 3 == 0, "HallusionBench").when(i % 3 == 1, "MMMU_DEV_VAL").otherwise("DocVQA_VAL")
    rows = D.table(spark, sf, "documents").select(
        "doc_id", ds.alias("dataset"), i.cast("string").alias("index"), F.concat(F.lit("id"), i).alias("id"))
    rows = row_numbers(rows, "doc_id", groups=["dataset"])
    tail = F.when(F.col("dataset") == "DocVQA_VAL", F.concat(F.lit("00"), i)).when(
        F.col("dataset") == "MMMU_DEV_VAL", F.col("id")).otherwise(F.col("index"))
    return A.match_assets(rows.select(F.concat_ws("/", "dataset", tail).alias("sample_id"), "dataset"), rows)


@query("j13_extra_features", """
SELECT sample_id, COALESCE(quality, 0)::DOUBLE AS quality, COALESCE(toxic, 0)::DOUBLE AS toxic, 0::DOUBLE AS absent
FROM samples LEFT JOIN (SELECT doc_id::VARCHAR AS sample_id, quality, toxic FROM labels) USING (sample_id)""")
def j13(spark, sf):
    lab = D.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    return FT.attach_extras(D.samples(spark, sf).select("sample_id"), lab, ["quality", "toxic", "absent"])


RANDOM_SQL = f"""choice AS (SELECT sample_id,
    ['m0', 'm1', 'm2', 'm3', 'm4', 'm5', 'm6', 'm7'][{D.bucket_sql("sample_id || '|42'")} % 8 + 1] AS model_id FROM samples)"""


@query("j14_decision_gather", f""", {RANDOM_SQL}
SELECT sample_id, model_id, quality, round(cost, 12) AS cost FROM choice JOIN outcomes USING (sample_id, model_id)""")
def j14(spark, sf):
    d = P.random_route(D.samples(spark, sf), D.MODEL_IDS)
    return round_columns(E.gather(d, D.outcomes(spark, sf)), 12, "cost")


@query("j15_split_assignment", """
SELECT s.sample_id, CASE WHEN s.sample_id::BIGINT % 11 = 0 THEN 'unknown' ELSE dataset END AS dataset,
       CASE WHEN s.sample_id::BIGINT % 13 = 0 THEN 'unknown' WHEN s.sample_id::BIGINT % 5 = 0 THEN 'train' ELSE split END AS split,
       CASE WHEN s.sample_id::BIGINT % 11 = 0 THEN 'unknown' ELSE task END AS task FROM meta s""")
def j15(spark, sf):
    i = F.col("sample_id").cast("bigint")
    m = D.meta(spark, sf)
    lists = m.select("sample_id", "split").unionByName(
        m.filter(i % 5 == 0).select("sample_id", F.lit("train").alias("split"))).filter(i % 13 != 0)
    return G.assign_splits(D.outcomes(spark, sf), lists, D.samples(spark, sf).filter(i % 11 != 0))


@query("j16_train_alignment", """
SELECT sample_id, dataset, model_id, quality, len(text_vec) AS dim FROM meta JOIN features USING (sample_id, dataset)
JOIN outcomes USING (sample_id) WHERE split = 'train' AND model_id IN ('m1', 'm4', 'm7')""")
def j16(spark, sf):
    rows = G.aligned(D.meta(spark, sf), D.features(spark, sf), "train", D.outcomes(spark, sf), ["m1", "m4", "m7"])
    return rows.select("sample_id", "dataset", "model_id", "quality", F.size("text_vec").cast("bigint").alias("dim"))


@query("j17_frontier_match", """
, points AS (SELECT model_id AS router, avg(quality) AS accuracy, avg(cost) AS avg_cost FROM outcomes GROUP BY model_id),
mine AS (SELECT dataset AS router, avg(quality) AS accuracy, avg(cost) AS avg_cost FROM predictions
         GROUP BY dataset)
SELECT mine.router, round((SELECT max(p.accuracy) FROM points p WHERE p.avg_cost <= mine.avg_cost + 1e-12), 8) AS matched_cost_accuracy,
       round(((SELECT min(p.avg_cost) FROM points p WHERE p.accuracy >= mine.accuracy - 1e-12) - mine.avg_cost)
             / (SELECT min(p.avg_cost) FROM points p WHERE p.accuracy >= mine.accuracy - 1e-12), 8) AS matched_accuracy_cost_reduction
FROM mine""")
def j17(spark, sf):
    o, p = D.outcomes(spark, sf), D.predictions(spark, sf)
    point = [F.avg("quality").alias("accuracy"), F.avg("cost").alias("avg_cost")]
    models = o.groupBy(F.col("model_id").alias("router")).agg(*point)
    mine = p.groupBy(F.col("dataset").alias("router")).agg(*point)
    got = K.frontier_match(mine, K.frontier_points(models))
    return got.select("router", rounded("matched_cost_accuracy", 8), rounded("matched_accuracy_cost_reduction", 8))


NEIGHBORS_SQL = """vecs AS (SELECT sample_id, split, list_concat(text_vec, image_vec) AS v
          FROM features JOIN meta USING (sample_id)),
unit AS (SELECT sample_id, split, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM vecs),
dist AS (SELECT q.sample_id AS query_id, t.sample_id AS train_id, round(1 - list_dot_product(q.v, t.v), 9) AS distance
         FROM unit q JOIN unit t ON q.split <> 'train' AND t.split = 'train'),
neighbors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM dist)
              WHERE rank <= 5)"""


def neighbor_rows(spark, sf):
    f = D.features(spark, sf).select("sample_id", F.concat("text_vec", "image_vec").alias("vec"))
    m = f.join(D.meta(spark, sf).select("sample_id", "split"), "sample_id")
    return NN.nearest(m.filter("split <> 'train'"), m.filter("split = 'train'"), k=5)


@query("j18_nearest_neighbors", f""", {NEIGHBORS_SQL}
SELECT query_id, train_id, rank, distance FROM neighbors""")
def j18(spark, sf):
    return neighbor_rows(spark, sf)
