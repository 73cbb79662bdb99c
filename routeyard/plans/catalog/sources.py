"""Sources and sinks: every sink is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixtures as D
from routeyard import fixed_values as V
from routeyard.operators import costs as C
from routeyard.operators import registry as G
from routeyard.plans.catalog import query, rounded
from routeyard.runtime import portions, scratch_path
from routeyard.sources import cache, config, reports, results, tables

_URIS = ("array_to_string(list_filter(list_transform(string_split(replace(COALESCE(image_path, ''), ',', ';'), ';'), "
         "lambda x: trim(x)), lambda x: x <> ''), '|')")


def _flat(df):
    return df.select("sample_id", "dataset", "task_type", F.array_join("modality", "+").alias("modality"),
                     "prompt", F.array_join(F.transform("assets", lambda a: a["uri"]), "|").alias("uris"))


@query("s1_sample_scan", f"""
SELECT sample_id, dataset, task_type, 'image+text' AS modality, prompt, {_URIS} AS uris FROM samples""")
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    tables.write_samples(D.samples_with_assets(spark, sf), path)
    return _flat(tables.read_samples(spark, f"{path}/*/*"))


@query("s2_tolerant_sample_scan", """
SELECT sample_id, dataset, CASE WHEN sample_id::BIGINT % 7 = 0 THEN 'revised' ELSE prompt END AS prompt
FROM samples""")
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    rows = D.samples_with_assets(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    i = F.col("sample_id").cast("bigint")
    extra = F.when(i % 5 == 0, F.lit('{"sample_id": "broken')).when(i % 5 == 1, F.lit("")).when(
        i % 5 == 2, F.lit('{"sample_id": " ", "prompt": "no id"}'))
    rows.select(F.explode(F.array_compact(F.array(line, extra))).alias("value")).write.text(f"{path}/a")
    (rows.filter(i % 7 == 0).withColumn("prompt", F.lit("revised"))
     .select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{path}/b"))
    return tables.read_samples_tolerant(spark, f"{path}/*").select("sample_id", "dataset", "prompt")


@query("s3_score_scan", "SELECT sample_id, model_id, quality AS quality_raw, quality::DOUBLE AS quality FROM predictions")
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    tables.write_scores(D.predictions(spark, sf), path)
    return tables.read_scores(spark, path).select("sample_id", "model_id", "quality_raw", "quality")


# layouts: models, suffix, format, id column, correctness column, prompt column, image column
_LAYOUTS = (
    (("m0", "m1"), "_openai_result.csv", "csv", "index", "hit", "question", None),
    (("m2", "m3"), "_auxmatch.json", "json", "id", "score", None, "img_path"),
    (("m4", "m5"), "_results.parquet", "parquet", "sample_id", "is_correct", "prompt", "image"),
    (("m6", "m7"), "_gpt-4o-mini_score.csv", "csv", "id", "score", "Question", None),
)


# six of the eight tables hold every text
_PACKED = {"csv": {"compression": "gzip", "zlib.compress.level": "FOUR"}, "json": {"compression": "gzip"},
           "parquet": {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}}


def _write_results(spark, sf, root):
    """One result table per model, in four column layouts; plus files that must be ignored."""
    preds = D.predictions(spark, sf).select("sample_id", "model_id", "quality")
    texts = D.samples(spark, sf).select("sample_id", "prompt", "image_path")
    cells = preds.groupBy("sample_id").agg(F.collect_list(F.struct("model_id", "quality")).alias("cells"))
    # texts are shuffled once, not once per model
    for stored in portions(texts.join(cells, "sample_id"), "answers"):
        for models, suffix, fmt, key, correct, prompt, image in _LAYOUTS:
            for m in models:
                mine = F.explode(F.filter("cells", lambda c: c["model_id"] == m))
                rows = stored.withColumn("cell", mine).withColumn("quality", F.col("cell.quality"))
                cols = [F.col("sample_id").alias(key), F.col("quality").alias(correct)]
                cols += [F.col("prompt").alias(prompt)] if prompt else []
                cols += [F.col("image_path").alias(image)] if image else []
                out = rows.select(*cols).write.mode("append").options(header=True, escape='"', **_PACKED[fmt])
                out.format(fmt).save(f"{root}/{fmt}-{key}/{m}/T20251025_G/{m}_DOCS{suffix}")
    wrong = preds.filter(F.col("model_id") == "m0").select(F.col("sample_id").alias("index"), F.lit(0).alias("hit"))
    wrong.write.option("header", True).csv(f"{root}/helper/m0/T20251025_G/m0_DOCS_acc.csv")
    found = [(f"{root}/{fmt}-{key}/*/*/*", "csv-quoted" if fmt == "csv" else fmt)
             for _, _, fmt, key, _, _, _ in _LAYOUTS]
    return [*found, (f"{root}/helper/*/*/*", "csv")]


@query("s4_result_tables", """
SELECT 'DOCS/' || sample_id AS sample_id, model_id, 'DOCS' AS dataset, quality,
       CASE WHEN model_id IN ('m0', 'm1') THEN 'MCQ' WHEN model_id IN ('m2', 'm3') THEN 'Y/N'
            WHEN model_id IN ('m4', 'm5') THEN 'VQA' ELSE 'Math' END AS kind,
       CASE WHEN model_id IN ('m2', 'm3') THEN '' ELSE prompt END AS prompt,
       CASE WHEN model_id IN ('m2', 'm3', 'm4', 'm5') THEN COALESCE(image_path, '') ELSE '' END AS image_path
FROM predictions JOIN samples USING (sample_id, dataset)""")
def s4(spark, sf):
    layouts = _write_results(spark, sf, scratch_path(spark, "s4"))
    return results.read_results(spark, layouts, D.MODEL_IDS).select(
        "sample_id", "model_id", "dataset", "quality", "kind", "prompt", "image_path")


@query("s5_prediction_tables", """
SELECT 'DOCS/' || conv_id || '-' || turn AS sample_id, 'm' || (conv_id % 8) AS model_id, 'DOCS' AS dataset,
       min(text) AS prediction, 1::DOUBLE AS is_correct FROM conversations GROUP BY conv_id, turn""")
def s5(spark, sf):
    root = scratch_path(spark, "s5")
    conv = D.table(spark, sf, "conversations")
    rows = conv.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("response"),
                       F.lit(1).alias("hit"), (F.col("conv_id") % 8).alias("m")).groupBy("id", "m", "hit").agg(
        F.min("response").alias("response"))
    for i, m in enumerate(D.MODEL_IDS):
        mine = rows.filter(F.col("m") == i).drop("m")
        mine.write.parquet(f"{root}/{m}/{m}_docs_openai_result.parquet")
        # the same answers again in a later file: the first file wins
        mine.withColumn("response", F.lit("later")).write.parquet(f"{root}/{m}/{m}_docs_result.parquet")
        mine.write.parquet(f"{root}/{m}/{m}_docs_score.parquet")
    return results.read_predictions(spark, [(f"{root}/*/*", "parquet")], D.MODEL_IDS)


@query("s6_asset_table_scan", "SELECT index, 'k' || index AS id, image FROM asset_rows")
def s6(spark, sf):
    path = scratch_path(spark, "s6")
    tables.write_asset_table(D.asset_rows(spark, sf).withColumn("id", F.concat(F.lit("k"), "index")), path)
    return tables.read_asset_table(spark, path, line_breaks=True)


@query("s7_split_lists", "SELECT sample_id, split FROM meta")
def s7(spark, sf):
    path = scratch_path(spark, "s7")
    m = D.meta(spark, sf)
    tables.write_splits(m.filter("split <> 'dev'"), path)
    # older lists call the column `id`
    m.filter("split = 'dev'").select(F.col("sample_id").alias("id")).write.json(f"{path}/split=dev")
    return tables.read_splits(spark, path)


@query("s8_split_fallbacks", """
SELECT 'lists' AS source, sample_id, split FROM meta UNION ALL
SELECT 'legacy', sample_id, split FROM meta UNION ALL SELECT 'none', sample_id, 'train' FROM meta""")
def s8(spark, sf):
    path = scratch_path(spark, "s8")
    m = D.meta(spark, sf)
    tables.write_splits(m, f"{path}/lists")
    # objects of at most 1000 ids each
    (m.groupBy("split", F.floor(F.col("sample_id").cast("bigint") / 1000).alias("part"))
     .agg(F.collect_list("sample_id").alias("ids"))
     .select(F.to_json(F.map_from_arrays(F.array("split"), F.array("ids"))).alias("value"))
     .write.text(f"{path}/legacy"))
    read = lambda tag, **kw: tables.read_splits_with_fallback(spark, m, **kw).select(
        F.lit(tag).alias("source"), "sample_id", "split")
    return (read("lists", lists=f"{path}/lists", legacy=f"{path}/legacy")
            .unionByName(read("legacy", lists=f"{path}/absent", legacy=f"{path}/legacy"))
            .unionByName(read("none", lists=f"{path}/absent", legacy=f"{path}/absent")))


def _vectors(spark, sf):
    f = D.features(spark, sf)
    one = lambda name, enc, c: f.select("sample_id", F.col(c).alias("embedding"), F.lit(name).alias("modality"),
                                        F.lit(enc).alias("encoder"))
    return one("text", "bge-m3", "text_vec").unionByName(one("vision", "dinov2-base", "image_vec"))


@query("s9_embedding_scan", """
SELECT sample_id, len(text_vec) AS dim, round(list_sum(text_vec), 6) AS total FROM features""")
def s9(spark, sf):
    path = scratch_path(spark, "s9")
    v = _vectors(spark, sf)
    blank = v.withColumn("sample_id", F.lit(" "))
    hollow = v.withColumn("sample_id", F.concat(F.lit("x"), "sample_id")).withColumn(
        "embedding", F.array().cast("array<double>"))
    tables.write_vectors(v.unionByName(blank).unionByName(hollow), path)
    got = tables.read_vectors(spark, path, "text", "bge-m3")
    return got.select("sample_id", F.size("embedding").cast("bigint").alias("dim"),
                      F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0),
                                          lambda a, x: a + x), 6).alias("total"))


@query("s10_token_priced_records", """
SELECT model_id, count(*) AS records FROM predictions WHERE model_id <> 'm7' GROUP BY model_id""")
def s10(spark, sf):
    pricing = D.model_table(spark).withColumn(
        "type", F.when(F.col("model_id") == "m7", "flat").otherwise(F.col("type")))
    return (D.predictions(spark, sf).join(F.broadcast(config.token_prices(pricing)), "model_id")
            .groupBy("model_id").agg(F.count(F.lit(1)).alias("records")))


@query("s11_model_pool", """
SELECT s_suppkey AS model_idx, CASE WHEN s_nationkey % 5 = 0 THEN 'model_' || s_suppkey ELSE s_name END AS model_id
FROM supplier WHERE NOT (s_nationkey % 5 <> 0 AND s_acctbal < 0)""")
def s11(spark, sf):
    s = D.table(spark, sf, "supplier")
    pool = s.select(F.col("s_suppkey").alias("model_idx"),
                    F.when(F.col("s_nationkey") % 5 != 0, F.col("s_name")).alias("model_id"))
    return config.model_pool(pool, s.filter("s_acctbal < 0").select(F.col("s_name").alias("model_id")))


def input_tokens(spark, sf):
    return C.input_token_table(D.samples_with_assets(spark, sf))


INPUT_SQL = f"""inputs AS (SELECT sample_id, dataset, task_type,
    floor(words * {V.WORDS_TO_TOKENS}::DOUBLE)::BIGINT AS text_tokens, num_images * 256 AS image_tokens,
    floor(words * {V.WORDS_TO_TOKENS}::DOUBLE)::BIGINT + num_images * 256 AS total_input_tokens, num_images
    FROM samples)"""


@query("s12_token_table_scan", f", {INPUT_SQL} SELECT * FROM inputs")
def s12(spark, sf):
    path = scratch_path(spark, "s12")
    tables.write_tokens(input_tokens(spark, sf), path)
    return tables.read_input_tokens(spark, path)


@query("s13_cost_bounds_source", """
, means AS (SELECT model_id, avg(cost) AS c FROM outcomes WHERE cost > 0 GROUP BY model_id)
SELECT 'stored' AS source, round(min(c), 10) AS cmin, round(max(c), 10) AS cmax FROM means UNION ALL
SELECT 'costs', round(min(cost), 10), round(max(cost), 10) FROM outcomes UNION ALL
SELECT 'equal', 1::DOUBLE, 2::DOUBLE UNION ALL SELECT 'empty', 0::DOUBLE, 1::DOUBLE""")
def s13(spark, sf):
    path = scratch_path(spark, "s13")
    o = D.outcomes(spark, sf)
    config.write_bounds(C.cost_bounds(o).select("cmin", "cmax"), path)
    inf = F.lit(float("inf"))
    cases = {"stored": config.read_bounds(spark, path, o), "costs": config.read_bounds(spark, None, o),
             "equal": config.read_bounds(spark, f"{path}-absent", o.withColumn("cost", F.lit(1.0))),
             "empty": config.read_bounds(spark, None, o.withColumn("cost", inf))}
    out = [b.select(F.lit(n).alias("source"), rounded("cmin", 10), rounded("cmax", 10)) for n, b in cases.items()]
    return G.union_all(out)


@query("s14_sample_sink", """
SELECT task_type, dataset, count(*) AS n, sum(length(prompt))::BIGINT AS chars FROM samples GROUP BY ALL""")
def s14(spark, sf):
    path = scratch_path(spark, "s14")
    tables.write_samples(D.samples_with_assets(spark, sf), path)
    raw = spark.read.schema(f"{tables.SAMPLE_SCHEMA}, task string, ds string").json(path)
    return raw.groupBy(F.col("task").alias("task_type"), F.col("ds").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).alias("chars"))


@query("s15_score_sink", """
SELECT dataset, count(*) AS records, sum(quality)::BIGINT AS correct FROM predictions GROUP BY dataset""")
def s15(spark, sf):
    path = scratch_path(spark, "s15")
    tables.write_scores(D.predictions(spark, sf), path)
    return tables.read_scores(spark, path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("records"), F.sum("quality_raw").alias("correct"))


@query("s16_split_sink", "SELECT split, count(*) AS n FROM meta GROUP BY split")
def s16(spark, sf):
    path = scratch_path(spark, "s16")
    tables.write_splits(D.meta(spark, sf), path)
    return tables.read_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s17_registry_sink", "SELECT sample_id, dataset, split, task FROM meta")
def s17(spark, sf):
    path = scratch_path(spark, "s17")
    tables.write_meta(D.meta(spark, sf), path)
    return tables.read_meta(spark, path)


@query("s18_csv_report", """
SELECT dataset, printf('%.6f', avg(quality)) AS accuracy, printf('%.6f', avg(cost) * 1000) AS kilo_cost,
       count(*) AS n FROM predictions GROUP BY dataset""")
def s18(spark, sf):
    path = scratch_path(spark, "s18")
    rep = D.predictions(spark, sf).groupBy("dataset").agg(
        F.avg("quality").alias("accuracy"), (F.avg("cost") * 1000).alias("kilo_cost"), F.count(F.lit(1)).alias("n"))
    reports.write_csv_report(rep, path)
    return reports.read_csv_report(spark, path, "dataset string, accuracy string, kilo_cost string, n bigint")


@query("s19_json_report", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events""")
def s19(spark, sf):
    path = scratch_path(spark, "s19")
    e = D.table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    reports.write_json_report(e.select("event_id", bad.alias("value")), path)
    return spark.read.schema("event_id bigint, value double").json(path)


@query("s20_vector_sink", """
SELECT 'text' AS modality, 'bge-m3' AS encoder, 32 AS dimension, count(*) AS rows FROM features UNION ALL
SELECT 'vision', 'dinov2-base', 32, count(*) FROM features""")
def s20(spark, sf):
    path = scratch_path(spark, "s20")
    tables.write_vectors(_vectors(spark, sf), path)
    return tables.read_vector_description(spark, path)


@query("s21_feature_cache", """
SELECT sample_id, CASE WHEN sample_id::BIGINT % 3 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS lowres_dist,
       CASE WHEN sample_id::BIGINT % 3 = 0 THEN 'cached' ELSE 'computed' END AS evidence_source FROM samples""")
def s21(spark, sf):
    """A third of the samples is cached completely, a third with a NaN, a third not at all."""
    ids = D.samples(spark, sf).select("sample_id")
    i = F.col("sample_id").cast("bigint")
    row = lambda df, value, tag: df.withColumn("evidence_source", F.lit(tag)).withColumns(
        {c: value for c in V.EVIDENCE_COLUMNS})
    old = row(ids.filter(i % 3 != 2), F.when(i % 3 == 0, F.lit(0.25)).otherwise(F.lit(float("nan"))), "cached")
    done = cache.refresh(ids, old, lambda missing: row(missing, F.lit(0.5), "computed"))
    path = scratch_path(spark, "s21")
    cache.write_refreshed(done, ids.select("sample_id", i.alias("pos")), path)
    return spark.read.schema(done.schema).parquet(path).select("sample_id", "lowres_dist", "evidence_source")
