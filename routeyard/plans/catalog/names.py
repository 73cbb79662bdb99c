"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.functions import names as N
from routeyard.functions.texts import asset_list
from routeyard.functions.tokens import image_count
from routeyard.operators import assets as A
from routeyard.operators import labels as L
from routeyard.operators import registry as G
from routeyard.plans.catalog import query
from routeyard.plans.catalog.sources import _URIS, input_tokens, INPUT_SQL

_STAMPS = V.RUN_STAMP_DIRS


def paths(spark, sf):
    """One result-file path per document, in several folder layouts and namings."""
    d = D.table(spark, sf, "documents")
    i = F.col("doc_id")
    m = F.concat(F.lit("m"), (i % 8).cast("string"))
    folder = (F.when(i % 4 == 0, F.concat(F.lit("/runs/"), m, F.lit(f"/{_STAMPS[0]}/")))
              .when(i % 4 == 1, F.concat(F.lit("/runs/"), m, F.lit("/")))
              .when(i % 4 == 2, F.lit(f"/runs/outsider/{_STAMPS[1]}/"))
              .otherwise(F.concat(F.lit("/runs/x/guest"), (i % 3).cast("string"), F.lit("/"))))
    suffix = F.element_at(F.array(F.lit(""), *[F.lit(s) for s in V.RESULT_SUFFIXES], F.lit("_acc")),
                          (i % 9 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".csv"), F.lit(".json"), F.lit(".parquet")), (i % 3 + 1).cast("int"))
    stem = F.when(i % 5 == 0, F.lit("OCRBench")).otherwise(F.col("source"))
    return d.select("doc_id", F.concat(folder, m, F.lit("_"), stem, suffix, ext).alias("path"))


_SUFFIX_LIST = ", ".join(f"'{s}'" for s in ("", *V.RESULT_SUFFIXES, "_acc"))
PATHS_SQL = f"""paths AS (SELECT doc_id,
    CASE doc_id % 4 WHEN 0 THEN '/runs/m' || (doc_id % 8) || '/{_STAMPS[0]}/'
         WHEN 1 THEN '/runs/m' || (doc_id % 8) || '/' WHEN 2 THEN '/runs/outsider/{_STAMPS[1]}/'
         ELSE '/runs/x/guest' || (doc_id % 3) || '/' END
    || 'm' || (doc_id % 8) || '_' || CASE WHEN doc_id % 5 = 0 THEN 'OCRBench' ELSE source END
    || [{_SUFFIX_LIST}][doc_id % 9 + 1] || ['.csv', '.json', '.parquet'][doc_id % 3 + 1] AS path FROM documents),
named AS (SELECT doc_id, path, string_split(path, '/')[-1] AS base,
    COALESCE(list_filter(string_split(path, '/'), lambda p: regexp_full_match(p, 'm[0-7]'))[1],
             CASE WHEN string_split(path, '/')[-2] NOT IN ('{_STAMPS[0]}', '{_STAMPS[1]}')
                  THEN string_split(path, '/')[-2] END,
             CASE WHEN string_split(path, '/')[-3] NOT IN ('{_STAMPS[0]}', '{_STAMPS[1]}')
                  THEN string_split(path, '/')[-3] END) AS model_id FROM paths),
stems AS (SELECT *, regexp_replace(base,
    '({"|".join(V.RESULT_SUFFIXES)})?\\.({"|".join(V.RESULT_EXTENSIONS)})$', '') AS stem FROM named),
located AS (SELECT doc_id, path, base, model_id, CASE WHEN starts_with(stem, model_id || '_')
    THEN substr(stem, length(model_id) + 2) ELSE stem END AS dataset FROM stems)"""


def _located(spark, sf):
    p = paths(spark, sf).withColumn("model_id", N.model_of_path(F.col("path"), D.MODEL_IDS))
    return p.withColumn("dataset", N.dataset_of_path(F.col("path"), F.col("model_id")))


@query("p1_column_resolution", """
SELECT 'conversations' AS layout, conv_id::VARCHAR AS id, text AS prompt, count(*) AS n FROM conversations GROUP BY ALL
UNION ALL SELECT 'benchmark', item_id::VARCHAR, text, count(*) FROM benchmark GROUP BY ALL
UNION ALL SELECT 'documents', doc_id::VARCHAR, lang, count(*) FROM documents GROUP BY ALL""")
def p1(spark, sf):
    """The first existing candidate column, per layout."""
    parts = []
    for name, renames in {"conversations": {"conv_id": "id"}, "benchmark": {"item_id": "index"},
                          "documents": {"doc_id": "sample_id", "lang": "question"}}.items():
        t = D.table(spark, sf, name).withColumnsRenamed(renames)
        parts.append(t.select(F.lit(name).alias("layout"),
                              F.col(N.first_existing(t.columns, V.ID_CANDIDATES)).cast("string").alias("id"),
                              F.col(N.first_existing(t.columns, V.PROMPT_CANDIDATES)).alias("prompt")))
    return G.union_all(parts).groupBy("layout", "id", "prompt").agg(F.count(F.lit(1)).alias("n"))


@query("p2_model_of_path", f", {PATHS_SQL} SELECT doc_id, path, model_id FROM located")
def p2(spark, sf):
    return _located(spark, sf).select("doc_id", "path", "model_id")


@query("p3_dataset_of_path", f", {PATHS_SQL} SELECT doc_id, path, dataset FROM located")
def p3(spark, sf):
    return _located(spark, sf).select("doc_id", "path", "dataset")


_KIND_SQL = f"""CASE WHEN regexp_matches(base, 'gpt-4o-mini(_score)?\\.({"|".join(V.RESULT_EXTENSIONS)})') THEN 'Math'
    WHEN regexp_matches(base, '_openai_result\\.({"|".join(V.RESULT_EXTENSIONS)})') THEN 'MCQ'
    WHEN regexp_matches(base, '_auxmatch\\.({"|".join(V.RESULT_EXTENSIONS)})') THEN 'Y/N'
    WHEN contains(dataset, 'OCRBench') AND NOT contains(base, '_results') THEN 'OCRBench' ELSE 'VQA' END"""


@query("p4_result_kind", f", {PATHS_SQL} SELECT {_KIND_SQL} AS kind, count(*) AS files FROM located GROUP BY 1")
def p4(spark, sf):
    return _located(spark, sf).groupBy(N.result_kind(F.col("path"), F.col("dataset")).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"))


@query("p5_sample_id", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN 'set/' || doc_id
       WHEN 2 THEN source || '/' || doc_id END AS sample_id FROM documents""")
def p5(spark, sf):
    d = D.table(spark, sf, "documents")
    i = F.col("doc_id")
    raw = (F.when(i % 4 == 0, F.concat(F.lit(" \t"), i, F.lit("\n"))).when(i % 4 == 1, F.concat(F.lit("set/"), i))
           .when(i % 4 == 2, i.cast("string")))
    return d.select("doc_id", N.normalize_sample_id(raw, F.col("source")).alias("sample_id"))


_ALIASES = [(a, c) for c, names in V.DATASET_ALIASES.items() for a in names]


@query("p6_canonical_dataset", f"""
, aliases(alias, canon) AS {D.values_sql(_ALIASES)},
numbered AS (SELECT alias, canon, row_number() OVER (ORDER BY alias) - 1 AS k FROM aliases),
names AS (SELECT doc_id, COALESCE(alias, source) AS name FROM documents LEFT JOIN numbered ON doc_id % 60 = k),
loose AS (SELECT DISTINCT replace(upper(alias), '-', '_') AS fold, CASE WHEN alias = 'MMMU_DEV' THEN alias ELSE canon END AS canon
          FROM aliases)
SELECT doc_id, name, COALESCE(a.canon, upper(name)) AS strict, COALESCE(l.canon, name) AS loose
FROM names LEFT JOIN aliases a ON a.alias = name LEFT JOIN loose l ON l.fold = replace(upper(name), '-', '_')""")
def p6(spark, sf):
    d = D.table(spark, sf, "documents")
    known = F.array(*[F.lit(a) for a in sorted(a for a, _ in _ALIASES)])
    name = F.coalesce(F.try_element_at(known, (F.col("doc_id") % 60 + 1).cast("int")), F.col("source"))
    return d.select("doc_id", name.alias("name")).select(
        "doc_id", "name", N.canonical_dataset(F.col("name")).alias("strict"),
        N.canonical_dataset_loose(F.col("name")).alias("loose"))


@query("p7_task_of_dataset", f"""
, tasks(name, task) AS {D.values_sql(V.DATASET_TASKS.items())},
numbered AS (SELECT name, task, row_number() OVER (ORDER BY name) - 1 AS k FROM tasks)
SELECT COALESCE(name, source) AS dataset, COALESCE(task, 'unknown') AS task, count(*) AS n
FROM documents LEFT JOIN numbered ON doc_id % 20 = k GROUP BY ALL""")
def p7(spark, sf):
    d = D.table(spark, sf, "documents")
    known = F.array(*[F.lit(n) for n in sorted(V.DATASET_TASKS)])
    name = F.coalesce(F.try_element_at(known, (F.col("doc_id") % 20 + 1).cast("int")), F.col("source"))
    return d.select(name.alias("dataset")).groupBy("dataset", N.task_of_dataset(F.col("dataset")).alias("task")).agg(
        F.count(F.lit(1)).alias("n"))


_TARGETS = ["src1", "src_2", "SRC3"]


@query("p8_dataset_of_sample", """
, raw AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id
                 ELSE upper(source) || '_' || doc_id END AS sample_id FROM documents),
found AS (SELECT sample_id, CASE WHEN contains(sample_id, '/') THEN
    CASE WHEN string_split(sample_id, '/')[1] IN ('src1', 'src_2', 'SRC3') THEN string_split(sample_id, '/')[1] END
    WHEN starts_with(lower(sample_id), 'src1') THEN 'src1' WHEN starts_with(lower(sample_id), 'src2') THEN 'src_2'
    WHEN starts_with(lower(sample_id), 'src3') THEN 'SRC3' END AS dataset FROM raw)
SELECT * FROM found WHERE dataset IS NOT NULL""")
def p8(spark, sf):
    d = D.table(spark, sf, "documents")
    sid = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("/", "source", "doc_id")).otherwise(
        F.concat_ws("_", F.upper("source"), "doc_id"))
    return (d.select(sid.alias("sample_id"))
            .withColumn("dataset", N.dataset_of_sample(F.col("sample_id"), _TARGETS)).filter("dataset IS NOT NULL"))


@query("p9_target_filter", """
SELECT sample_id, model_id, dataset FROM predictions WHERE model_id IN ('m1', 'm6') AND dataset IN ('src0', 'src3')""")
def p9(spark, sf):
    return G.restrict(D.predictions(spark, sf), ["m1", "m6"], ["src0", "src3"]).select(
        "sample_id", "model_id", "dataset")


@query("p10_derived_files", f""", {PATHS_SQL}
SELECT doc_id, path FROM paths WHERE NOT regexp_matches(path, '(_acc|_score|_extract)\\.')""")
def p10(spark, sf):
    return paths(spark, sf).filter(~N.is_derived(F.col("path")))


@query("p11_asset_list", f"""
SELECT sample_id, num_images AS n, {_URIS} AS uris FROM samples""")
def p11(spark, sf):
    s = D.samples(spark, sf).withColumn("a", asset_list(F.col("image_path")))
    return s.select("sample_id", F.size("a").cast("bigint").alias("n"),
                    F.array_join(F.transform("a", lambda a: a["uri"]), "|").alias("uris"))


@query("p11_row_assets", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image_tsv:t.tsv#' || doc_id WHEN 1 THEN 'image:a' || doc_id || '|image:b'
       WHEN 2 THEN 'image:one' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN doc_id % 4 = 3 THEN '' ELSE '|' END) || 'image:p1|image:p2' ELSE '' END AS found
FROM documents""")
def p11_rows(spark, sf):
    """Assets as JSON, as a Python-style literal, as one object, and in a path column."""
    from routeyard.functions.texts import row_assets

    i = F.col("doc_id")
    text = (F.when(i % 4 == 0, F.concat(F.lit('[{"type": "image_tsv", "tsv_file": "t.tsv", "index": '), i, F.lit("}]")))
            .when(i % 4 == 1, F.concat(F.lit("[{'type': 'image', 'uri': 'a"), i, F.lit("'}, {'type': 'image', 'uri': 'b'}]")))
            .when(i % 4 == 2, F.lit('{"type": "image", "uri": "one"}')).otherwise("not assets"))
    rows = D.table(spark, sf, "documents").select(
        "doc_id", text.alias("assets"), F.when(i % 3 == 0, F.lit("p1, p2")).alias("uri"))
    show = lambda a: F.concat(a["type"], F.lit(":"), F.coalesce(a["uri"], F.concat(a["tsv_file"], F.lit("#"), a["index"].cast("string"))))
    return rows.select("doc_id", F.array_join(F.transform(row_assets(rows.columns), show), "|").alias("found"))


@query("p12_image_count", "SELECT dataset, sum(num_images)::BIGINT AS images FROM samples GROUP BY dataset")
def p12(spark, sf):
    return D.samples_with_assets(spark, sf).groupBy("dataset").agg(
        F.sum(image_count(F.col("assets"))).alias("images"))


@query("p13_solvable_samples", """
SELECT sample_id, model_id, quality FROM outcomes
WHERE sample_id IN (SELECT sample_id FROM outcomes GROUP BY sample_id HAVING max(quality) > 0)""")
def p13(spark, sf):
    return L.solvable(D.outcomes(spark, sf)).select("sample_id", "model_id", "quality")


@query("p14_rows_without_tokens", f""", {INPUT_SQL}
SELECT count(*) AS records, count(total_input_tokens) AS kept, count(*) - count(total_input_tokens) AS dropped
FROM predictions p LEFT JOIN (SELECT * FROM inputs WHERE dataset <> 'src0') i USING (sample_id)""")
def p14(spark, sf):
    from routeyard.operators.costs import with_input_tokens

    inputs = input_tokens(spark, sf).filter("dataset <> 'src0'")
    joined = with_input_tokens(D.predictions(spark, sf), inputs)
    return joined.agg(F.count(F.lit(1)).alias("records"), F.count("total_input_tokens").alias("kept"),
                      F.count_if(F.col("total_input_tokens").isNull()).alias("dropped"))


@query("p15_sample_caps", f"""
(SELECT 'first' AS cap, sample_id FROM samples ORDER BY sample_id LIMIT 50) UNION ALL
(SELECT 'random', sample_id FROM samples ORDER BY {D.bucket_sql("'42|' || sample_id")}, sample_id LIMIT 50)""")
def p15(spark, sf):
    ids = D.samples(spark, sf).select("sample_id")
    return G.cap_first(ids, 50).select(F.lit("first").alias("cap"), "sample_id").unionByName(
        G.cap_random(ids, 50).select(F.lit("random").alias("cap"), "sample_id"))


@query("p16_complete_rows", """
SELECT doc_id::VARCHAR AS sample_id, doc_id % 4 = 0 AS complete FROM documents""")
def p16(spark, sf):
    i = F.col("sample_id").cast("bigint")
    ids = D.samples(spark, sf).select("sample_id")
    bad = (F.when(i % 4 == 1, F.lit(float("nan"))).when(i % 4 == 2, F.lit(float("-inf")))
           .when(i % 4 == 0, F.lit(0.5)))
    rows = ids.withColumns({c: F.lit(0.1) for c in V.EVIDENCE_COLUMNS}).withColumn("lowres_dist", bad)
    return rows.select("sample_id", G.complete(rows).alias("complete"))


@query("p17_fill_fields", """
SELECT doc_id::VARCHAR AS sample_id,
       CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'from-labels' ELSE NULL END AS note, l.quality::VARCHAR AS quality
FROM documents LEFT JOIN labels l USING (doc_id) WHERE doc_id % 3 <> 1 OR l.doc_id IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, '', NULL FROM documents WHERE doc_id % 3 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def p17(spark, sf):
    i = F.col("doc_id")
    left = D.table(spark, sf, "documents").select(
        i.cast("string").alias("sample_id"),
        F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, F.lit("")).alias("note"))
    right = D.table(spark, sf, "labels").select(
        i.cast("string").alias("sample_id"), F.when(i % 3 == 1, "from-labels").alias("note"),
        F.col("quality").cast("string").alias("quality"))
    return G.fill_fields(left, right)


@query("p18_fallback_ids", """
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'sample_' || (row_number() OVER (ORDER BY doc_id) - 1)
       ELSE 'doc-' || doc_id END AS sample_id, '' AS dataset FROM documents""")
def p18(spark, sf):
    i = F.col("doc_id")
    rows = D.table(spark, sf, "documents").select(
        "doc_id", F.when(i % 4 == 0, F.lit("")).when(i % 4 > 1, F.concat(F.lit("doc-"), i)).alias("sample_id"))
    return G.fill_missing_ids(rows, "doc_id")


@query("p19_first_text", """
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN role WHEN turn % 2 = 0 THEN text ELSE '' END AS first_filled,
       CASE WHEN conv_id % 3 = 0 THEN role WHEN conv_id % 3 = 1 THEN '' WHEN turn % 2 = 0 THEN text ELSE '' END AS first_present
FROM conversations""")
def p19(spark, sf):
    c = D.table(spark, sf, "conversations")
    a = F.when(F.col("conv_id") % 3 == 0, F.col("role")).when(F.col("conv_id") % 3 == 1, F.lit(""))
    b = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return c.select("conv_id", "turn", N.first_text(a, b).alias("first_filled"),
                    N.first_present_text(a, b).alias("first_present"))


@query("p20_asset_table_file", """
, d AS (SELECT DISTINCT c_mktsegment || '_' || (c_nationkey % 5) AS dataset, c_nationkey % 5 AS k FROM customer),
files AS (SELECT dataset, CASE k WHEN 0 THEN dataset WHEN 1 THEN upper(dataset) WHEN 2 THEN replace(dataset, '_', '')
          WHEN 3 THEN lower(replace(dataset, '_', '')) END AS stem FROM d)
SELECT dataset, '/data/' || stem || '.tsv' AS path FROM files""")
def p20(spark, sf):
    c = D.table(spark, sf, "customer").select(
        F.concat_ws("_", "c_mktsegment", F.col("c_nationkey") % 5).alias("dataset"),
        (F.col("c_nationkey") % 5).alias("k")).distinct()
    ds, bare = F.col("dataset"), F.replace("dataset", F.lit("_"), F.lit(""))
    stem = (F.when(F.col("k") == 0, ds).when(F.col("k") == 1, F.upper(ds)).when(F.col("k") == 2, bare)
            .when(F.col("k") == 3, F.lower(bare)))
    files = c.withColumn("path", F.concat(F.lit("/data/"), stem, F.lit(".tsv"))).filter("path IS NOT NULL")
    return A.find_table(c, files.select("path"))
