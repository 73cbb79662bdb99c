"""Routing tables derived from the driver tables, in Spark and in SQL.

``PRELUDE`` is the same set of views as common table expressions; a query's
reference SQL is the prelude followed by its own SELECT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.scores import hash_bucket
from routeyard.functions.texts import asset_list
from routeyard.functions.tokens import word_count
from routeyard.runtime import persisted, spread

# Fixed values of the fixture: model, input price, output price, skill.
MODELS = (
    ("m0", 0.05, 0.05, 450), ("m1", 0.06, 0.06, 480), ("m2", 0.10, 0.10, 520),
    ("m3", 0.18, 0.25, 560), ("m4", 0.35, 0.50, 620), ("m5", 0.80, 1.20, 700),
    ("m6", 0.30, 2.40, 720), ("m7", 2.50, 10.00, 760),
)
MODEL_IDS = [m[0] for m in MODELS]
SPARSE_MODELS = [f"m{i}" for i in range(17)]
TASKS = {"en": "vqa_mc", "fr": "vqa_oe", "de": "ocr_qa", "es": "math"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def model_table(spark: SparkSession) -> DataFrame:
    rows = [(m, "token_based", i, o, s) for m, i, o, s in MODELS]
    return spark.createDataFrame(
        rows, "model_id string, type string, input_price double, output_price double, skill int")


def model_array() -> Column:
    """The model dimension as a literal array; exploding it needs no join."""
    return F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("input_price"),
                              F.lit(o).alias("output_price"), F.lit(s).alias("skill"))
                     for m, i, o, s in MODELS])


def task_of_lang(lang: Column) -> Column:
    out = F
    for k, v in TASKS.items():
        out = out.when(lang == k, F.lit(v))
    return out.otherwise(F.lit("unknown"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    i = F.col("doc_id")
    image = (F.when(i % 4 == 1, F.concat(F.lit("img/"), i, F.lit(".png")))
             .when(i % 4 == 2, F.concat(F.lit("img/"), i, F.lit("_0.png; img/"), i, F.lit("_1.png")))
             .when(i % 4 == 3, F.concat(F.lit("img/"), i, F.lit(".png,, "))))
    return d.select(i.cast("string").alias("sample_id"),
                    F.col("source").alias("dataset"),
                    task_of_lang(F.col("lang")).alias("task_type"),
                    F.col("text").alias("prompt"), image.alias("image_path"))


def samples_with_assets(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select(
        "sample_id", "dataset", "task_type", F.array(F.lit("image"), F.lit("text")).alias("modality"),
        "prompt", asset_list(F.col("image_path")).alias("assets"))


def split_of(sample_id: Column) -> Column:
    b = hash_bucket(F.concat(F.lit("42|"), sample_id)) % 100
    return F.when(b < 70, "train").when(b < 80, "dev").otherwise("test")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Sample registry without the text: (sample_id, dataset, split, task)."""
    s = samples(spark, sf)
    return s.select("sample_id", "dataset", split_of(F.col("sample_id")).alias("split"),
                    F.col("task_type").alias("task"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (sample, model) with correctness, tokens and cost."""
    d = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("dataset"),
        word_count(F.col("text")).alias("words"),
        (hash_bucket(F.concat(F.lit("d|"), F.col("doc_id").cast("string"))) % 400 - 200)
        .alias("difficulty"))
    cells = (d.withColumn("m", F.explode(model_array()))
             .withColumn("h", hash_bucket(F.concat_ws("|", "sample_id", F.col("m.model_id"))))
             .withColumn("output_tokens", F.lit(5) + F.floor(F.col("h") / 1000).cast("bigint") % 300))
    cost = (F.col("words") * F.lit(V.WORDS_TO_TOKENS) * F.col("m.input_price")
            + F.col("output_tokens") * F.col("m.output_price")) / F.lit(1e6)
    return cells.select(
        "sample_id", "dataset", F.col("m.model_id").alias("model_id"),
        (F.col("h") % 1000 < F.col("m.skill") - F.col("difficulty")).cast("int").alias("quality"),
        "output_tokens", cost.alias("cost"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table: unique (sample_id, model_id) with quality and cost."""
    return predictions(spark, sf).select("sample_id", "model_id", "quality", "cost")


def stored_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table written once, for queries that read it several times."""
    return persisted(outcomes(spark, sf), "outcomes")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Text vector (dims 1-32) and image vector (dims 33-64) of the samples that have one."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("e"))
    return (samples(spark, sf).join(e, "sample_id")
            .select("sample_id", "dataset", "task_type", "prompt",
                    F.slice("e", 1, 32).alias("text_vec"), F.slice("e", 33, 32).alias("image_vec")))


def sparse_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes with missing and repeated (sample, model) pairs."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("sample_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 17).cast("string")).alias("model_id"),
        (F.col("l_returnflag") == "A").cast("int").alias("quality"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) / F.lit(1e6)).alias("cost"),
        F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate",
                 "l_linestatus", "l_tax", "l_suppkey").alias("priority"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Timed router calls: (router, batch_size, ms, tokens)."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("router"),
                    F.pow(F.lit(2.0), F.col("user_id") % 5).cast("int").alias("batch_size"),
                    F.col("value").alias("ms"),
                    (F.col("event_id") % 500 + 1).alias("tokens"))


def asset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Asset table rows whose image is content, or the key of another row."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("index"),
                    F.when(F.length("text") > 64, F.col("text"))
                    .otherwise(F.floor(F.col("doc_id") / 2).cast("string")).alias("image"))


def _models_sql() -> str:
    rows = ", ".join(f"('{m}', {i!r}::DOUBLE, {o!r}::DOUBLE, {s})" for m, i, o, s in MODELS)
    return f"(VALUES {rows})"


def _task_sql() -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASKS.items())
    return f"CASE lang {whens} ELSE 'unknown' END"


def bucket_sql(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


WORDS_SQL = f"COALESCE(len(regexp_extract_all(text, '{V.WORD_PATTERN}')), 0)"

PRELUDE = f"""
WITH models(model_id, input_price, output_price, skill) AS {_models_sql()},
samples AS (SELECT doc_id::VARCHAR AS sample_id, source AS dataset, {_task_sql()} AS task_type,
                   text AS prompt, {WORDS_SQL}::BIGINT AS words,
                   CASE doc_id % 4 WHEN 1 THEN 'img/' || doc_id || '.png'
                        WHEN 2 THEN 'img/' || doc_id || '_0.png; img/' || doc_id || '_1.png'
                        WHEN 3 THEN 'img/' || doc_id || '.png,, ' END AS image_path,
                   [0, 1, 2, 1][doc_id % 4 + 1]::BIGINT AS num_images FROM documents),
meta AS (SELECT sample_id, dataset,
                CASE WHEN {bucket_sql("'42|' || sample_id")} % 100 < 70 THEN 'train'
                     WHEN {bucket_sql("'42|' || sample_id")} % 100 < 80 THEN 'dev'
                     ELSE 'test' END AS split, task_type AS task FROM samples),
cells AS (SELECT sample_id, dataset, model_id, words, input_price, output_price, skill,
                 {bucket_sql("sample_id || '|' || model_id")} AS h,
                 {bucket_sql("'d|' || sample_id")} % 400 - 200 AS difficulty
          FROM samples, models),
predictions AS (SELECT sample_id, dataset, model_id,
                       (h % 1000 < skill - difficulty)::INT AS quality,
                       5 + (h // 1000) % 300 AS output_tokens,
                       (words * {V.WORDS_TO_TOKENS}::DOUBLE * input_price
                        + (5 + (h // 1000) % 300) * output_price) / 1000000::DOUBLE AS cost
                FROM cells),
outcomes AS (SELECT sample_id, model_id, quality, cost FROM predictions),
features AS (SELECT s.sample_id, s.dataset, s.task_type, s.prompt,
                    (embedding::DOUBLE[])[1:32] AS text_vec, (embedding::DOUBLE[])[33:64] AS image_vec
             FROM samples s JOIN embeddings e ON s.sample_id = e.vec_id::VARCHAR),
sparse_outcomes AS (SELECT l_orderkey::VARCHAR AS sample_id, 'm' || (l_suppkey % 17) AS model_id,
                           (l_returnflag = 'A')::INT AS quality,
                           l_extendedprice * (1::DOUBLE - l_discount) / 1000000::DOUBLE AS cost,
                           row(l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate,
                               l_linestatus, l_tax, l_suppkey) AS priority
                    FROM lineitem),
run_log AS (SELECT event_type AS router, (2 ** (user_id % 5))::INT AS batch_size, value AS ms,
                   event_id % 500 + 1 AS tokens FROM events),
asset_rows AS (SELECT doc_id::VARCHAR AS index, CASE WHEN length(text) > 64 THEN text
                      ELSE (doc_id // 2)::VARCHAR END AS image FROM documents)
"""


def oracle(sql: str) -> str:
    return PRELUDE + sql


def values_sql(rows) -> str:
    """Rows of strings and numbers as a VALUES list."""
    lit = lambda x: "NULL" if x is None else (
        "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x))
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + ")"
