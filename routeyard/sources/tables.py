"""Samples, scores, splits, registry, vectors and token tables.

Readers use declared schemas; nothing is inferred.  Writers partition by the
columns readers filter on, so those filters prune folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.texts import ASSET_TYPE
from routeyard.sources.records import PLACE, read_quoted

SAMPLE_SCHEMA = ("sample_id string, dataset string, task_type string, modality array<string>, "
                 f"prompt string, assets array<{ASSET_TYPE}>")
SCORE_SCHEMA = "sample_id string, model_id string, quality_raw int, quality double, dataset string"
INPUT_TOKEN_SCHEMA = ("sample_id string, dataset string, task_type string, text_tokens bigint, "
                      "image_tokens bigint, total_input_tokens bigint, num_images bigint")
OUTPUT_TOKEN_SCHEMA = "sample_id string, model string, output_tokens bigint, is_actual boolean"
VECTOR_SCHEMA = "sample_id string, embedding array<float>, modality string, encoder string"
ASSET_TABLE_SCHEMA = "index string, id string, image string"


def _balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Bring rows of one folder together before a partitioned write.

    Without this every task would leave a small file in every folder; AQE
    splits the pieces of a folder that holds very many rows.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_samples(samples: DataFrame, path: str) -> None:
    """One JSON-lines folder per task type and dataset."""
    rows = samples.withColumn("task", F.col("task_type")).withColumn("ds", F.col("dataset"))
    _balanced(rows, "task", "ds").write.partitionBy("task", "ds").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).json(path)


def read_samples_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Skips malformed lines and blank ids; of a repeated id the last record counts.

    Last means the largest file path, then the last line of that file, counted
    by position within the file's splits.
    """
    raw = spark.read.schema(SAMPLE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                  F.monotonically_increasing_id().alias("i"))
    rows = raw.select("*", at.alias("__at")).filter(F.trim("sample_id") != "")
    rest = [c for c in raw.columns if c != "sample_id"]
    last = F.max_by(F.struct(*rest), F.col("__at")).alias("r")
    return rows.groupBy("sample_id").agg(last).select("sample_id", "r.*")


def write_scores(scores: DataFrame, path: str) -> None:
    """Score records as Parquet, one folder per dataset."""
    rows = scores.select("sample_id", "model_id", F.col("quality").cast("int").alias("quality_raw"),
                         F.col("quality").cast("double").alias("quality"), "dataset")
    _balanced(rows, "dataset").write.partitionBy("dataset").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    _balanced(splits.select("sample_id", "split"), "split").write.partitionBy("split").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split lists; a record names its sample ``sample_id`` or ``id``."""
    raw = spark.read.schema("sample_id string, id string, split string").json(path)
    return raw.select(F.coalesce("sample_id", "id").alias("sample_id"), "split")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(0).count()
        return True
    except Exception as e:  # AnalysisException: PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def read_splits_with_fallback(spark: SparkSession, meta: DataFrame, lists: str | None = None,
                              legacy: str | None = None, pretty: bool = False) -> DataFrame:
    """Split lists, else JSON objects of id lists, else everything is training data.

    Objects stand one per line, so a large list may be cut into several; a
    single object written over several lines needs ``pretty``.
    """
    if lists and _exists(spark, lists):
        return read_splits(spark, lists)
    if legacy and _exists(spark, legacy):
        names = list(V.SPLIT_RATIOS)
        raw = spark.read.schema(", ".join(f"{n} array<string>" for n in names)).option("multiLine", pretty).json(legacy)
        sides = F.array(*[F.struct(F.lit(n).alias("split"), F.col(n).alias("ids")) for n in names])
        return raw.select(F.explode(sides).alias("s")).select(F.explode("s.ids").alias("sample_id"), "s.split")
    return meta.select("sample_id", F.lit("train").alias("split"))


def write_meta(meta: DataFrame, path: str) -> None:
    meta.select("sample_id", "dataset", "split", "task").write.parquet(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sample_id string, dataset string, split string, task string").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors in one folder per modality and encoder, next to a small description table."""
    rows = vectors.select("sample_id", F.col("embedding").cast("array<float>").alias("embedding"),
                          "modality", "encoder")
    _balanced(rows, "modality", "encoder").write.partitionBy("modality", "encoder").parquet(f"{path}/vectors")
    rows.groupBy("modality", "encoder").agg(
        F.max(F.size("embedding")).alias("dimension"), F.count(F.lit(1)).alias("rows")
    ).coalesce(1).write.json(f"{path}/description")


def read_vectors(spark: SparkSession, path: str, modality: str | None = None,
                 encoder: str | None = None) -> DataFrame:
    """Vectors with an id and at least one component; of a repeated id one is kept, the last."""
    raw = spark.read.schema(VECTOR_SCHEMA).parquet(f"{path}/vectors")
    if modality:
        raw = raw.filter(F.col("modality") == modality)
    if encoder:
        raw = raw.filter(F.col("encoder") == encoder)
    kept = raw.filter((F.trim("sample_id") != "") & (F.size("embedding") > 0))
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                  F.monotonically_increasing_id().alias("i"))
    keys = ["sample_id", "modality", "encoder"]
    return (kept.select("*", at.alias("__at")).groupBy(*keys)
            .agg(F.max_by("embedding", "__at").alias("embedding")))


def read_vector_description(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("modality string, encoder string, dimension int, rows bigint").json(
        f"{path}/description")


def write_tokens(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_input_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INPUT_TOKEN_SCHEMA).option("header", True).option("escape", '"').csv(path)


def read_output_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUT_TOKEN_SCHEMA).option("header", True).option("escape", '"').csv(path)


def write_asset_table(rows: DataFrame, path: str) -> None:
    (rows.select("index", "id", "image").write.option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path))


def read_asset_table(spark: SparkSession, path: str, line_breaks: bool = False, split: bool = True) -> DataFrame:
    """Tab-separated asset rows.  Values with line breaks need ``line_breaks``.

    Such files are cut into pieces, which costs a shuffle of their lines;
    without ``split`` each is read by one task, which is cheaper where files
    are many and small.
    """
    if line_breaks and split:
        return read_quoted(spark, path, "\t", ASSET_TABLE_SCHEMA).drop(*PLACE)
    return (spark.read.schema(ASSET_TABLE_SCHEMA).option("sep", "\t").option("header", True)
            .option("quote", '"').option("escape", '"').option("multiLine", line_breaks).csv(path))
