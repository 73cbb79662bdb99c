"""Evaluation result tables whose model and dataset are in the path.

Files of one column layout are read together; the layout decides which column
plays which part, never the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions import names as N
from routeyard.operators.registry import keep_first, union_all
from routeyard.sources.records import read_quoted


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A glob of one layout.

    ``csv-quoted`` is CSV whose values hold line breaks, cut into pieces by
    its quotes; ``csv-multiline`` the same with quotes also inside values that
    aren't quoted (files are not split).
    """
    fmt, _, flag = fmt.partition("-")
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if flag == "quoted":
        return read_quoted(spark, path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", flag == "multiline").csv(path)


def _pick(df: DataFrame, candidates: tuple[str, ...]) -> Column | None:
    name = N.first_existing(df.columns, candidates)
    return None if name is None else F.col(f"`{name}`")


def file_row_numbers(df: DataFrame) -> DataFrame:
    """Dense row numbers from 0 within each file, as ``file_row``.

    Rows are numbered within the pieces a file is read in, whose size is
    bounded, and shifted by the row counts of the pieces before.
    """
    rows = (df.withColumnRenamed("__record", "__at") if "__record" in df.columns else
            df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__piece", F.col("_metadata.file_block_start"))
            .withColumn("__at", F.monotonically_increasing_id()))
    piece = Window.partitionBy("__file", "__piece").orderBy("__at")
    before = Window.partitionBy("__file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__file", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    shift = counts.select("__file", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return (rows.withColumn("__i", F.row_number().over(piece) - 1).join(shift, ["__file", "__piece"])
            .withColumn("file_row", F.col("__i") + F.col("__shift"))
            .drop("__piece", "__at", "__i", "__shift").withColumnRenamed("__file", "file_path"))


def _located(df: DataFrame, pool: list[str]) -> DataFrame:
    # a table written by Spark is a folder of part files; the folder carries the name
    if "__record" in df.columns:
        path, block, inside = F.col("__file"), F.col("__piece"), F.col("__record").cast("bigint")
    elif "file_path" in df.columns:
        path, block, inside = F.col("file_path"), F.lit(0).cast("bigint"), F.col("file_row").cast("bigint")
    else:
        path, block, inside = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    with_path = df.withColumn("file", F.regexp_replace(path, "/part-[^/]*$", ""))
    # part file, then block, then row: the order doesn't depend on which files share a task
    return (with_path.withColumn("row_num", F.struct(path.alias("part"), block.alias("block"), inside.alias("row")))
            .withColumn("model_id", N.model_of_path(F.col("file"), pool))
            .withColumn("dataset", N.dataset_of_path(F.col("file"), F.col("model_id"))))


def read_results(spark: SparkSession, layouts: list[tuple[str, str]], pool: list[str],
                 models: list[str] | None = None, datasets: list[str] | None = None) -> DataFrame:
    """(sample_id, model_id, dataset, kind, file, quality, prompt, image_path) of all result files.

    ``layouts`` lists (path glob, format), one entry per column layout.  A
    layout without a correctness column contributes nothing.
    """
    parts = []
    for path, fmt in layouts:
        raw = _read(spark, path, fmt)
        correct = _pick(raw, V.CORRECT_CANDIDATES)
        if correct is None:
            continue
        key = _pick(raw, V.ID_CANDIDATES)
        located = _located(file_row_numbers(raw) if key is None else raw, pool)
        key = F.col("file_row") if key is None else key
        prompt, image = _pick(raw, V.PROMPT_CANDIDATES), _pick(raw, V.IMAGE_CANDIDATES)
        empty = F.lit("")
        located = located.withColumn("kind", N.result_kind(F.col("file"), F.col("dataset")))
        helper = F.col("kind").isin("VQA", "OCRBench") & N.is_derived(F.col("file"))
        parts.append(located.filter(~helper).select(
            N.normalize_sample_id(key, F.col("dataset")).alias("sample_id"), "model_id", "dataset",
            "kind", "file", "row_num",
            correct.cast("double").cast("int").alias("quality"),
            (empty if prompt is None else F.coalesce(prompt.cast("string"), empty)).alias("prompt"),
            (empty if image is None else F.coalesce(image.cast("string"), empty)).alias("image_path")))
    out = union_all(parts)
    if models is not None:
        out = out.filter(F.col("model_id").isin(list(models)))
    if datasets is not None:
        out = out.filter(F.col("dataset").isin(list(datasets)))
    return out


def read_predictions(spark: SparkSession, layouts: list[tuple[str, str]], pool: list[str]) -> DataFrame:
    """(sample_id, model_id, dataset, prediction, is_correct), the first file wins a repeated pair."""
    parts = []
    for path, fmt in layouts:
        raw = _read(spark, path, fmt)
        key, text = _pick(raw, V.PREDICTION_ID_CANDIDATES), _pick(raw, V.PREDICTION_CANDIDATES)
        if key is None or text is None:
            continue
        correct = _pick(raw, V.CORRECT_CANDIDATES)
        located = _located(raw, pool).withColumn("canon", N.canonical_dataset(F.col("dataset")))
        parts.append(located.filter(~N.is_derived(F.col("file"), V.DERIVED_PREDICTION_FRAGMENTS)
                                    & F.col("model_id").isin(list(pool))).select(
            F.concat_ws("/", "canon", key.cast("string")).alias("sample_id"), "model_id",
            F.col("canon").alias("dataset"), F.coalesce(text.cast("string"), F.lit("")).alias("prediction"),
            (F.lit(None) if correct is None else correct).cast("double").alias("is_correct"), "file", "row_num"))
    return keep_first(union_all(parts), ["sample_id", "model_id"], ["file", "row_num"],
                      ["dataset", "prediction", "is_correct"])
