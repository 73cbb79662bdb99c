"""Asset tables: references between rows, row numbers, sample matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.texts import ASSET_TYPE, asset, asset_list

REFERENCE_LENGTH = 64


def resolve_references(rows: DataFrame, index: str = "index", image: str = "image",
                       order: str | None = None) -> DataFrame:
    """A short image value that names another row's key takes that row's long value.

    One hop only.  Of several rows with the key the last in ``order`` counts
    (without it, the largest value), so no row is repeated.  Content that no
    row names takes no part.  A key that very many rows name makes a skewed
    join, which adaptive execution splits.
    """
    short = F.length(image) <= REFERENCE_LENGTH
    last = F.struct(*([F.col(order)] if order else []), F.col(image).alias("__content"))
    refs = rows.filter(short).withColumn("__ref", F.col(image))
    named = rows.filter(~short).withColumn("__ref", F.col(index).cast("string")).join(
        refs.select("__ref").distinct(), "__ref", "left_semi")
    content = named.groupBy("__ref").agg(F.max(last)["__content"].alias("__content"))
    resolved = refs.join(content, "__ref", "left").withColumn(image, F.coalesce("__content", image))
    return rows.filter(~short | F.col(image).isNull()).unionByName(resolved.select(*rows.columns))


def match_assets(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """Row number of each sample's asset: by string key first, then by integer key.

    ``samples`` has (sample_id, dataset); ``assets`` has (dataset, index, id,
    row_num).  Some datasets are keyed by a column other than ``index``; those
    match strings only.
    """
    key = F.col("index").cast("string")
    special = F.lit(False)
    for ds, column in V.ASSET_KEY_COLUMNS.items():
        key = F.when(F.col("dataset") == ds, F.col(column).cast("string")).otherwise(key)
        special = special | (F.col("dataset") == ds)
    keyed = assets.select("dataset", key.alias("k"), "row_num", special.alias("special"))
    by_text = keyed.groupBy("dataset", "k").agg(F.max("row_num").alias("by_text"))
    by_int = (keyed.filter(~F.col("special")).withColumn("i", F.expr("try_cast(k AS BIGINT)")).filter("i IS NOT NULL")
              .groupBy("dataset", "i").agg(F.max("row_num").alias("by_int")))
    cut = F.locate("/", F.col("sample_id"))
    tail = F.when(cut > 0, F.substr("sample_id", cut + 1)).otherwise(F.col("sample_id"))
    s = samples.withColumn("k", tail).withColumn("i", F.expr("try_cast(k AS BIGINT)"))
    joined = s.join(by_text, ["dataset", "k"], "left").join(by_int, ["dataset", "i"], "left")
    return joined.select("sample_id", "dataset", F.coalesce("by_text", "by_int").alias("row_num"))


def table_asset(tsv_file: Column, row_num: Column) -> Column:
    """The asset struct of a row in an asset table."""
    note = F.concat(F.lit("Base64 encoded image from "), F.element_at(F.split(tsv_file, "/"), -1),
                    F.lit(" at row "), row_num.cast("string"))
    return asset("image_tsv", tsv_file=tsv_file, index=row_num, description=note)


def find_table(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """The asset table of each dataset, by the closest spelling of its name.

    Exact name, upper case, without underscores, both, then any case and
    underscores; (dataset) ⋈ (path) on the folded name.
    """
    name = F.regexp_extract("path", r"([^/]+)\.tsv$", 1)
    listed = files.withColumn("stem", name).withColumn("fold", F.replace(F.lower("stem"), F.lit("_"), F.lit("")))
    d, bare = F.col("dataset"), F.replace(F.col("dataset"), F.lit("_"), F.lit(""))
    wanted = datasets.select("dataset").distinct().withColumn("fold", F.lower(bare))
    rank = (F.when(F.col("stem") == d, 0).when(F.col("stem") == F.upper(d), 1).when(F.col("stem") == bare, 2)
            .when(F.col("stem") == F.upper(bare), 3).otherwise(4))
    return wanted.join(listed, "fold", "left").groupBy("dataset").agg(
        F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))


def attach_samples(meta: DataFrame, samples: DataFrame, order: str | None = None) -> DataFrame:
    """Text and assets of each registry row; empty where the sample is unknown.

    Where no row at all matches, the registry's own text and image columns are
    used.  Of several rows of a sample the last in ``order`` counts (without
    it, the largest), so no registry row is repeated.
    """
    columns = [c for c in ("prompt", "text", "question") if c in samples.columns]
    text = F.coalesce(*[F.col(c) for c in columns], F.lit(""))
    empty = F.array().cast(f"array<{ASSET_TYPE}>")
    assets = F.coalesce("assets", empty) if "assets" in samples.columns else empty
    last = F.struct(*([F.col(order)] if order else []), text.alias("__text"), assets.alias("__assets"))
    known = (samples.groupBy("sample_id").agg(F.max(last).alias("__last"))
             .select("sample_id", "__last.__text", "__last.__assets", F.lit(1).alias("__hit")))
    joined = meta.join(known, "sample_id", "left")
    # whether any row matches: ends with the first, and needs neither texts nor assets
    hits = meta.select("sample_id").join(samples.select("sample_id"), "sample_id", "left_semi").limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    own = [F.col(c) for c in ("question", "text", "prompt") if c in meta.columns]
    fallback = F.coalesce(*own, F.lit("")) if own else F.lit("")
    listed = [F.col(c) for c in ("image_path", "image") if c in meta.columns]
    pictures = asset_list(F.coalesce(*listed).cast("string")) if listed else empty
    return (joined.withColumn("__hits", hits)
            .withColumn("text", F.when(F.col("__hits") == 0, fallback).otherwise(F.coalesce("__text", F.lit(""))))
            .withColumn("assets", F.when(F.col("__hits") == 0, pictures).otherwise(F.coalesce("__assets", empty)))
            .withColumn("matched", F.col("__hit").isNotNull())
            .drop("__text", "__assets", "__hit", "__hits"))
