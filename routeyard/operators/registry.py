"""Fact table, registry, splits and caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.scores import hash_bucket
from routeyard.operators.prefix import row_numbers
from routeyard.runtime import finite


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column],
               columns: list[str] | None = None) -> DataFrame:
    """First row per key in ``order``, with ``columns`` (default: all).

    An aggregate rather than a window: repeats are combined before the
    shuffle, so a key with very many repeats costs nothing extra.
    """
    rest = columns or [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Last row per key in ``order``: how an upsert resolves versions."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select(*keys, "__row.*")


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str] = ("sample_id",),
           order: list[str] = ()) -> DataFrame:
    """Cache rows replaced by fresh rows of the same key.

    Of several fresh rows of a key the last in ``order`` wins.  Rows equal in
    ``order`` are told apart by their values, so the result never depends on
    how the rows are partitioned; columns of map type can't be ordered and
    take no part in that.
    """
    keys = list(keys)
    both = union_all([cache.withColumn("__version", F.lit(0)), fresh.withColumn("__version", F.lit(1))])
    rest = [f.name for f in both.schema if f.name not in (*keys, *order, "__version") and "map<" not in f.dataType.simpleString()]
    return keep_last(both, keys, ["__version", *order, *rest]).drop("__version")


def resolve_results(results: DataFrame) -> DataFrame:
    """Correctness from the last file that has it, prompt and assets from the first.

    ``results`` carries ``kind`` and ``file``; files are read in the order of
    their kinds, then by name.
    """
    kinds = F.array(*[F.lit(k) for k in V.RESULT_KIND_ORDER])
    order = F.struct(F.array_position(kinds, F.col("kind")), F.col("file"), F.col("row_num"))
    return results.groupBy("sample_id", "model_id").agg(
        F.max_by("quality", order).alias("quality"))


def resolve_sample_metadata(results: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in V.RESULT_KIND_ORDER])
    order = F.struct(F.array_position(kinds, F.col("kind")), F.col("file"), F.col("row_num"))
    first = F.min_by(F.struct("prompt", "image_path"), order).alias("r")
    return results.groupBy("sample_id").agg(first).select("sample_id", "r.*")


def pivot_scores(scores: DataFrame, models: list[str], order: list[str]) -> DataFrame:
    """One row per sample and one column per model; the first value of a repeated pair."""
    return scores.groupBy("sample_id").pivot("model_id", models).agg(F.min_by("quality", F.struct(*order)))


def model_summary(outcomes: DataFrame, meta: DataFrame) -> DataFrame:
    """Accuracy and mean cost per model, overall and per split, in one pass."""
    tagged = outcomes.join(meta.select("sample_id", "split"), "sample_id")
    return tagged.groupingSets([["model_id"], ["split", "model_id"]], "split", "model_id").agg(
        F.avg("quality").alias("accuracy"), F.avg("cost").alias("avg_cost"),
        F.count(F.lit(1)).alias("records"))


def coverage(outcomes: DataFrame) -> DataFrame:
    """Records and distinct samples per model; the row without a model is overall."""
    return outcomes.rollup("model_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("sample_id").alias("samples"))


def dense_model_index(models: DataFrame) -> DataFrame:
    """Position of each model in sorted order; the model dimension is small."""
    packed = models.select("model_id").distinct().agg(F.sort_array(F.collect_list("model_id")).alias("m"))
    return packed.select(F.posexplode("m").alias("model_idx", "model_id"))


def fill_missing_ids(rows: DataFrame, position: str) -> DataFrame:
    """Blank sample ids become ``sample_{i}``, an absent dataset becomes empty.

    ``i`` is the row's position in the order of ``position``.
    """
    if "sample_id" not in rows.columns:
        rows = rows.withColumn("sample_id", F.lit(None).cast("string"))
    if "dataset" not in rows.columns:
        rows = rows.withColumn("dataset", F.lit(""))
    numbered = row_numbers(rows, position, "__i")
    name = F.concat(F.lit("sample_"), F.col("__i").cast("string"))
    return numbered.withColumn("sample_id", F.coalesce(F.nullif(F.col("sample_id"), F.lit("")), name)).drop("__i")


def fill_fields(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Fill missing or empty fields of ``left`` from ``right``; nothing is overwritten.

    Fields only ``right`` has are added.
    """
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in right.columns if c != key])
    joined = left.join(other, key, "left")
    cols = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.col(c)).alias(c)
            if f"__{c}" in joined.columns else F.col(c) for c in left.columns]
    extra = [F.col(f"__{c}").alias(c) for c in right.columns if c not in left.columns]
    return joined.select(*cols, *extra)


def complete(df: DataFrame, columns: tuple[str, ...] = V.EVIDENCE_COLUMNS) -> Column:
    """True when the id is present and every feature column is a finite number."""
    present = F.coalesce(F.trim("sample_id") != "", F.lit(False))
    if any(c not in df.columns for c in columns):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")) for c in columns], present)


def only_samples(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("sample_id"), "sample_id", "left_semi")


def not_in(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def align_to_registry(meta: DataFrame, table: DataFrame) -> DataFrame:
    """Registry rows with the table's columns; NULL where it has no row."""
    return meta.join(table, "sample_id", "left")


def align_costs(meta: DataFrame, costs: DataFrame, models: list[str]) -> DataFrame:
    """A cost for every registry sample and model.

    A sample without any cost row gets each model's mean cost; a missing cell
    of a sample that has others stays NULL.  The means are one small map.
    """
    means = costs.groupBy("model_id").agg(F.avg("cost").alias("c")).agg(
        F.map_from_entries(F.collect_list(F.struct("model_id", "c"))).alias("m")).scalar()
    per_sample = costs.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model_id", "cost"))).alias("__costs"))
    return (meta.select("sample_id").join(per_sample, "sample_id", "left")
            .withColumn("__means", means)
            .withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
            .select("sample_id", "model_id",
                    F.when(F.col("__costs").isNull(), F.col("__means")[F.col("model_id")])
                    .otherwise(F.col("__costs")[F.col("model_id")]).alias("cost"),
                    F.col("__costs").isNull().alias("is_mean")))


def assign_splits(scores: DataFrame, splits: DataFrame, samples: DataFrame) -> DataFrame:
    """The registry: first matching split in priority order, ``unknown`` where nothing is known."""
    priority = F.array_position(F.array(*[F.lit(s) for s in V.SPLIT_PRIORITY]), F.col("split"))
    one = splits.groupBy("sample_id").agg(F.min_by("split", priority).alias("split"))
    info = samples.select("sample_id", "dataset", F.col("task_type").alias("task"))
    ids = scores.select("sample_id").distinct()
    return (ids.join(info, "sample_id", "left").join(one, "sample_id", "left")
            .select("sample_id", F.coalesce("dataset", F.lit("unknown")).alias("dataset"),
                    F.coalesce("split", F.lit("unknown")).alias("split"),
                    F.coalesce("task", F.lit("unknown")).alias("task")))


def aligned(meta: DataFrame, embeddings: DataFrame, split: str, outcomes: DataFrame | None = None,
            models: list[str] | None = None) -> DataFrame:
    """Samples of a split that are in the registry and have embeddings; optionally their outcomes."""
    rows = meta.filter(F.col("split") == split).join(embeddings.drop("dataset", "task_type"), "sample_id")
    if outcomes is None:
        return rows
    if models is not None:
        outcomes = outcomes.filter(F.col("model_id").isin(list(models)))
    return rows.join(outcomes, "sample_id")


def hash_splits(samples: DataFrame, seed: int = 42, ratios: dict[str, float] = V.SPLIT_RATIOS) -> DataFrame:
    """A seeded split per sample from its hash alone: no global shuffle, stable as data grows."""
    b = hash_bucket(F.concat(F.lit(f"{seed}|"), F.col("sample_id"))) % 100
    upto, out = 0.0, F
    for name, share in list(ratios.items())[:-1]:
        upto += share
        out = out.when(b < round(upto * 100), F.lit(name))
    return samples.select("sample_id", out.otherwise(F.lit(list(ratios)[-1])).alias("split"))


def cap_first(df: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def cap_random(df: DataFrame, n: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """A repeatable random choice of ``n`` rows without replacement."""
    return df.orderBy(hash_bucket(F.concat(F.lit(f"{seed}|"), F.col(key))), key).limit(n)


def restrict(df: DataFrame, models: list[str], datasets: list[str]) -> DataFrame:
    return df.filter(F.col("model_id").isin(list(models)) & F.col("dataset").isin(list(datasets)))


def ordered_as(df: DataFrame, order: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows in a caller's order (``order`` has key and ``pos``), unlisted keys last by key."""
    return df.join(order, key, "left").orderBy(F.col("pos").asc_nulls_last(), key)
