"""Text encoding with a pluggable encoder, and the encoder registry."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.scores import hash_bucket
from routeyard.functions.vectors import divide, norm
from routeyard.runtime import once, persisted


def encoder_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.ENCODERS), "encoder string, modality string, dimension int, "
                                                   "max_length int, image_size int, patch_size int")


def encoder_dimension(name: str, modality: str) -> int:
    for n, m, dim, *_ in V.ENCODERS:
        if (n, m) == (name, modality):
            return dim
    raise ValueError(f"unknown {modality} encoder: {name}")


def dimension_check(embeddings: DataFrame, name: str, modality: str) -> DataFrame:
    """How many vectors have, and do not have, the registered size."""
    dim = encoder_dimension(name, modality)
    return embeddings.agg(F.count_if(F.size("embedding") == dim).alias("ok"),
                          F.count_if(F.size("embedding") != dim).alias("wrong"))


def hashed_text_vectors(rows: DataFrame, dim: int = 256, text: str = "prompt") -> DataFrame:
    """The built-in encoder: hashed term frequencies, weighted by rarity, of unit length.

    A word's component is ``hash_bucket`` modulo ``dim``; its rarity is
    ln((rows + 1) / (rows with the component + 1)).  Both tables that meet the
    rows have one row per component.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^A-Za-z0-9]+"), lambda w: w != "")
    found = rows.select("sample_id", F.explode(words).alias("w")).select(
        "sample_id", (hash_bucket(F.col("w")) % dim).cast("int").alias("i"))
    counted = found.groupBy("sample_id", "i").agg(F.count(F.lit(1)).alias("tf"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    weights = persisted(counted.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "tf"))).alias("__tf")), "term-counts")      # at most dim entries
    seen = F.map_from_entries(F.collect_list(F.struct("i", "df")))
    rarity = weights.select(F.explode(F.map_keys("__tf")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).agg(
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(seen[i], F.lit(0))).alias("a")).scalar()
    staged = rows.select("sample_id").join(weights, "sample_id", "left").withColumns({"__n": total, "__df": rarity})
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.col("__tf")[i] * F.log((F.col("__n") + 1) / (F.col("__df")[i] + 1)), F.lit(0.0)))
    # the lambda that divides would take the length, and with it every component, again for every component
    sized = staged.select("sample_id", once(raw).alias("__raw")).select("sample_id", "__raw", once(norm(F.col("__raw"))).alias("__size"))
    return sized.select("sample_id", divide(F.col("__raw"), F.greatest(F.col("__size"), F.lit(1e-12))).alias("embedding"))


# Models of this worker process, newest last; two, since a plan seldom uses more encoders at once and models are large.
_MODELS: OrderedDict[str, Callable] = OrderedDict()
_MODELS_KEPT = 2
STEP_BYTES = 1 << 22


def worker_model(key: str, factory: Callable[[], Callable]) -> Callable:
    """What ``factory`` makes, once per worker process and key; tasks that reuse the process reuse it."""
    if key not in _MODELS:
        _MODELS[key] = factory()
        while len(_MODELS) > _MODELS_KEPT:
            _MODELS.popitem(last=False)
    _MODELS.move_to_end(key)
    return _MODELS[key]


def steps(batch: pa.Array) -> Iterator[list]:
    """The values of a batch, as many at a time as take about ``STEP_BYTES``, so long texts don't become objects all at once."""
    rows = max(1, STEP_BYTES * len(batch) // max(1, batch.nbytes))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows).to_pandas().tolist()


def encode(column: Column, factory: Callable[[], Callable[[list], np.ndarray]], normalize: bool = True) -> Column:
    """A user encoder as a column expression.

    ``factory`` runs once per worker process and returns a function from a
    list of inputs to a matrix; Arrow batches stream through it in steps.
    """
    key = uuid.uuid4().hex

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = worker_model(key, factory)
        for batch in batches:
            parts = [pa.array([], pa.list_(pa.float64()))]
            for values in steps(batch):
                m = np.asarray(model(values), dtype="float64")
                if normalize:
                    m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
                parts.append(pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype="int32") * m.shape[1], m.ravel()))
            yield pa.concat_arrays(parts)

    return run(column)


def encode_distinct(rows: DataFrame, column: str, factory: Callable[[], Callable[[list], np.ndarray]], output: str = "embedding",
                    normalize: bool = True) -> DataFrame:
    """``rows`` with the vector of ``column`` as ``output``; every text is encoded once, however many rows hold it.

    Texts meet by their SHA-256, one of each kept before the shuffle; a text
    that many rows hold is a skewed key of a plain join, which adaptive
    execution splits.  The vectors are written once, so rows that are read
    again don't encode again.  A NULL is not encoded and has no vector; equal
    rows stay apart.
    """
    if output in rows.columns:
        raise ValueError(f"there is a column {output} already")
    keyed = rows.withColumn("__text", F.sha2(F.encode(F.col(f"`{column}`"), "UTF-8"), 256))
    texts = keyed.filter("__text IS NOT NULL").groupBy("__text").agg(F.first(f"`{column}`").alias("t"))
    vectors = persisted(texts.select("__text", encode(F.col("t"), factory, normalize).alias(output)), "encoded")
    return keyed.join(vectors, "__text", "left").select(*[F.col(f"`{c}`") for c in rows.columns], output)


def count_tokens(column: Column, factory: Callable[[], Callable[[str], int]]) -> Column:
    """Token counts by a user tokenizer, made once per worker process; NULL and empty text have none."""
    key = uuid.uuid4().hex

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = worker_model(key, factory)
        for batch in batches:
            yield pa.array([tokenizer(t) if t else 0 for values in steps(batch) for t in values], pa.int64())

    return run(F.coalesce(column, F.lit("")))
