"""Run the batch upsert for every new file of a folder.

There is no event time and no late-data rule: each micro-batch is an upsert into the current cache.  The cache lies in buckets
by a hash of the key.  A batch reads and writes only the buckets that it meets, so its cost follows the batch; a manifest
per generation names, for every bucket, the generation that wrote it last.

    {cache}/data/v3/bucket=17/part-....parquet      the rows of bucket 17 as generation 3 left them
    {cache}/manifest/v3                              (bucket, version) of generation 3

A manifest is written after its data and by an atomic commit, so a reader sees a whole generation or the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from routeyard.operators.registry import upsert
from routeyard.runtime import persisted

# Rows of the manifest and of what a batch tells the driver; at 100 TB choose it so that a bucket is about 1 GB.
BUCKETS = 256


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, cache: str, version: int) -> dict[int, int] | None:
    """Bucket to version, or None where the generation isn't complete."""
    files, done = _files(spark, f"{cache}/manifest/v{version}/_SUCCESS")
    if not files.exists(done):
        return None
    rows = spark.read.schema("bucket int, version int").parquet(f"{cache}/manifest/v{version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, cache: str, buckets: dict[int, int], schema) -> DataFrame:
    paths = [f"{cache}/data/v{v}/bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def generations(spark: SparkSession, cache: str) -> list[int]:
    """The complete generations that can be read: the last one and the one before."""
    files, folder = _files(spark, f"{cache}/manifest")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    found = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
    return [v for v in found if _manifest(spark, cache, v) is not None]


def read_cache(spark: SparkSession, cache: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a generation, by default the last; an absent cache is empty."""
    if version is None:
        version = max(generations(spark, cache), default=0)
    return _read(spark, cache, _manifest(spark, cache, version) or {}, schema)


def _forget(spark: SparkSession, cache: str, version: int, kept: list[dict[int, int]]) -> None:
    """Delete the buckets that only generation ``version`` names, then its manifest; doing so again changes nothing."""
    old = _manifest(spark, cache, version) or {}
    for bucket, written in old.items():
        if all(m.get(bucket) != written for m in kept):
            files, path = _files(spark, f"{cache}/data/v{written}/bucket={bucket}")
            files.delete(path, True)
    files, path = _files(spark, f"{cache}/manifest/v{version}")
    files.delete(path, True)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_batch(spark: SparkSession, fresh: DataFrame, cache: str, n: int, keys: list[str] = ("sample_id",), order: list[str] = (),
                start: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Generation ``n + 1`` of the cache: generation ``n`` with the fresh rows upserted.

    Only generation ``n + 1`` is written, so a batch that is run again replaces its own output only.  ``start`` is merged with
    batch 0 and is dealt into buckets as a whole.  A null key is a key like others.  Generations before ``n`` are deleted.
    The number of buckets is fixed when a cache is begun.
    """
    keys, schema = list(keys), fresh.schema
    before = _manifest(spark, cache, n) if n else {}
    if before is None:
        raise ValueError(f"generation {n} of {cache} is missing or was begun and not ended")
    fresh = persisted(fresh.withColumn("bucket", _bucket(keys, buckets)), "batch")
    if n == 0 and start is not None:
        old = start.select(*schema.names)
        hit = list(range(buckets))
    else:
        hit = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]        # one row per bucket at most
        old = _read(spark, cache, {b: before[b] for b in hit if b in before}, schema)
    merged = upsert(old, fresh.drop("bucket"), keys, order).withColumn("bucket", _bucket(keys, buckets))
    path = f"{cache}/data/v{n + 1}"
    merged.repartition(max(1, len(hit)), "bucket").write.partitionBy("bucket").option(
        "partitionOverwriteMode", "static").mode("overwrite").parquet(path)
    # what was written, not what was hit: a start may leave buckets empty
    files, folder = _files(spark, path)
    written = [int(s.getPath().getName()[7:]) for s in files.listStatus(folder) if s.getPath().getName().startswith("bucket=")]
    after = {**before, **{b: n + 1 for b in written}}
    rows = spark.createDataFrame(sorted(after.items()), "bucket int, version int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{cache}/manifest/v{n + 1}")
    if n > 1:
        _forget(spark, cache, n - 1, [before, after])


def upsert_stream(spark: SparkSession, source: str, schema: str, cache: str, checkpoint: str,
                  keys: list[str] = ("sample_id",),
                  prepare: Callable[[DataFrame], DataFrame] | None = None,
                  start: str | None = None, order: list[str] = (), buckets: int = BUCKETS,
                  files_per_batch: int | None = None) -> StreamingQuery:
    """Process all files that are new since the last run, then stop; ``read_cache`` gives the rows.

    The first batch is merged into the table at ``start``, if one is given.  Of several fresh rows of a key the last in
    ``order`` wins.
    """
    def merge(batch: DataFrame, n: int) -> None:
        fresh = batch if prepare is None else prepare(batch)
        first = spark.read.schema(fresh.schema).parquet(start) if start is not None and n == 0 else None
        merge_batch(spark, fresh, cache, n, keys, order, first, buckets)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.parquet(source).writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
