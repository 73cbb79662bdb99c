"""Session helpers: shared scratch space and small expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
PORTIONS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="routeyard-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later jobs read, and read it back.

    The copy lives in the shared folder, so it survives lost executors and
    cuts the lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when their query ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def portions(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Write a table once, like ``persisted``, and read it back a share of its files at a time.

    A share is deleted when the next one is asked for, so a table that is
    copied share by share never lies on disk beside its whole copies.  There
    are ``PORTIONS`` shares at most, each of a file per core at least.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    files = [f"{path}/{n}" for n in names if n.startswith("part-")]
    count = max(1, min(PORTIONS, len(files) // spark.sparkContext.defaultParallelism))
    for i in range(count):
        share = files[i::count]
        yield spark.read.schema(df.schema).parquet(*(share or [path]))
        for f in share:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f), False)


def once(value: Column) -> Column:
    """A costly expression that Spark shall evaluate once per row.

    A plain projection may be evaluated again for every match of a later join
    or for every use of the column; the output of a generator is not.  Use it
    as a column of ``select`` or ``withColumn``; it keeps the row count.
    """
    return F.explode(F.array(value))


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer pieces than there are cores.

    Meant for costly per-row work on text.  A table with at least one piece
    per core, which is every large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """A stored table dealt evenly over at least as many tasks as there are cores, for fits that pass over it many times.

    A small Parquet file is cut into pieces by its bytes, but all rows of a row group come in one of them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
