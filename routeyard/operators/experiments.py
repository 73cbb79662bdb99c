"""Held-out splits, calibration subsets, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.operators.registry import cap_random


def matches_dataset(dataset: Column, wanted: list[str]) -> Column:
    ds = F.lower(F.coalesce(dataset, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(ds, F.lit(w.lower())) for w in wanted], F.lit(False))


def matches_type(kind: Column, wanted: list[str]) -> Column:
    return F.lower(kind).isin([w.lower() for w in wanted])


def heldout_splits(meta: DataFrame, held: Column) -> DataFrame:
    """Standard splits with the held-out samples kept out of train and dev, and alone in test.

    Where that would empty a side, the side falls back: test takes all held-out
    samples, train and dev keep their standard rows; without any match nothing
    changes.  One small count decides.
    """
    tagged = meta.withColumn("__held", held)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    c = tagged.agg(
        n(F.col("__held")).alias("held"),
        n(F.col("__held") & (F.col("split") == "test")).alias("test"),
        n(~F.col("__held") & (F.col("split") == "train")).alias("train"),
        n(~F.col("__held") & (F.col("split") == "dev")).alias("dev"))
    get = lambda name: c.select(name).scalar()
    tagged = tagged.withColumns({"__n_held": get("held"), "__n_test": get("test"),
                                 "__n_train": get("train"), "__n_dev": get("dev")})
    held, split = F.col("__held"), F.col("split")
    own = (F.when(split == "test", held & (F.col("__n_test") > 0))
           .when(split == "train", ~held | (F.col("__n_train") == 0))
           .when(split == "dev", ~held | (F.col("__n_dev") == 0)).otherwise(F.lit(False)))
    sides = F.array_compact(F.array(
        F.when((F.col("__n_held") == 0) | own, split),
        F.when((F.col("__n_held") > 0) & (F.col("__n_test") == 0) & held, F.lit("test"))))
    return tagged.select("sample_id", F.explode(sides).alias("split"))


def model_split(models: list[str], heldout: list[str] = ()) -> tuple[list[str], list[str]]:
    """(train models, held-out models), matched by index, name or base name.

    No match, or nothing left to train on, gives all models for training.
    """
    wanted = {h.lower() for h in heldout}
    out = [m for i, m in enumerate(models)
           if wanted & {str(i), m.lower(), m.split("/")[-1].lower()}]
    rest = [m for m in models if m not in out]
    return (rest, out) if rest else (list(models), [])


def calibration_subset(train: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """A repeatable choice of ``size`` training samples."""
    return cap_random(train, max(size, 0), seed)


def query_type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))
