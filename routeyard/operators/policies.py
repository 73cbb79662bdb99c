"""Routing policies that need no features (R1-R5) and prototype routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard.functions.scores import hash_bucket
from routeyard.operators.features import fit_standardizer, prototype_scores, prototypes, standardize
from routeyard.operators.labels import argmax, hard_labels, oracle_route, softmax, solvable
from routeyard.operators.neighbors import nearest, pairwise_wins, preference_probabilities, preference_scores, vote_shares
from routeyard.functions.vectors import l2_normalize
from routeyard.operators.policy import Policy, read_settings, write_tables
from routeyard.runtime import finite, persisted


def _global_pick(samples: DataFrame, outcomes: DataFrame, value: Column) -> DataFrame:
    """One model for all samples, as a scalar subquery over per-model means; a model without a mean comes last."""
    per_model = outcomes.groupBy("model_id").agg(value.alias("s"))
    key = F.struct(F.col("s").isNull().alias("none"), F.col("s"), F.col("model_id"))
    best = per_model.agg(F.min_by("model_id", key).alias("m")).scalar()
    return samples.select("sample_id", best.alias("model_id"))


def strongest_global(samples: DataFrame, fit: DataFrame) -> DataFrame:
    return _global_pick(samples, fit, -F.avg("quality"))


def cheapest_global(samples: DataFrame, fit: DataFrame) -> DataFrame:
    return _global_pick(samples, fit, F.avg(F.when(finite("cost"), F.col("cost"))))


def dataset_champions(fit: DataFrame, meta: DataFrame) -> DataFrame:
    """The most accurate model of each dataset; (dataset, model) pairs are averaged first."""
    acc = (fit.join(meta.select("sample_id", "dataset"), "sample_id")
           .groupBy("dataset", "model_id").agg(F.avg("quality").alias("a")))
    return acc.groupBy("dataset").agg(
        F.min_by("model_id", F.struct(F.col("a").isNull(), -F.col("a"), F.col("model_id"))).alias("model_id"))


def strongest_per_dataset(samples: DataFrame, fit: DataFrame, meta: DataFrame) -> DataFrame:
    """The champion of the sample's dataset; an unseen dataset takes the first dataset's champion."""
    champions = dataset_champions(fit, meta)
    first = champions.agg(F.min_by("model_id", "dataset").alias("m")).scalar()
    # one champion per dataset: adaptive execution broadcasts them or splits the large datasets
    joined = samples.select("sample_id", "dataset").join(champions, "dataset", "left")
    return joined.select("sample_id", F.coalesce("model_id", first).alias("model_id"))


def random_model(models: list[str], seed: int = 42) -> Column:
    """A repeatable random model for the row's sample."""
    pool = F.array(*[F.lit(m) for m in models])
    i = hash_bucket(F.concat(F.col("sample_id"), F.lit(f"|{seed}"))) % len(models)
    return F.element_at(pool, i.cast("int") + 1)


def random_route(samples: DataFrame, models: list[str], seed: int = 42) -> DataFrame:
    return samples.select("sample_id", random_model(models, seed).alias("model_id"))


def oracle(outcomes: DataFrame) -> DataFrame:
    return oracle_route(outcomes).select("sample_id", "model_id")


class PrototypePolicy(Policy):
    """Cosine routing to the mean vector of the samples each model answers."""

    def __init__(self, models: list[str], normalize: bool = True):
        self.models, self.normalize = models, normalize

    def fit(self, outcomes: DataFrame, features: DataFrame, meta: DataFrame | None = None) -> "PrototypePolicy":
        kept = solvable(outcomes)
        rows = features.join(kept.select("sample_id").distinct(), "sample_id", "left_semi")
        self.scaler = persisted(fit_standardizer(rows, "vec", floor=1e-12), "scaler")
        self.protos = persisted(prototypes(self._space(rows), kept, self.models, normalize=self.normalize), "prototypes")
        return self

    def _space(self, rows: DataFrame) -> DataFrame:
        z = standardize(rows, "vec", self.scaler)
        return z.withColumn("vec", l2_normalize(F.col("vec"))) if self.normalize else z

    def scores(self, features: DataFrame) -> DataFrame:
        return prototype_scores(self._space(features), self.protos)

    def probabilities(self, features: DataFrame) -> DataFrame:
        return softmax(self.scores(features))

    def route(self, features: DataFrame) -> DataFrame:
        return argmax(self.scores(features))

    def save(self, path: str) -> None:
        write_tables(path, {"scaler": self.scaler, "prototypes": self.protos},
                     {"models": self.models, "normalize": self.normalize})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PrototypePolicy":
        out = cls(**read_settings(spark, path))
        out.scaler, out.protos = spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/prototypes")
        return out


class KnnPolicy(Policy):
    """Vote of the nearest training samples' hard labels, in standardised feature space."""

    def __init__(self, k: int = 5, metric: str = "cosine", weights: str = "distance"):
        self.k, self.metric, self.weights = k, metric, weights

    def fit(self, outcomes: DataFrame, features: DataFrame, meta: DataFrame | None = None) -> "KnnPolicy":
        kept = solvable(outcomes)
        rows = features.join(kept.select("sample_id").distinct(), "sample_id", "left_semi")
        self.scaler = persisted(fit_standardizer(rows, "vec", floor=1e-12), "scaler")
        self.train = standardize(rows, "vec", self.scaler)
        self.memory = self._remember(kept)
        return self

    def _remember(self, kept: DataFrame) -> DataFrame:
        return hard_labels(kept, "drop")

    def neighbors(self, features: DataFrame) -> DataFrame:
        return nearest(standardize(features, "vec", self.scaler), self.train, self.k, self.metric)

    def scores(self, features: DataFrame) -> DataFrame:
        return vote_shares(self.neighbors(features), self.memory, self.weights)

    def probabilities(self, features: DataFrame) -> DataFrame:
        return self.scores(features).withColumnRenamed("score", "probability")

    def route(self, features: DataFrame) -> DataFrame:
        return argmax(self.scores(features))

    def save(self, path: str) -> None:
        write_tables(path, {"scaler": self.scaler, "train": self.train, "memory": self.memory},
                     {"k": self.k, "metric": self.metric, "weights": self.weights})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KnnPolicy":
        out = cls(**read_settings(spark, path))
        out.scaler, out.train, out.memory = (spark.read.parquet(f"{path}/{n}") for n in ("scaler", "train", "memory"))
        return out


class PreferenceKnnPolicy(KnnPolicy):
    """Weighted pairwise wins over the nearest training samples instead of one label each."""

    def _remember(self, kept: DataFrame) -> DataFrame:
        return pairwise_wins(kept)

    def scores(self, features: DataFrame) -> DataFrame:
        return preference_scores(self.neighbors(features), self.memory, self.weights)

    def probabilities(self, features: DataFrame) -> DataFrame:
        return preference_probabilities(self.scores(features))
