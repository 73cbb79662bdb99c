"""Learned policies on pyspark.ml.

A policy is fitted on ``outcomes`` and ``features`` and yields decisions; it
saves itself as ML models and Parquet tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard.functions.scores import normalize_cost
from routeyard.functions.vectors import dot, euclidean
from routeyard.operators.block_fits import (RiskFit, coefficients, design, exploded_risks, fit_heads, fit_risks,
                                             fitted_models, risk_scores)
from routeyard.operators.features import fit_standardizer, model_profiles, one_hot, standardize
from routeyard.operators.labels import argmax, argmin, hard_labels, is_correct, soft_targets, solvable
from routeyard.operators.perceptron import fit_soft
from routeyard.operators.policy import Policy, read_settings, write_tables
from routeyard.runtime import dealt, finite, persisted


class ConstantPolicy(Policy):
    """The most accurate model for everything; the smallest example of a policy."""

    def fit(self, outcomes, features=None, meta=None):
        self.best = outcomes.groupBy("model_id").agg(F.avg("quality").alias("a")).agg(
            F.min_by("model_id", F.struct(-F.col("a"), F.col("model_id"))).alias("model_id"))
        return self

    def route(self, features):
        return features.select("sample_id", self.best.select("model_id").scalar().alias("model_id"))

    def save(self, path: str) -> None:
        self.best.write.mode("overwrite").parquet(f"{path}/best")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ConstantPolicy":
        out = cls()
        out.best = spark.read.parquet(f"{path}/best")
        return out


class _FeaturePolicy(Policy):
    """Shared parts of policies over one standardised feature vector."""

    def __init__(self, models: list[str]):
        self.models = list(models)

    def _training(self, outcomes: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = solvable(outcomes)
        rows = features.join(kept.select("sample_id").distinct(), "sample_id", "left_semi")
        self.scaler = persisted(fit_standardizer(rows, "vec", floor=1e-12), "scaler")
        return kept, self._vectors(rows)

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return standardize(rows, "vec", self.scaler).select("sample_id", array_to_vector("vec").alias("features"))

    def _index(self) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in self.models]), F.col("model_id")).cast("double") - 1

    def _exploded(self, probabilities: Column) -> Column:
        names = F.array(*[F.lit(m) for m in self.models])
        return F.explode(F.zip_with(names, probabilities, lambda m, p: F.struct(
            m.alias("model_id"), F.coalesce(p, F.lit(0.0)).alias("score"))))

    def scores(self, features: DataFrame) -> DataFrame:
        raise NotImplementedError

    def route(self, features: DataFrame) -> DataFrame:
        return argmax(self.scores(features))


class OneVsRestPolicy(_FeaturePolicy):
    """One balanced logistic head per model for P(correct); every step of all heads is one pass over one table."""

    def __init__(self, models: list[str], reg: float = 1e-3, tol: float = 1e-9):
        super().__init__(models)
        self.reg, self.tol = reg, tol

    def fit(self, outcomes, features, meta=None):
        kept, _ = self._training(outcomes, features)
        rows = standardize(features, "vec", self.scaler).withColumn("query_type", F.lit(None).cast("string"))
        table = design(rows, kept, is_correct(), self.models, [F.lit(1.0)], "heads")
        heads, _ = fit_heads(table, self.reg, self.tol)
        self.heads = persisted(features.sparkSession.createDataFrame(
            [(m, i - 1, float(x)) for m, head in zip(self.models, heads) for i, x in enumerate(np.roll(head, 1))],
            "model_id string, dim int, value double"), "heads")
        return self

    def scores(self, features):
        """Probabilities; ``heads`` has a row per model and dimension, -1 being the intercept."""
        by = {m: [] for m in self.models}
        for r in self.heads.orderBy("model_id", "dim").collect():
            by[r["model_id"]].append(r["value"])
        z = [dot(F.col("vec"), F.array(*[F.lit(x) for x in by[m][1:]])) + F.lit(by[m][0]) for m in self.models]
        scored = standardize(features, "vec", self.scaler).select("sample_id", F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) for x in z]).alias("p"))
        return scored.select("sample_id", self._exploded(F.col("p")).alias("x")).select("sample_id", "x.*")

    def save(self, path: str) -> None:
        write_tables(path, {"scaler": self.scaler, "heads": self.heads}, {"models": self.models})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OneVsRestPolicy":
        out = cls(read_settings(spark, path)["models"])
        out.scaler, out.heads = spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/heads")
        return out


class LinearPolicy(_FeaturePolicy):
    """Multinomial logistic regression on the hard label, or on soft targets.

    A soft target becomes one weighted row per (sample, model), whose loss is
    the soft cross-entropy.
    """

    def __init__(self, models: list[str], lam: float | None = None, cost_scale: float = 100.0,
                 max_iter: int = 200, reg: float = 1e-3, l1: float = 0.0, tol: float = 1e-6):
        super().__init__(models)
        self.lam, self.cost_scale, self.max_iter, self.reg, self.l1 = lam, cost_scale, max_iter, reg, l1
        self.tol = tol

    def fit(self, outcomes, features, meta=None):
        kept, rows = self._training(outcomes, features)
        targets = soft_targets(kept, self.lam, cost_scale=self.cost_scale).filter("target > 0")
        train = persisted(rows.join(targets, "sample_id").withColumn("label", self._index()), "linear")
        # a zero-weight row of the last model fixes the number of classes
        classes = train.limit(1).withColumn("label", F.lit(float(len(self.models) - 1))).withColumn("target", F.lit(0.0))
        self.model = LogisticRegression(
            family="multinomial", maxIter=self.max_iter, regParam=self.reg, elasticNetParam=self.l1,
            weightCol="target", tol=self.tol, standardization=False).fit(train.unionByName(classes))
        return self

    def scores(self, features):
        p = vector_to_array("probability")
        return (self.model.transform(self._vectors(features)).select("sample_id", self._exploded(p).alias("x"))
                .select("sample_id", "x.*"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_tables(path, {"scaler": self.scaler}, {"models": self.models})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearPolicy":
        out = cls(read_settings(spark, path)["models"])
        out.model = LogisticRegressionModel.load(f"{path}/model")
        out.scaler = spark.read.parquet(f"{path}/scaler")
        return out


class MlpPolicy(_FeaturePolicy):
    """A small perceptron on the hard label, or on the whole soft targets by their cross-entropy."""

    def __init__(self, models: list[str], hidden: tuple[int, ...] = (256,), lam: float | None = None,
                 cost_scale: float = 100.0, max_iter: int = 300, seed: int = 42):
        super().__init__(models)
        self.hidden, self.lam, self.cost_scale, self.max_iter, self.seed = hidden, lam, cost_scale, max_iter, seed

    def fit(self, outcomes, features, meta=None):
        kept, rows = self._training(outcomes, features)
        dim = self.scaler.select(F.size("mean")).first()[0]
        layers = [dim, *self.hidden, len(self.models)]
        learner = MultilayerPerceptronClassifier(layers=layers, maxIter=self.max_iter, seed=self.seed)
        if self.lam is None:
            train = persisted(rows.join(hard_labels(kept, "drop"), "sample_id").withColumn("label", self._index()), "mlp")
            self.model = learner.fit(dealt(train.select("features", "label")))
            return self
        targets = soft_targets(kept, self.lam, cost_scale=self.cost_scale)
        plain = rows.select("sample_id", F.lit(None).cast("string").alias("query_type"), vector_to_array("features").alias("vec"))
        table = design(plain, targets, F.col("target"), self.models, [F.lit(1.0)], "mlp")
        weights, self.losses = fit_soft(table, table.count(), layers, self.seed, self.max_iter)
        # a classifier that starts at the weights and takes no step scores, saves and loads them
        one = table.limit(1).select(array_to_vector("x").alias("features"), F.lit(float(len(self.models) - 1)).alias("label"))
        self.model = learner.copy({learner.maxIter: 0, learner.initialWeights: DenseVector(weights)}).fit(one)
        return self

    def scores(self, features):
        p = vector_to_array("probability")
        return (self.model.transform(self._vectors(features)).select("sample_id", self._exploded(p).alias("x"))
                .select("sample_id", "x.*"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_tables(path, {"scaler": self.scaler}, {"models": self.models})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MlpPolicy":
        out = cls(read_settings(spark, path)["models"])
        out.model = MultilayerPerceptronClassificationModel.load(f"{path}/model")
        out.scaler = spark.read.parquet(f"{path}/scaler")
        return out


class RiskPolicy(Policy):
    """Pairwise failure risk from sample features, model profile and their interaction.

    Routing takes the smallest risk plus lambda times normalised cost, so one
    fit serves every lambda.  ``route`` uses each model's mean cost of the
    history; ``route_scores`` takes the costs of the samples themselves.
    """

    def __init__(self, learner: str = "logistic", max_iter: int = 100, reg: float = 1e-3, seed: int = 42,
                 lam: float = 0.0, tol: float = 1e-9):
        # the logistic fit ends at its tolerance; trees have no such end, so their number is the setting
        self.learner, self.max_iter, self.reg, self.seed, self.lam, self.tol = learner, max_iter, reg, seed, lam, tol

    def _pairs(self, samples: DataFrame, profiles: DataFrame) -> DataFrame:
        """Samples times profiles; the profiles (one per model) travel as one small array."""
        packed = standardize(profiles, "profile", self.profile_scaler).agg(
            F.array_sort(F.collect_list(F.struct("model_id", "profile"))).alias("p")).scalar()
        kind = one_hot(F.col("query_type"))
        pairs = (standardize(samples, "vec", self.sample_scaler).withColumn("__p", packed)
                 .withColumn("__k", kind).withColumn("__m", F.explode("__p")))
        crossed = F.flatten(F.transform("__k", lambda k: F.transform(F.col("__m")["profile"], lambda x: k * x)))
        return pairs.select("sample_id", F.col("__m")["model_id"].alias("model_id"), array_to_vector(
            F.concat("vec", F.col("__m")["profile"], crossed)).alias("features"))

    def fit(self, outcomes, features, meta=None):
        """``features`` is (sample_id, query_type, vec); ``meta`` the profiles (model_id, profile), by default those
        of the history."""
        samples, profiles = features, meta
        if profiles is None:
            profiles = model_profiles(outcomes, samples.select("sample_id", "query_type"))
        self.costs = persisted(outcomes.groupBy("model_id").agg(
            F.avg(F.when(finite("cost"), F.col("cost"))).alias("cost")), "model-costs")
        rows = samples.join(outcomes.select("sample_id").distinct(), "sample_id", "left_semi")
        self.sample_scaler = persisted(fit_standardizer(rows, "vec"), "sample-scaler")
        self.profile_scaler = persisted(fit_standardizer(profiles, "profile"), "profile-scaler")
        self.profiles = persisted(profiles, "profiles")
        if self.learner == "gbt":
            train = persisted(self._pairs(rows, self.profiles).join(
                outcomes.select("sample_id", "model_id", (F.lit(1) - F.col("quality")).cast("double").alias("label")),
                ["sample_id", "model_id"]), "pairs")
            self.model = GBTClassifier(maxIter=self.max_iter, maxDepth=4, seed=self.seed).fit(train)
            return self
        models, matrix = self._matrix(self.profiles)
        table = design(standardize(rows, "vec", self.sample_scaler), outcomes, F.lit(1) - F.col("quality"), models, [F.lit(1.0)], "pairs")
        self.model = fit_risks(table, [RiskFit(matrix)], self.reg, self.tol)[0]
        return self

    def _matrix(self, profiles: DataFrame) -> tuple[list[str], np.ndarray]:
        """Standardised profiles, one row per model."""
        rows = standardize(profiles, "profile", self.profile_scaler).orderBy("model_id").collect()
        return [r["model_id"] for r in rows], np.array([r["profile"] for r in rows])

    def _logistic_risks(self, samples: DataFrame, profiles: DataFrame) -> DataFrame:
        models, matrix = self._matrix(profiles)
        scored = risk_scores(standardize(samples, "vec", self.sample_scaler), [(self.model, matrix)], models)
        return exploded_risks(scored, models)

    def risks(self, samples: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
        profiles = self.profiles if profiles is None else profiles
        if self.learner == "logistic":
            return self._logistic_risks(samples, profiles)
        pairs = self._pairs(samples, profiles)
        return self.model.transform(pairs).select(
            "sample_id", "model_id", F.element_at(vector_to_array("probability"), 2).alias("risk"))

    def route(self, features):
        low, high = (self.costs.agg(f("cost").alias("c")).scalar() for f in (F.min, F.max))
        scored = (self.risks(features).join(F.broadcast(self.costs), "model_id", "left")      # one row per model
                  .withColumns({"__low": low, "__high": high}))
        price = normalize_cost(F.col("cost"), F.col("__low"), F.col("__high"))
        return argmin(scored.withColumn("score", F.col("risk") + F.lit(float(self.lam)) * price), "score")

    _TABLES = ("sample_scaler", "profile_scaler", "profiles", "costs")

    def save(self, path: str) -> None:
        tables = {n: getattr(self, n) for n in self._TABLES}
        if self.learner == "gbt":
            self.model.write().overwrite().save(f"{path}/model")
        else:
            tables["coefficients"] = coefficients(self.profiles.sparkSession, [self.model])
        write_tables(path, tables, {"learner": self.learner, "lam": self.lam})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskPolicy":
        stored = read_settings(spark, path)
        out = cls(stored["learner"], lam=stored["lam"])
        out.model = (GBTClassificationModel.load(f"{path}/model") if out.learner == "gbt"
                     else fitted_models(spark.read.parquet(f"{path}/coefficients"))[0])
        for name in cls._TABLES:
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out


def route_scores(risks: DataFrame, outcomes: DataFrame, cmin: Column, cmax: Column,
                 lambdas: list[float], use_cost: bool = True) -> DataFrame:
    """Risk plus lambda times normalised cost, for every lambda at once."""
    pairs = risks.join(outcomes.select("sample_id", "model_id", "quality", "cost"), ["sample_id", "model_id"])
    weight = F.col("lambda_cost") if use_cost else F.lit(0.0)
    pairs = pairs.withColumns({"__cmin": cmin, "__cmax": cmax})
    return (pairs.withColumn("normalized_cost", normalize_cost(F.col("cost"), F.col("__cmin"), F.col("__cmax")))
            .drop("__cmin", "__cmax")
            .withColumn("lambda_cost", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
            .withColumn("route_score", F.col("risk") + weight * F.col("normalized_cost")))


def risk_route(scored: DataFrame) -> DataFrame:
    """The model with the smallest route score per (lambda, sample), with its numbers."""
    first = F.min_by(F.struct("model_id", "quality", "cost", "risk", "normalized_cost", "route_score"),
                     F.struct("route_score", "model_id"))
    return scored.groupBy("lambda_cost", "sample_id").agg(first.alias("b")).select("lambda_cost", "sample_id", "b.*")


def behaviours(targets: DataFrame, models: list[str]) -> DataFrame:
    """(sample_id, vec): a sample's target for every model in order of ``models``, 0 where it has none."""
    wide = targets.groupBy("sample_id").pivot("model_id", models).agg(F.first("target"))
    return wide.select("sample_id", F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in models]).alias("vec"))


def nearest_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``rows`` with the cluster whose centre is nearest to ``vec``; distances are compared at nine digits, ties go to the first."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre")))).scalar()      # clusters × models numbers
    near = F.array_min(F.transform("__centres", lambda c: F.struct(
        F.round(euclidean(F.col("vec"), c["centre"]), 9).alias("d"), c["cluster"].alias("cluster"))))
    return rows.withColumn("__centres", packed).withColumn("cluster", near["cluster"]).drop("__centres")


def cluster_centres(targets: DataFrame, models: list[str], k: int = 5, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """(cluster, centre) of k-means over the samples' targets, stored.

    Spark's fit ends once its centres hardly move.  From there whole steps
    follow until every centre is the mean of the samples nearest to it, by the
    very rule that assigns samples later; each is one pass that sends clusters
    × models numbers.  A cluster that loses its last sample keeps its centre.
    Tables without rows have no centres.
    """
    spark = targets.sparkSession
    train = persisted(behaviours(targets, models), "behaviours")
    schema = "cluster int, centre array<double>"
    if train.isEmpty():
        return spark.createDataFrame([], schema)
    start = KMeans(k=k, seed=seed, maxIter=max_iter).fit(train.select(array_to_vector("vec").alias("features")))
    centres = np.array(start.clusterCenters())
    for _ in range(max_iter):
        frame = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], schema)
        means = nearest_centre(train, frame).groupBy("cluster").agg(
            vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean")).collect()
        moved = centres.copy()
        for r in means:
            moved[r["cluster"]] = r["mean"]
        step, centres = np.abs(moved - centres).max(), moved
        if step < 1e-12:
            break
    return persisted(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], schema), "centres")


def behaviour_clusters(targets: DataFrame, models: list[str], k: int = 5, seed: int = 42,
                       assign: DataFrame | None = None) -> DataFrame:
    """k-means clusters of samples by which models serve them; fitted on ``targets``."""
    rows = behaviours(targets if assign is None else assign, models)
    return nearest_centre(rows, cluster_centres(targets, models, k, seed)).select("sample_id", "cluster")
