"""Sample, evidence and model features."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions import vectors as X
from routeyard.functions.scores import clamp, stable_unit
from routeyard.functions.texts import joined_text, query_type, text_stats
from routeyard.operators.labels import is_correct
from routeyard.runtime import finite, once


def with_query_type(rows: DataFrame, name: str = "query_type") -> DataFrame:
    """Add the query type of each row."""
    return rows.withColumn(name, once(query_type(joined_text(rows.columns), F.col("dataset"))))


def vector_moments(df: DataFrame, vec: str, by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each dimension.

    The summarizer keeps one buffer per task, so only dimension-sized state is
    shuffled.
    """
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    agg = df.groupBy(*by).agg(s.alias("s"))
    n = F.col("s.count").cast("double")
    var = vector_to_array(F.col("s.variance"))
    return agg.select(*by, vector_to_array(F.col("s.mean")).alias("mean"),
                      F.transform(var, lambda v: F.sqrt(v * (n - 1) / n)).alias("std"))


def fit_standardizer(df: DataFrame, vec: str, floor: float | None = 1e-6, plus: float = 0.0) -> DataFrame:
    """One row (mean, std).  A deviation under ``floor`` becomes 1; ``plus`` is added to every one."""
    m = vector_moments(df, vec)
    std = F.col("std") if floor is None else F.transform("std", lambda s: F.when(s < floor, 1.0).otherwise(s))
    return m.select("mean", F.transform(std, lambda s: s + F.lit(plus)).alias("std"))


def standardize(df: DataFrame, vec: str, scaler: DataFrame, out: str | None = None) -> DataFrame:
    centred = F.zip_with(F.col(vec), F.col("__mean"), lambda a, b: a - b)
    return (df.withColumn("__mean", scaler.select("mean").scalar())
            .withColumn("__std", scaler.select("std").scalar())
            .withColumn(out or vec, F.zip_with(centred, F.col("__std"), lambda a, b: a / b))
            .drop("__mean", "__std"))


def prototypes(features: DataFrame, outcomes: DataFrame, models: list[str], vec: str = "vec",
               normalize: bool = True) -> DataFrame:
    """Mean vector of the samples each model answers; a model without any gets the overall mean."""
    answered = features.join(outcomes.filter(is_correct()).select("sample_id", "model_id"), "sample_id")
    own = answered.groupBy("model_id").agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"))
    overall = features.agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m")).select(
        vector_to_array("m")).scalar()
    pool = features.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    proto = pool.join(own, "model_id", "left").select(
        "model_id", F.when(F.col("m").isNotNull(), vector_to_array("m")).alias("v"))
    proto = proto.withColumn("v", F.coalesce("v", overall))
    return proto.withColumn("v", X.l2_normalize(F.col("v"))) if normalize else proto


def prototype_scores(features: DataFrame, protos: DataFrame, vec: str = "vec") -> DataFrame:
    """Inner product of each sample with each prototype.

    There is one prototype per model; they travel as one small array, so the
    scoring is a projection.
    """
    packed = protos.agg(F.array_sort(F.collect_list(F.struct("model_id", "v"))).alias("p")).scalar()
    scored = F.transform(F.col("__p"), lambda p: F.struct(p["model_id"].alias("model_id"),
                                                           X.dot(F.col(vec), p["v"]).alias("score")))
    return (features.withColumn("__p", packed).select("sample_id", F.explode(scored).alias("x"))
            .select("sample_id", "x.model_id", "x.score"))


def pool_vectors(pieces: DataFrame, ids: DataFrame, dim: int, pooling: str = "mean",
                 normalize: bool = True) -> DataFrame:
    """One vector per sample from its several vectors; a zero vector where it has none.

    ``pieces`` is (sample_id, position, vec).  Whole vectors are combined before
    the shuffle in one buffer per sample, so a sample with very many stays cheap.
    """
    vector = array_to_vector(X.as_double(F.col("vec")))
    how = {"mean": lambda: vector_to_array(Summarizer.mean(vector)), "max": lambda: vector_to_array(Summarizer.max(vector)),
           "first": lambda: F.min_by("vec", "position")}[pooling]()
    pooled = pieces.groupBy("sample_id").agg(how.alias("v"), F.count(F.lit(1)).alias("n"))
    if normalize:
        unit = F.when((F.col("n") > 1) & (X.norm(F.col("v")) > 0), X.divide(F.col("v"), X.norm(F.col("v"))))
        pooled = pooled.withColumn("v", F.coalesce(unit, "v"))
    return ids.select("sample_id").join(pooled.select("sample_id", "v"), "sample_id", "left").select(
        "sample_id", F.coalesce("v", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def conditioned(kind: Column, f: dict[str, Column]) -> Column:
    """The three distances that describe a query type."""
    out = F
    for name, keys in V.QUERY_CONDITIONED.items():
        if name:
            out = out.when(kind == name, F.array(*[f[k] for k in keys]))
    return out.otherwise(F.array(*[f[k] for k in V.QUERY_CONDITIONED[""]]))


def evidence_features(rows: DataFrame, text_vec: str = "text_vec", image_vec: str = "image_vec") -> DataFrame:
    """Evidence distances of each sample from its vectors and its text.

    A sample without vectors gets repeatable hash values in their place.  The
    row says where its evidence came from.
    """
    text = joined_text(rows.columns)
    base = with_query_type(rows).withColumn("__stats", once(text_stats(text)))
    have = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    v = F.when(have(image_vec), F.col(image_vec)).when(have(text_vec), F.col(text_vec))
    base = base.withColumn("__v", X.l2_normalize(X.as_double(v), 1e-6))
    n = F.size("__v").cast("double")
    unit = lambda salt: stable_unit(F.col("sample_id"), salt)
    fallback = lambda salt: F.lit(0.05) + F.lit(0.10) * unit(salt)
    either = lambda x, y: F.when(F.col("__v").isNotNull(), x).otherwise(y)
    positive = F.size(F.filter("__v", lambda x: x > 0)) / n
    gap = F.lit(1.0) - X.dot(X.l2_normalize(X.head(F.col(text_vec), F.col(image_vec)), 1e-6),
                             X.l2_normalize(X.head(F.col(image_vec), F.col(text_vec)), 1e-6))
    base = base.withColumns({
        "__spread": either(X.std_pop(F.col("__v")) * F.sqrt(n), fallback("spread")),
        "__mean_abs": either(X.mean(F.transform("__v", F.abs)) * F.sqrt(n), fallback("mean_abs")),
        "__diff": either(X.adjacent_gap(F.col("__v")) * F.sqrt(F.greatest(n, F.lit(1.0))), fallback("diff")),
        "__off_half": F.abs(either(positive, F.lit(0.5)) - 0.5),
        "__gap": F.when(have(text_vec) & have(image_vec), gap).otherwise(F.lit(0.0)),
        "__random": unit("random"), "__jitter": F.lit(0.02) * unit("jitter")})
    c = lambda name: F.col(f"__{name}") if f"__{name}" in base.columns else F.col(f"__stats.{name}")
    raw = {name: reduce(add, [w * c(k) for k, w in terms.items()], F.lit(start)) for name, (start, terms) in V.EVIDENCE_TERMS.items()}
    base = base.withColumns(raw)
    base = base.withColumn("__cond", conditioned(F.col("query_type"), {k: F.col(k) for k in raw}))
    base = base.withColumns({"query_cond_mean": X.mean(c("cond")), "query_cond_max": F.array_max(c("cond")),
                             "query_cond_std": X.std_pop(c("cond"))})
    any_vec = have(text_vec) | have(image_vec)
    return base.select(
        "sample_id", "query_type", F.when(any_vec, "embedding").otherwise("metadata").alias("evidence_source"),
        F.lit(0.0).alias("has_image"), any_vec.cast("double").alias("has_embedding"),
        *[clamp(F.col(k)).alias(k) for k in V.EVIDENCE_COLUMNS])


def attach_extras(rows: DataFrame, extras: DataFrame, columns: list[str]) -> DataFrame:
    """Extra numeric features by sample id; absent rows and absent columns are 0."""
    have = [c for c in columns if c in extras.columns]
    joined = rows.join(extras.select("sample_id", *have), "sample_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
                               for c in columns})


def one_hot(kind: Column) -> Column:
    return F.array(*[(kind == q).cast("double") for q in V.QUERY_TYPES])


def sample_features(rows: DataFrame, extras: list[str] = (), include_embeddings: bool = True,
                    include_query_type: bool = True, include_extras: bool = True,
                    random_extras: bool = False, seed: int = 42) -> DataFrame:
    """The feature vector of each sample, with its query type.

    Normalised vectors, their cosine, norms and norm gap, the query-type
    one-hot and extra features; a value that is not finite becomes 0.
    """
    t, v = X.as_double(F.col("text_vec")), X.as_double(F.col("image_vec"))
    base = (with_query_type(rows).withColumn("__tn", X.norm(t)).withColumn("__vn", X.norm(v))
            .withColumn("__t", X.l2_normalize(t)).withColumn("__v", X.l2_normalize(v)))
    blocks = [F.col("__t"), F.col("__v")] if include_embeddings else []
    blocks.append(F.array(X.dot(F.col("__t"), F.col("__v")), F.col("__tn"), F.col("__vn"),
                          F.col("__tn") - F.col("__vn")))
    if include_query_type:
        blocks.append(one_hot(F.col("query_type")))
    if include_extras and extras:
        if random_extras:   # standard normal numbers from two hashed uniforms
            u = lambda c, s: stable_unit(F.col("sample_id"), f"{seed}|{c}|{s}")
            draw = [F.sqrt(-2.0 * F.log(F.greatest(u(c, "a"), F.lit(1e-300))))
                    * F.cos(F.lit(6.283185307179586) * u(c, "b")) for c in extras]
        else:
            draw = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extras]
        blocks.append(F.array(*draw))
    clean = F.transform(F.concat(*blocks), lambda x: F.when(finite(x), x).otherwise(F.lit(0.0)))
    return base.select("sample_id", "query_type", clean.alias("vec"))


def ablation_switches(mode: str) -> tuple[dict, dict]:
    """Feature and profile options of an ablation mode."""
    if mode not in V.ABLATIONS:
        raise ValueError(f"unknown ablation: {mode}")
    sample = {"include_embeddings": mode != "sample_difficulty_only",
              "include_query_type": mode != "no_query_type",
              "include_extras": mode != "no_extra_features",
              "random_extras": mode == "random_extra_features"}
    profile = {"include_query_stats": mode != "no_query_type", "include_cost": mode != "no_cost",
               "constant": mode == "no_model_profile"}
    return sample, profile


def model_profiles(outcomes: DataFrame, types: DataFrame, include_query_stats: bool = True,
                   include_cost: bool = True, constant: bool = False) -> DataFrame:
    """Accuracy and cost per model, overall and per query type, from one grouped pass.

    ``types`` is (sample_id, query_type).  A type a model never met falls back
    to its overall numbers.
    """
    if constant:
        return outcomes.groupBy("model_id").agg(F.array(F.lit(1.0)).alias("profile"))
    cost = F.when(finite("cost"), F.col("cost"))
    kind = F.col("query_type")
    aggs = [F.avg("quality").alias("acc"), F.avg(cost).alias("cost"), F.stddev_pop(cost).alias("std")]
    if include_query_stats:
        for q in V.QUERY_TYPES:
            aggs += [F.avg(F.when(kind == q, F.col("quality"))).alias(f"acc_{q}"),
                     F.avg(F.when(kind == q, cost)).alias(f"cost_{q}")]
    g = outcomes.join(types.select("sample_id", "query_type"), "sample_id").groupBy("model_id").agg(*aggs)
    money = lambda *cs: F.coalesce(*cs, F.lit(0.0)) if include_cost else F.lit(0.0)
    acc = F.coalesce("acc", F.lit(0.0))
    values = [acc, money("cost"), money("std")]
    if include_query_stats:
        for q in V.QUERY_TYPES:
            values += [F.coalesce(F.col(f"acc_{q}"), acc), money(f"cost_{q}", "cost")]
    return g.select("model_id", F.array(*values).alias("profile"))


def heldout_profiles(outcomes: DataFrame, types: DataFrame, seen: list[str], heldout: list[str],
                     calibration: DataFrame | None = None, **switches) -> DataFrame:
    """Profiles for models the policy was not fitted on.

    Held-out models are profiled on the calibration samples, or take the mean
    profile of the seen models.
    """
    full = model_profiles(outcomes, types, **switches).filter(F.col("model_id").isin(list(seen)))
    if calibration is not None:
        few = outcomes.filter(F.col("model_id").isin(list(heldout))).join(
            calibration.select("sample_id"), "sample_id", "left_semi")
        return full.unionByName(model_profiles(few, types, **switches))
    mean = full.select(F.posexplode("profile").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("profile"))
    named = mean.select(F.explode(F.array(*[F.lit(m) for m in heldout])).alias("model_id"), "profile")
    return full.unionByName(named)
