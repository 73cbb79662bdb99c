"""Prices, model pool, dataset names and cost bounds from configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.operators.costs import finite_cost_bounds


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def load_prices(path: str) -> dict[str, tuple[float, float]]:
    """Input and output price of each token-priced model.

    A configuration file is a driver-side setting with one entry per model.
    """
    entries = _yaml(path).get("pricing", {})
    return {m: (float(p.get("input_price_per_1m", 0)), float(p.get("output_price_per_1m", 0)))
            for m, p in entries.items() if p.get("type") == "token_based"}


def token_prices(pricing: DataFrame) -> DataFrame:
    """The same rule on a pricing table."""
    return pricing.filter(F.col("type") == "token_based").select("model_id", "input_price", "output_price")


def load_models(path: str | None = None, exclude: list[str] = (), count: int | None = None) -> list[str]:
    """The model pool: YAML with ``models``, JSON with ``models`` of ``name``s, or a text file of one name per line.

    Where the file can't be read it is ``model_{i}`` for a given ``count``,
    else the default pool.
    """
    pool = list(V.DEFAULT_MODELS) if count is None else [f"model_{i}" for i in range(count)]
    if path is not None:
        try:
            pool = _names(path)
        except (OSError, KeyError):
            pass
    return [m for m in pool if m not in set(exclude)]


def _names(path: str) -> list[str]:
    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as handle:
            return [line.strip() for line in handle if line.strip()]
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as handle:
            return [m["name"] for m in json.load(handle)["models"]]
    return list(_yaml(path)["models"])


def model_pool(models: DataFrame, excluded: DataFrame) -> DataFrame:
    """The pool as a table, without the excluded models; a missing name is ``model_{i}``."""
    named = models.withColumn("model_id", F.coalesce(
        F.nullif(F.trim("model_id"), F.lit("")), F.concat(F.lit("model_"), F.col("model_idx").cast("string"))))
    return named.join(excluded, "model_id", "left_anti")


def model_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, model_id) from a model configuration."""
    rows = [(a, m) for m, e in _yaml(path).get("models", {}).items() for a in e.get("aliases", [m])]
    return spark.createDataFrame(rows, "alias string, model_id string")


def write_bounds(bounds: DataFrame, path: str) -> None:
    bounds.coalesce(1).write.json(path)


def read_bounds(spark: SparkSession, path: str | None, outcomes: DataFrame) -> DataFrame:
    """Stored bounds, else bounds of the finite costs."""
    if path is not None:
        from routeyard.sources.tables import _exists

        if _exists(spark, path):
            return spark.read.schema("cmin double, cmax double").json(path).select("cmin", "cmax")
    return finite_cost_bounds(outcomes)
