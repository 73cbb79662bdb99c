"""What every routing policy offers (X1, X2): fit on history, route samples, save and load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Policy:
    """A routing policy: ``fit`` on history, then ``route`` samples to models.

    User-defined policies implement the same methods.
    """

    def fit(self, outcomes: DataFrame, features: DataFrame, meta: DataFrame | None = None) -> "Policy":
        raise NotImplementedError

    def route(self, features: DataFrame) -> DataFrame:
        """Decisions (sample_id, model_id)."""
        raise NotImplementedError

    def name(self) -> str:
        return type(self).__name__

    def save(self, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Policy":
        raise NotImplementedError


def write_tables(path: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """The tables as Parquet under ``path``, the settings as one JSON line."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/settings")


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/settings").first()[0])
