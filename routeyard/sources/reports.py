"""CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeyard.runtime import finite


def fixed_decimals(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as text with a fixed number of decimals."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).alias(c)
                       if c in floats else F.col(c) for c in df.columns])


def write_csv_report(df: DataFrame, path: str, columns: list[str] | None = None, digits: int = 6) -> None:
    fixed_decimals(df.select(*columns) if columns else df, digits).write.option("header", True).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(finite(c), c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        return F.transform(c, lambda x: F.when(finite(x), x))
    return c


def jsonable(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, which JSON can carry."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_json_report(df: DataFrame, path: str) -> None:
    jsonable(df).write.option("ignoreNullFields", False).json(path)
