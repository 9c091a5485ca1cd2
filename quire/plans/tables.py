"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sizes import spread as _spread


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread_table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table whose rows take heavy work each."""
    return _spread(table(spark, root, name).select(*columns))
