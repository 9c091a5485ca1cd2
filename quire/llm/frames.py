"""Small DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for every row, and the number's column; written once, so every read gives a row the same."""
    key = fresh(df, "row_key")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def dealt(df: DataFrame) -> int:
    """How many buckets to deal packed rows into: as many as the scan has
    splits, so a bucket's size stays what a split's is, and no fewer than the
    session's shuffle partitions."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
