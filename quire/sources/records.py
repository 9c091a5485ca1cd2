"""One JSON document a file, its collection and key taken from the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PATH = r"([^/]+)/([^/]+)\.json$"


def scan_records(spark: SparkSession, path: str, schema: str, pattern: str = PATH) -> DataFrame:
    """(collection, rkey, value): ``pattern`` finds the two in a file's path."""
    held = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
        .select("value", F.col("_metadata.file_path").alias("_path"))
    )
    return held.select(
        F.regexp_extract("_path", pattern, 1).alias("collection"),
        F.regexp_extract("_path", pattern, 2).alias("rkey"),
        F.from_json("value", schema).alias("value"),
    )


def record_violations(records: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row a broken rule: each rule is a condition that should not hold."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return records.select(*keep, F.explode(broken).alias("violation"))


def too_long(text: Column, limit: int) -> Column:
    return F.octet_length(text) > limit


def too_many_graphemes(text: Column, limit: int) -> Column:
    """Counts whole clusters, a base with its marks and joiners as one."""
    clusters = F.regexp_replace(text, r"(?s)\X", "x")
    return F.length(clusters) > limit
