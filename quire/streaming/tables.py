"""Tables a stream keeps: one folder of changes a micro-batch.

A batch writes only the records it touched, under its own number, so a replay
of the batch overwrites itself and nothing else. The table is the newest
record of every key. Every few batches these are written as a snapshot, so a
batch reads one snapshot and the few batches since, however many came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_batch(df: DataFrame, root: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def read_batches(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """Every change so far; before the first there is none. ``before`` leaves
    out the batch being written and whatever an earlier try of it left."""
    try:
        held = spark.read.schema(f"{schema}, batch bigint").parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return held if before is None else held.filter(F.col("batch") < before)


#: Batches from one snapshot to the next.
EVERY = 8
_SNAPSHOTS = "_newest"  # a name readers of the batches pass over


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def finished(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches, or snapshots, under ``root`` that were written to their end."""
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    held = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName().partition("=")[2]) for p in held if p.getName().startswith("batch=") and fs.exists(path(p, "_SUCCESS")))


def read_newest(spark: SparkSession, root: str, schema: str, key: Sequence[str], before: int | None = None) -> DataFrame:
    """The newest record of every key: the last snapshot and what came after. ``before`` as in :func:`read_batches`."""
    ours = [n for n in finished(spark, f"{root}/{_SNAPSHOTS}") if before is None or n < before]
    at = ours[-1] if ours else -1
    since = [n for n in finished(spark, root) if n > at and (before is None or n < before)]
    paths = [f"{root}/{_SNAPSHOTS}/batch={at}"] * bool(ours) + [f"{root}/batch={n}" for n in since]
    if not paths:
        return spark.createDataFrame([], schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)/[^/]*$", 1).cast("long")
    return newest(spark.read.schema(schema).parquet(*paths).select("*", number.alias("batch")), key)


def compact(spark: SparkSession, root: str, schema: str, key: Sequence[str], batch: int, every: int = EVERY) -> None:
    """After ``batch``, a snapshot if it is time for one, and without what only the one before the last needed.

    A batch that is tried again reads snapshots before it, and these stay.
    """
    if (batch + 1) % every:
        return
    held = finished(spark, f"{root}/{_SNAPSHOTS}")
    write_batch(read_newest(spark, root, schema, key, batch + 1), f"{root}/{_SNAPSHOTS}", batch)
    last = max((n for n in held if n < batch), default=-1)
    for folder, kept in ((root, last + 1), (f"{root}/{_SNAPSHOTS}", last)):
        for n in finished(spark, folder):
            if n < kept:
                fs, at = _folder(spark, f"{folder}/batch={n}")
                fs.delete(at, True)


def newest(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last record of each key, by a partial aggregate."""
    rest = [c for c in changes.columns if c not in (*key, "batch")]
    record = F.max_by(F.struct(*rest), "batch").alias("_one")
    return changes.groupBy(*key).agg(record).select(*key, *[F.col(f"_one.{c}").alias(c) for c in rest])
