"""Text files as numbered lines, in file order, without gathering a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.sizes import maybe_broadcast
from ..session import materialize


def _raw(spark: SparkSession, path: str, pieces: Column | None) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    )
    return raw if pieces is None else raw.select(F.explode(pieces).alias("value"), "file", "_block")


def split_sizes(spark: SparkSession, path: str, pieces: Column | None = None) -> DataFrame:
    """(file, block, lines): one row a split, from a pass that only counts."""
    sizes = _raw(spark, path, pieces).groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    return materialize(sizes, "splits")


def numbered_lines(
    spark: SparkSession, path: str, sizes: DataFrame | None = None, pieces: Column | None = None
) -> DataFrame:
    """(file, line, value): every line of every file under ``path``, from 1.

    ``pieces`` may cut a line up further (a function of the column ``value``
    giving an array); the cuts are then what is numbered. Lines are counted as
    they stream past inside their split. Where a file has several splits,
    ``sizes`` shifts the later ones; compressed files have one, and need none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            out = []
            for split in zip(batch.column("file").to_pylist(), batch.column("_block").to_pylist()):
                at = at + 1 if split == here else 1
                here = split
                out.append(at)
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in ("value", "file", "_block")}, "_at": pa.array(out, type=pa.int64())}
            )

    counted = _raw(spark, path, pieces).mapInArrow(count, "value string, file string, _block long, _at long")
    if sizes is None:
        return counted.select("file", F.col("_at").alias("line"), "value")
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("file", "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return counted.join(maybe_broadcast(shift), ["file", "_block"]).select(
        "file", (F.col("_at") + F.col("_before")).alias("line"), "value"
    )
