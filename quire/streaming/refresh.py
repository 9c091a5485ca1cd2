"""Bulk versions as a stream of notices: each new version passes the gates and
replaces the table, or leaves only a line of history."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import read_batches

NOTICE = "kind string, version string, path string, n bigint"
HISTORY = "kind string, version string, outcome string, written bigint, skipped bigint, held bigint, n bigint"


def current_version(spark: SparkSession, root: str, kind: str, before: int | None = None) -> dict | None:
    """The last version taken, by the order versions were noticed in; ``before``
    leaves out the batch under way, which an earlier try may have written."""
    history = read_batches(spark, f"{root}/history", HISTORY, before).filter((F.col("kind") == kind) & (F.col("outcome") == "synced"))
    row = history.orderBy(F.desc("n")).limit(1).collect()
    return row[0].asDict() if row else None


def refresh_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    ingest: Callable[[DataFrame, int | None], tuple[DataFrame, dict]],
) -> None:
    """Take every notice not yet seen, one batch at a time.

    ``ingest(data, before)`` answers the rows to publish and a report with the
    outcome. Rows go to a folder named by the version and the history line is
    written after them, so a reader following the history sees a whole version
    or the one before.
    """

    def take(batch: DataFrame, number: int) -> None:
        # One row a version: as many as there are new bulk files, not rows.
        lines = []
        held = {}
        for notice in batch.orderBy("n").toLocalIterator():
            kind = notice["kind"]
            if kind not in held:
                row = current_version(spark, root, kind, number)
                held[kind] = (row["version"], row["written"]) if row else (None, None)
            version, before = held[kind]
            if version == notice["version"]:
                continue
            rows, report = ingest(spark.read.parquet(notice["path"]), before)
            if report["outcome"] == "synced":
                rows.write.mode("overwrite").parquet(f"{root}/versions/{kind}-{notice['n']}")
                held[kind] = (notice["version"], report["written"])
            lines.append((kind, notice["version"], report["outcome"], report["written"], report["skipped"], before, notice["n"]))
        spark.createDataFrame(lines, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{root}/history/batch={number}")

    query = (
        spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", 2).json(landing)
        .writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def published(spark: SparkSession, root: str, kind: str) -> DataFrame:
    row = current_version(spark, root, kind)
    if row is None:
        raise LookupError(f"no version of {kind} was ever taken")
    return spark.read.parquet(f"{root}/versions/{kind}-{row['n']}")


def notify(spark: SparkSession, landing: str, kind: str, version: str, path: str, n: int) -> None:
    """Put down the notice of a version already written to ``path``."""
    line = json.dumps({"kind": kind, "version": version, "path": path, "n": n})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(landing)
