"""Running a stream whose operators keep state by key in Spark's own store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORE = "spark.sql.streaming.stateStore."
_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes what it changed; whole snapshots follow in the background.
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    # There are as many small stores as shuffle partitions: none takes disk beforehand.
    f"{_STORE}rocksdb.allowFAllocate": "false",
}


def files_a_batch(spark: SparkSession, path: str, batches: int) -> int:
    """How many files a micro-batch takes so that what is there now makes about ``batches`` of them."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // batches))


def any_table(path: str) -> str:
    """``path`` as a pattern only it matches: a stream reads folders and patterns, but a table may be one file."""
    return f"{path[:-1]}[{path[-1]}]"


def run_available(changes: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every micro-batch of ``changes`` to ``take`` until all that is there is taken.

    State lies in the store on executors' disks and under ``checkpoint``, so a
    lost executor reads it back and a batch costs what it touches. ``take`` may
    see a batch again after a failure and must overwrite what it wrote.
    """
    conf = changes.sparkSession.conf
    held = {key: conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        conf.set(key, value)
    try:  # a started query has a copy of the settings
        query = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in held.items():
            conf.set(key, value) if value else conf.unset(key)
    query.awaitTermination()
