"""Session helpers: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_root: str | None = None
_made: list[str] = []


def build(name: str = "quire", master: str = "local[*]", partitions: int = 8, **conf) -> SparkSession:
    """A session with the settings the jobs expect; a cluster supplies its own."""
    builder = (
        SparkSession.builder.appName(name)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees.

    A cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``.
    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder, which goes when the process ends. Tables under
    a named folder stay until :func:`release`.
    """
    global _local_root
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder nothing has used yet."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every intermediate table of this process; how many there were.

    A job calls it once its results are written: what it read from these tables
    cannot be computed again after.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, and pins values
    that a recomputation could assign differently.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
