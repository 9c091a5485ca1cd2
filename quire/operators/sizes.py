"""Size checks that decide whether a side may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# Rows a side may hold and still be shipped to every executor. With the row
# widths used here (ids, hashes, short words) that stays near 64 MB.
BROADCAST_ROWS = 500_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` holds at most ``rows`` rows; reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the count proves the side small.

    Past the bound the plan is left to the optimizer, whose sort-merge join
    splits skewed partitions at run time.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for a side that is work to come by: written once, so the check
    and the join do not each compute it."""
    return maybe_broadcast(materialize(df, "side"), rows)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits to all the cores there are.

    A table of many files or row groups is left as it is, so nothing large is
    ever shuffled for it; one small file with heavy work on each row is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
