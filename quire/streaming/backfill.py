"""Filling a store a little at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookups import missing
from ..session import materialize


def capped_backfill(
    wanted: DataFrame, store: DataFrame, key: str, order: Sequence[Column], cap: int, make: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(rows to add, report): at most ``cap`` missing items, in stable order.

    ``make`` answers rows with ``ok``; a failure spends its place in the cap
    and stays missing for the next run.
    """
    absent = materialize(missing(wanted, store, key), "missing")
    tried = materialize(make(absent.orderBy(*order).limit(cap)), "made")
    added = tried.filter("ok").drop("ok")
    report = tried.agg(F.count_if("ok").alias("added"), F.count_if(~F.col("ok")).alias("failed")).join(
        F.broadcast(absent.agg(F.count(F.lit(1)).alias("_all")))
    )
    return added, report.select("added", (F.col("_all") - F.col("added")).alias("waiting"), "failed")
