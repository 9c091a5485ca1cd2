"""Numbering and running sums that survive one group holding most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# A group past this many rows is spread over several tasks. Below it one task
# sorts the group, spilling if it must.
HOT_ROWS = 2_000_000


def _has_hot_group(df: DataFrame, by: Sequence[str], hot_rows: int) -> bool:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.filter(F.col("_n") > hot_rows).isEmpty()


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    rank: str | None = "rank",
    before: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: bool | None = None,
) -> DataFrame:
    """Add a 1-based ``rank`` in each group and, per ``before`` entry, the sum
    of that column over the group's earlier rows.

    ``order`` has to be total. An ordinary group is one window partition. Where
    any group is hot, or there are no groups at all, rows are range-partitioned
    by (group, order), so a hot group covers many partitions; each partition
    numbers its own rows and small per-partition totals shift them. A caller
    that knows its group sizes says so in ``hot`` and saves the count.
    """
    before = before or {}
    by = list(by)
    if hot is None:
        hot = bool(by) and _has_hot_group(df, by, hot_rows)
    if by and not hot:
        w = Window.partitionBy(*by).orderBy(*order)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        out = df
        added = {}
        if rank:
            added[rank] = F.row_number().over(w).cast("long")
        for name, value in before.items():
            total = F.sum(value).over(earlier)
            added[name] = F.coalesce(total, F.lit(0).cast("long"))
        return out.withColumns(added)

    held = materialize(
        df.withColumns({f"_v_{n}": v for n, v in before.items()})
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .sortWithinPartitions(*[F.col(c) for c in by], *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_at", 33))

    # One row per (partition, group): at most groups + partitions of them.
    totals = held.groupBy("_part", *by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in before],
    )
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    shift = totals.select(
        F.col("_part").alias("_s_part"),
        *[F.col(c).alias(f"_s_{c}") for c in by],
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_s_rows"),
        *[
            F.coalesce(F.sum(f"_t_{n}").over(earlier), zero).alias(f"_s_sum_{n}")
            for n in before
        ],
    )

    inner = Window.partitionBy("_part", *by).orderBy("_at")
    local = {"_l_rows": F.row_number().over(inner).cast("long")}
    for name in before:
        over = inner.rowsBetween(Window.unboundedPreceding, -1)
        local[f"_l_sum_{name}"] = F.coalesce(F.sum(f"_v_{name}").over(over), zero)
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by],
        F.col("_part") == F.col("_s_part"),
    )
    out = held.withColumns(local).join(shift, same)
    added = {}
    if rank:
        added[rank] = F.col("_l_rows") + F.col("_s_rows")
    for name in before:
        added[name] = F.col(f"_l_sum_{name}") + F.col(f"_s_sum_{name}")
    keep = df.columns + list(added)
    return out.withColumns(added).select(*keep)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "seq") -> DataFrame:
    """Dense 1-based position of every row in one total order, with no
    single-task window."""
    return ranked(df, [], order, rank=name)


def run_offsets(df: DataFrame, order: Sequence[Column], length: str, name: str = "start") -> DataFrame:
    """Where each row's run starts when runs of ``length`` follow one another."""
    return ranked(df, [], order, rank=None, before={name: F.col(length).cast("long")})


# A table this short is numbered by one task sooner than by many.
SMALL_ROWS = 200_000


def number_dictionary(df: DataFrame, order: Sequence[Column], name: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """:func:`number_rows` for what an aggregate left, which is mostly short:
    written once, counted, and numbered by one task only where that is proven
    little work."""
    held = materialize(df, "dictionary")
    if held.count() <= small_rows:
        return held.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return number_rows(held, order, name)


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group.

    The filter on the rank lets Spark keep only ``keep`` rows a group on the
    map side, so a hot group shuffles next to nothing.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= keep)
        .drop("_rank")
    )


def common_first(df: DataFrame, column: str, position: str = "position") -> DataFrame:
    """A column's dictionary: values commonest first, ties by value, from 0."""
    counted = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    numbered = number_dictionary(counted, [F.desc("uses"), F.asc("value")], position)
    return numbered.withColumn(position, F.col(position) - 1)


def common_first_array(df: DataFrame, column: str, position: str = "position") -> DataFrame:
    """The same dictionary over the elements of an array column."""
    return common_first(df.select(F.explode(column).alias("_item")), "_item", position)


def number_by_first_seen(
    df: DataFrame, value: str, order: Sequence[str], name: str = "number", start: int = 0
) -> DataFrame:
    """Number distinct values by where each first appears in ``order``."""
    first = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    # Two values never share a first row, but a nested order needs a tie-break.
    numbered = number_dictionary(first, [F.asc("_first"), F.asc(value)], name)
    return numbered.select(value, (F.col(name) - 1 + start).alias(name))
