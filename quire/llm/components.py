"""Connected components by alternating large and small stars.

Each round turns every node's neighbourhood into a star around its least
neighbour; the number of edges never grows, and paths shrink by the round. No
node's neighbours are ever gathered: a minimum is pre-aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> every v of u beside the least of u and its v's."""
    least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return pairs.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root), root the least node reachable; for linked nodes only.

    Loops, repeats and nulls among the links count for nothing; no links give no rows.
    """
    edges = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v").distinct(),
        "links",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        small = _star(large)
        small = small.select(F.col("v").alias("a"), "m").unionAll(small.select(F.col("u").alias("a"), "m"))
        edges = materialize(small.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "small")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
