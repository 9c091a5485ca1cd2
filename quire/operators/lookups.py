"""Joins between a catalog and what names its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def print_key(set_code: Column, number: Column) -> Column:
    return F.lower(F.concat(set_code, F.lit("/"), number))


def locate(keys: DataFrame, prints: DataFrame, key: str, set_code: str, number: str, value: str, order: str) -> DataFrame:
    """Which printing each set/number key names; of several, the last in order."""
    named = prints.groupBy(print_key(F.col(set_code), F.col(number)).alias(key)).agg(F.max_by(value, order).alias(value))
    return named.join(keys.select(key).distinct(), key, "left_semi")


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return wanted.join(held.select(key).distinct(), key, "left_anti")


def known(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return wanted.join(held.select(key).distinct(), key, "left_semi")


def carrying(prints: DataFrame, key: str, front: str, back: str, artwork: str = "artwork") -> DataFrame:
    """(artwork, printing) for either side, so an equi-join replaces an OR.

    Front and back of one printing count once where they are the same."""
    sides = F.array_distinct(F.array_compact(F.array(front, back)))
    return prints.select(F.explode(sides).alias(artwork), key)


def faces_of_match(matches: DataFrame, pairs: DataFrame, fronts: DataFrame, artwork: str = "artwork") -> DataFrame:
    """A matched artwork as the fronts to look under: itself where it is one,
    and every front it is the back of."""
    own = matches.join(fronts.select(F.col("front").alias(artwork)), artwork, "left_semi").withColumn("front", F.col(artwork))
    backed = matches.join(pairs.select(F.col("back").alias(artwork), "front"), artwork)
    return own.unionByName(backed).dropDuplicates([*matches.columns, "front"])


def distinct_pairs(pairs: DataFrame, fronts: DataFrame) -> DataFrame:
    """Distinct (back, front) pairs whose front is numbered."""
    return pairs.select("back", "front").distinct().join(fronts.select("front"), "front", "left_semi")


def artwork_rows(order: DataFrame, store: DataFrame, key: str, hashes: str, width: int) -> DataFrame:
    """Every artwork in order with its hashes, zeroed and marked where absent."""
    zeros = F.array(*[F.lit(0).cast("long")] * width)
    held = order.join(store.select(key, hashes), key, "left")
    return held.withColumns({"present": F.col(hashes).isNotNull(), hashes: F.coalesce(F.col(hashes), zeros)})


def result_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Names only one side has."""
    return (
        theirs.subtract(ours).withColumn("only", F.lit("theirs"))
        .unionByName(ours.subtract(theirs).withColumn("only", F.lit("ours")))
    )


def landed_rows(writes: DataFrame, results: DataFrame, position: Sequence[str]) -> DataFrame:
    """Writes with what each came to, by position; deletes are passed over."""
    answered = results.filter(F.col("uri").isNotNull())
    return writes.filter(F.col("action") != "delete").join(answered, list(position))
