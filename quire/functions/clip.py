"""Cutting text at cluster boundaries, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_text(text: Column, limit: int, clusters: int | None = None) -> Column:
    """The longest prefix of whole grapheme clusters within ``limit`` bytes and
    ``clusters`` clusters.

    A character is a byte at least, so clusters past ``limit`` characters never
    fit and only one character more than that is split.
    """
    parts = F.regexp_extract_all(F.substring(text, 1, limit + 1), F.lit(r"(\X)"), F.lit(1))
    if clusters is not None:
        parts = F.slice(parts, 1, clusters)
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def take(state: Column, part: Column) -> Column:
        size = state["bytes"] + F.octet_length(part)
        fits = state["open"] & (size <= limit)
        return F.struct(
            F.when(fits, size).otherwise(state["bytes"]).alias("bytes"),
            F.when(fits, state["chars"] + F.length(part)).otherwise(state["chars"]).alias("chars"),
            fits.alias("open"),
        )

    cut = F.substring(text, F.lit(1), F.aggregate(parts, start, take)["chars"])
    short = F.octet_length(text) <= limit
    return F.when(short if clusters is None else F.lit(False), text).otherwise(cut)


def clip_items(items: Column, limit: int) -> Column:
    """Each string of an array so clipped."""
    return F.transform(items, lambda item: clip_text(item, limit))
