"""The review list: rows of a file or a scan before they become stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_COPIES, SURE_MARGIN
from .stacks import assign_bins

REST = ["tags", "note", "proxy", "updated", "lots", "container"]


def review_rows(rows: DataFrame) -> DataFrame:
    """Accepted file rows as list entries, keyed by their line; what the list
    has no column for goes along whole."""
    rest = F.struct(*[F.col(c) for c in REST if c in rows.columns])
    return rows.select(
        F.col("line").cast("string").alias("id"),
        F.col("created").alias("at"),
        "line",
        "printing",
        "finish",
        "quantity",
        F.coalesce("condition", F.lit("")).alias("condition"),
        F.lit(False).alias("dropped"),
        rest.alias("rest"),
    )


def entry_stacks(entries: DataFrame, container: str | None = None) -> DataFrame:
    """Entries not struck off as stacks, the list's own columns over the file's."""
    kept = entries.filter(~F.coalesce("dropped", F.lit(False)))
    rest = [f.name for f in entries.schema["rest"].dataType.fields if f.name != "container"] if "rest" in entries.columns else []
    held = F.col("rest.container") if "rest" in entries.columns and "container" in entries.schema["rest"].dataType.names else F.lit(None).cast("string")
    return kept.select(
        "id",
        "printing",
        "finish",
        "quantity",
        F.col("at").alias("created"),
        F.when(F.col("condition") != "", F.col("condition")).alias("condition"),
        (F.lit(container) if container else held).alias("container"),
        *[F.col(f"rest.{c}").alias(c) for c in rest],
    )


def merge_entries(
    entries: DataFrame, identity: str, order: str, quantity: str = "quantity", lots: Column | None = None, copies: int = MAX_COPIES
) -> DataFrame:
    """Entries of one identity joined, the first of them the only one that
    takes others in; struck-off entries pass through as they are."""
    gone = F.coalesce(F.col("dropped"), F.lit(False))
    live = assign_bins(entries.filter(~gone), identity, order, F.col(quantity), F.lit(0) if lots is None else lots, "only", copies=copies)
    keep = [c for c in entries.columns if c not in (identity, quantity)]
    lead = F.min_by(F.struct(*keep), order).alias("_lead")
    folded = live.groupBy(identity, "bin").agg(F.sum(quantity).cast("long").alias(quantity), F.count(F.lit(1)).alias("merged"), lead)
    merged = folded.select(identity, quantity, "merged", *[F.col(f"_lead.{c}").alias(c) for c in keep])
    struck = entries.filter(gone).select(identity, F.col(quantity).cast("long").alias(quantity), F.lit(1).cast("long").alias("merged"), *keep)
    return merged.unionByName(struck)


def sure(margin: Column, matched: Column) -> Column:
    """Settled by the reader alone: a clear margin, and one printing of it."""
    one = F.size(F.get(matched, F.lit(0))["prints"]) == 1
    return F.coalesce((F.coalesce(margin, F.lit(0)) >= SURE_MARGIN) & one, F.lit(False))


def ids_of(prints: Column) -> Column:
    """The ids of printings (structs with an ``id``); none where null."""
    return F.coalesce(F.transform(prints, lambda p: p["id"]), F.array().cast("array<string>"))


def among(matched: Column) -> Column:
    """The ids of the printings the winning artwork carries."""
    return ids_of(F.get(matched, F.lit(0))["prints"])


def offered(matched: Column, printing: Column) -> Column:
    """Whether a printing was anywhere among the matches."""
    return F.coalesce(F.exists(matched, lambda m: F.array_contains(ids_of(m["prints"]), printing)), F.lit(False))


def referenced(entries: DataFrame, chosen: str = "chosen", matched: str = "matched") -> DataFrame:
    """(id): every printing a list needs the catalog's row of, those chosen and those matched, each once."""
    ids = F.flatten(F.transform(F.coalesce(F.col(matched), F.array().cast(entries.schema[matched].dataType)), lambda m: ids_of(m["prints"])))
    return entries.select(F.explode(F.array_append(ids, F.col(chosen))).alias("id")).filter(F.col("id").isNotNull()).distinct()
