"""Import parts becoming stacks, each applied exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import MAX_COPIES
from ..operators.sizes import maybe_broadcast
from ..operators.stacks import reconcile
from ..session import materialize
from .tables import compact, read_newest, write_batch

# One row a part, so a part is applied whole or not at all. Packing bounds its entries.
PART = "part_key string, digest string, entries array<struct<position:bigint,identity:string,quantity:bigint,lots:bigint>>"
STATE = "identity string, held_id string, quantity bigint, lots bigint, at bigint"
APPLIED = "part_key string, digest string"
STACK = ["identity", "held_id"]


def collection(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The stacks as they stand. Grouped by identity as well, so a join on it
    narrows the changes before they are folded."""
    return read_newest(spark, f"{root}/stacks", STATE, STACK, before).select("identity", "held_id", "quantity", "lots", "at")


def applied(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return read_newest(spark, f"{root}/applied", APPLIED, ["part_key"], before)


def pending(parts: DataFrame, done: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Parts still to apply: each once however often it was sent, none already
    applied, none of a cancelled import."""
    left = parts.join(maybe_broadcast(done.select("part_key")), "part_key", "left_anti")
    if cancelled is not None:
        left = left.join(maybe_broadcast(cancelled.select("digest").distinct()), "digest", "left_anti")
    return left.dropDuplicates(["part_key"])


def well_formed(parts: DataFrame) -> Column:
    """Whether a part's entries stand at places of their own; in others no order says which comes first."""
    places = F.transform("entries", lambda e: e["position"])
    return F.coalesce((F.size(F.array_distinct(places)) == F.size(places)) & ~F.exists(places, lambda p: p.isNull()), F.lit(False))


def refused(spark: SparkSession, root: str) -> DataFrame:
    """(part_key, digest) of the parts that were set aside."""
    return read_newest(spark, f"{root}/refused", APPLIED, ["part_key"])


def entries_of(parts: DataFrame) -> DataFrame:
    """(part_key, digest, position, identity, quantity, lots): a row an entry."""
    return parts.select("part_key", "digest", F.explode("entries").alias("e")).select("part_key", "digest", "e.*")


def drain_batch(spark: SparkSession, root: str, batch: DataFrame, number: int, cancelled: DataFrame | None = None, copies: int = MAX_COPIES) -> None:
    """Apply one batch of parts: the records it touches, then the parts it
    retired, both under the batch's number. Replaying it rewrites the same."""
    # Written once: the plan, the records and the retired keys all read it.
    sent = materialize(pending(batch, applied(spark, root, number), cancelled), "parts")
    # A part that cannot be applied is named and left; the stream goes on without it.
    parts, bad = sent.filter(well_formed(sent)), sent.filter(~well_formed(sent))
    write_batch(bad.select("part_key", "digest"), f"{root}/refused", number)
    compact(spark, f"{root}/refused", APPLIED, ["part_key"], number)
    entries = entries_of(parts).select("identity", "quantity", "lots", F.struct("part_key", "position").alias("at"))
    steps = reconcile(entries, collection(spark, root, number), "identity", "at", copies=copies, policy="last", lots="lots")
    fresh = F.concat(F.lit("new:"), F.col("identity"), F.lit(f":{number}:"), F.col("bin").cast("string"))
    changed = steps.select(
        "identity", F.coalesce("held_id", fresh).alias("held_id"), F.col("after").alias("quantity"), F.col("lots_after").alias("lots"), F.lit(number).cast("long").alias("at")
    )
    write_batch(changed, f"{root}/stacks", number)
    write_batch(parts.select("part_key", "digest"), f"{root}/applied", number)
    compact(spark, f"{root}/stacks", STATE, STACK, number)
    compact(spark, f"{root}/applied", APPLIED, ["part_key"], number)


def drain_stream(
    spark: SparkSession, landing: str, root: str, checkpoint: str, files: int = 4, cancelled: DataFrame | None = None, copies: int = MAX_COPIES
) -> None:
    query = (
        spark.readStream.schema(PART).option("maxFilesPerTrigger", files).parquet(landing)
        .writeStream.foreachBatch(lambda df, number: drain_batch(spark, root, df, number, cancelled, copies))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def live_totals(written: DataFrame, waiting: DataFrame, by: str) -> DataFrame:
    """Copies a group, written and waiting together: draining moves copies from
    one side to the other and the sum stands still."""
    both = written.select(by, F.col("quantity").alias("w"), F.lit(0).cast("long").alias("p")).unionByName(
        waiting.select(by, F.lit(0).cast("long").alias("w"), F.col("quantity").alias("p"))
    )
    return both.groupBy(by).agg(
        F.sum("w").alias("written"), F.sum("p").alias("waiting"), F.sum(F.col("w") + F.col("p")).alias("total")
    )


def totals_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, by: str, files: int = 4) -> DataFrame:
    """Running copies a group over a stream of entries, kept as the newest
    total each batch changed."""
    schema = f"{by} string, quantity bigint"
    totals = (
        entries_of(spark.readStream.schema(PART).option("maxFilesPerTrigger", files).parquet(landing))
        .groupBy(by).agg(F.sum("quantity").alias("quantity"))
    )

    def take(df: DataFrame, number: int) -> None:
        write_batch(df.select(by, "quantity"), root, number)
        compact(spark, root, schema, [by], number)

    query = (
        totals.writeStream.outputMode("update").foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_newest(spark, root, schema, [by])
