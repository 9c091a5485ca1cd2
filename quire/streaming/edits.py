"""Edits applied to entries and stacks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import FINISHES, MAX_COPIES
from ..operators.folding import fold_to_end
from ..operators.sizes import maybe_broadcast
from ..operators.stacks import assign_bins
from .tables import compact, read_newest, write_batch

EDIT = "entry string, seq bigint, op string, value string"
ENTRY = (
    "entry string, quantity bigint, finish string, condition string, dropped boolean, seq bigint, "
    "printing string, made array<string>, picked boolean, reported string"
)
_OUT = ENTRY.partition(", ")[2]

GONE = -1


def _settled(made: list[str]) -> str:
    if len(made) == 1:
        return made[0]
    return FINISHES[0] if FINISHES[0] in made or not made else made[0]


def _moves():
    """An entry under one edit after another. It counts 0 while it was never
    there and ``GONE`` once it is taken away, after which nothing brings it
    back or changes it."""
    held = {"quantity": 0, "finish": FINISHES[0], "condition": "", "dropped": False, "seq": None, "printing": None, "made": None, "picked": False, "reported": None}

    def step(seq: int, op: str, value: str | None, n: int | None, made: list[str] | None, state: dict | None) -> None:
        if op == "state":
            held.update({k: v for k, v in state.items() if v is not None})
            return
        held["seq"] = seq
        count = held["quantity"]
        if op == "add":
            if count == 0:
                held.update(quantity=1, printing=value, made=made, finish=_settled(made or []))
        elif count <= 0:
            pass
        elif op == "plus":
            held["quantity"] = min(count + 1, MAX_COPIES)
        elif op == "minus":
            held["quantity"] = count - 1 or GONE
        elif op == "counted":
            held["quantity"] = min(max(1, n or 0), MAX_COPIES)
        elif op == "drop":
            held["quantity"] = GONE
        elif op == "dropping":
            held["dropped"] = value == "true"
        elif op == "regraded":
            held["condition"] = value or ""
        elif op == "reported":
            held["reported"] = value
        elif op == "choose":
            if value != held["printing"]:
                held.update(printing=value, made=made, finish=_settled(made or []))
            held["picked"] = True
        elif op == "refinish":
            # Made in nothing known of: any finish somebody makes.
            if value in (FINISHES if held["made"] is None else held["made"]):
                held["finish"] = value
        elif op == "cycled":
            ways = held["made"] or []
            if len(ways) > 1:
                at = ways.index(held["finish"]) if held["finish"] in ways else -1
                held["finish"] = ways[(at + 1) % len(ways)]

    return step, lambda: held.values()


def fold_edits(entries: DataFrame, edits: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Entries after their edits, each entry's in the order of ``seq``.

    Ten moves: add, plus, minus, counted, drop, dropping, regraded, reported,
    choose, refinish and cycled, the first of which begins an entry. ``prints``
    (printing, finishes) says what a printing was made in: choosing one settles
    the finish, and a finish it was not made in is refused; one it does not
    name was made in none. Edits are rows of a
    few words, folded where they stream by, so an entry may have any number.
    """
    rest = [c for c in T.StructType.fromDDL(_OUT).fields]
    state = F.struct(*[(F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rest])
    none = F.lit(None)
    before = entries.select(
        "entry", F.lit(-1).cast("long").alias("seq"), F.lit("state").alias("op"), none.cast("string").alias("value"), none.cast("array<string>").alias("made"), state.alias("state")
    )
    told = edits.select("entry", "seq", "op", "value")
    if prints is None:
        told = told.withColumn("made", none.cast("array<string>"))
    else:
        made = prints.select(F.col("printing").alias("value"), F.col("finishes").alias("made"), F.explode(F.array(F.lit("add"), F.lit("choose"))).alias("op"))
        made = made.dropDuplicates(["value", "op"])
        told = told.join(maybe_broadcast(made), ["value", "op"], "left").withColumn("made", F.coalesce("made", F.array().cast("array<string>")))
    rows = before.unionByName(told.withColumn("state", none.cast(before.schema["state"].dataType)))
    rows = rows.withColumn("n", F.floor(F.col("value").try_cast("double")).cast("long"))
    return fold_to_end(rows, "entry", ["seq", "op", "value"], ["seq", "op", "value", "n", "made", "state"], _moves, _OUT)


def edit_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, prints: DataFrame | None = None) -> DataFrame:
    """Edits arriving as files, all of one trigger folded in their own order
    onto the entries so far."""

    def take(batch: DataFrame, number: int) -> None:
        touched = batch.select("entry").distinct()
        held = read_newest(spark, root, ENTRY, ["entry"], number).join(touched, "entry", "left_semi")
        write_batch(fold_edits(held, batch, prints), root, number)
        compact(spark, root, ENTRY, ["entry"], number)

    query = (
        spark.readStream.schema(EDIT).parquet(landing)
        .writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_newest(spark, root, ENTRY, ["entry"]).filter(F.col("quantity") > 0)


def amend_stacks(stacks: DataFrame, edits: DataFrame, copies: int = MAX_COPIES) -> DataFrame:
    """Stacks after their amendments: a count under one drops it, and a stack
    whose identity came to be another's joins it where both fit.

    ``stacks``: (uri, identity, quantity, at); ``edits``: (uri, identity,
    quantity), nulls leaving a field alone, and ``seq`` where a stack may be
    amended more than once: each field takes its last value. Stacks nobody
    amended come first, so what moves joins what stayed.
    """
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    put = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq))
    changed = edits.groupBy("uri").agg(put("identity").alias("_i"), put("quantity").alias("_q"), F.lit(True).alias("_moved"))
    now = stacks.join(changed, "uri", "left").select(
        "uri",
        F.coalesce("_i", "identity").alias("identity"),
        F.coalesce("_q", "quantity").cast("long").alias("quantity"),
        F.struct(F.coalesce("_moved", F.lit(False)).alias("moved"), F.col("at").cast("long").alias("at"), F.col("uri").alias("id")).alias("_at"),
    ).filter(F.col("quantity") > 0)
    placed = assign_bins(now, "identity", "_at", F.col("quantity"), F.lit(0), "first", ~F.col("_at.moved"), copies)
    return placed.groupBy("identity", "bin").agg(
        F.min_by("uri", "_at").alias("uri"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("merged")
    )
