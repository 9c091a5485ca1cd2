"""What a user calls: each job strings the operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .constants import HASH_INSETS, KEEP_NEAREST
from .functions.text import natural_key
from .operators import catalog, find, folding, interchange as ix, lookups, similarity, stacks
from .operators.interchange import Format
from .operators.predicates import Predicate
from .operators.ranking import number_rows
from .session import materialize
from .sources import catalog_files, csv_lined, images, jsonl


def ingest_catalog(spark: SparkSession, path: str, before: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bulk file as (prints, cards, report); nothing is published unless the
    report's outcome is ``synced``."""
    good, rejects = jsonl.scan_json_lines(spark, path, catalog.RAW_SCHEMA, catalog.REQUIRED, catalog.color_checks())
    return catalog.ingest(good, rejects, before)


def export_catalog(prints: DataFrame, cards: DataFrame, root: str, version: str, store: DataFrame | None = None, hasher: str = "") -> dict:
    """The published catalog: cards and printings in order, dictionaries, sets,
    and where there is a ``store`` of hashes the artwork index beside the
    printings, backs after fronts."""
    catalog.claimed_runs(cards, prints)
    ordered = materialize(catalog.export_order(prints, cards), "ordered")
    rows = catalog.export_prints(ordered)
    artwork = None
    if store is not None:
        sides = ordered.select("seq", F.col("illustration_id").alias("front"), F.col("back_illustration").alias("back"))
        artwork = catalog_files.artwork_part(sides, store, f"{root}/prints", width=len(HASH_INSETS), hasher=hasher)
    return {
        "cards": catalog_files.write_catalog(
            catalog.export_cards(cards).join(catalog.card_faces(prints, cards), "oracle_id", "left"),
            f"{root}/cards", version, [], [F.asc("name"), F.asc("oracle_id")],
        ),
        "prints": catalog_files.write_catalog(
            rows, f"{root}/prints", version, ["rarity", "layout", "image_status", "lang", "artist"], [F.asc("seq")],
            arrays={"finishes": "mask"}, artwork=artwork,
        ),
        "sets": catalog_files.write_catalog(catalog.set_table(prints), f"{root}/sets", version, [], [F.asc("set_code")]),
    }


def find_cards(
    cards: DataFrame,
    prints: DataFrame,
    pred: Predicate | None = None,
    text: str = "",
    order: str | None = None,
    reverse: bool = False,
    limit: int = 50,
    key: str = "id",
) -> DataFrame:
    """Search: a predicate, a name, an order. An order sorts all that matched
    and lifts the cap off the name search; a direction without one is ignored.

    ``cards`` holds name, kind, score and whatever the order reads.
    """
    held = find.match_cards(cards, prints, pred, key) if pred is not None else cards
    if text:
        held = find.rank_names(held, text, "name", "kind", "score", key, None if order else limit)
    if order:
        return held.orderBy(*find.order_keys(order, key=key, reverse=reverse)).limit(limit)
    return held if text else held.orderBy("name", key).limit(limit)


def read_import(
    spark: SparkSession, path: str, format_: Format, now: str, prints: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(stacks, skipped) of vendor files. ``prints``: (id, set_code,
    collector_number, finishes, seq) answers rows named by set and number, and
    which finishes exist."""
    records = materialize(csv_lined.scan_csv_lined(spark, path), "records")
    heads = csv_lined.header_of(records)
    lacking = heads.withColumn("missing", ix.missing_columns(F.col("head"), format_)).filter("missing <> ''")
    whole = heads.join(lacking.select("file"), "file", "left_anti")
    judged = materialize(ix.judge_rows(ix.bind_columns(records, whole, format_), format_), "judged")
    skipped = lacking.select("file", F.col("head_line").alias("line"), F.concat(F.lit("no "), "missing", F.lit(" column")).alias("reason"))
    skipped = skipped.unionByName(judged.filter("reason is not null").select("file", "line", "reason"))
    rows = ix.stacks_of(judged.filter("reason is null"), now)
    if prints is None:
        return rows, skipped
    located = lookups.locate(rows, prints, "print_key", "set_code", "collector_number", "id", "seq")
    named, lost = ix.name_by_key(rows, located)
    made = prints.select(F.col("id").alias("printing"), "finishes")
    kept, wrong = ix.check_finishes(named, made)
    return kept, skipped.unionByName(lost).unionByName(wrong)


def import_stacks(rows: DataFrame) -> DataFrame:
    """Accepted rows of one import collapsed to one stack an identity."""
    identity = stacks.stack_identity(
        F.col("printing"), F.col("finish"), F.col("condition"), F.lit(None).cast("string"), F.col("proxy"), F.col("tags"), F.col("note")
    )
    placed = rows.withColumns({"identity": identity, "at": F.struct("file", "line")})
    return stacks.collapse(
        placed, "identity", "at", tags="tags", created="created", updated="updated", keep=["printing", "finish", "condition", "note", "proxy"]
    )


def import_receipt(made: DataFrame, source: str, at: str, stamped: bool = False) -> DataFrame:
    """One row an import leaves behind. A scan's digest covers its moment, so
    two alike differ; a file's does not, so the same file is known again."""
    lines = made.select(F.lit(source).alias("source"), F.concat(F.col("quantity").cast("string"), F.lit("\t"), "identity").alias("line"))
    digest = folding.content_digest(lines, ["source"], "line")
    sums = made.agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("cards"), F.count(F.lit(1)).alias("stacks"))
    held = digest.join(F.broadcast(sums)).withColumn("createdAt", F.lit(at))
    if stamped:
        held = held.withColumn("digest", F.concat(F.lit("sha256-"), F.sha2(F.concat(F.lit(at), F.col("digest")), 256)))
    return held


def held_apart(entries: DataFrame, held: DataFrame, joined: int) -> DataFrame:
    """How many kept entries own a printing and finish already without the plan
    joining them, never below none."""
    owned = held.select("printing", "finish").distinct()
    n = entries.join(owned, ["printing", "finish"], "left_semi").agg(F.count(F.lit(1)).alias("_n"))
    return n.select(F.greatest(F.lit(0).cast("long"), F.col("_n") - joined).alias("apart"))


def export_collection(held: DataFrame, prints: DataFrame, path: str, format_: Format, english: bool = False) -> DataFrame:
    """A collection as the format's CSV at ``path``, and what was lost on the
    way. ``prints``: (printing, name, set_code, set_name, collector_number,
    rarity, lang); what it does not know goes last with its id alone."""
    rows = held.join(prints.withColumn("known", F.lit(True)), "printing", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    order = [
        F.desc("known"), F.asc("set_code"), natural_key(F.coalesce("collector_number", F.lit(""))).asc(), F.asc("finish"),
        F.asc(F.coalesce("condition", F.lit(""))), F.asc("printing"),
    ]
    spent = ix.spend_stack_lots(rows, format_)
    # Rows are put in order while they still hold their facts; the writer then
    # only has to keep them there.
    placed = number_rows(spent.withColumn("_lot", F.xxhash64("take", "lot")), [*order, F.asc("_lot")], "_seq")
    cells = ix.export_cells(placed, format_, english=english, keep=["_seq"])
    csv_lined.write_csv(cells, path, format_.columns, order="_seq")
    return ix.loss_report(rows, format_)


def scan_table(frames: DataFrame, index: DataFrame, prints: DataFrame) -> DataFrame:
    """Frames as list entries: hashed, matched, named, with the finish and
    whether the read settles it. ``prints``: (artwork, id, finishes, seq)."""
    hashed = images.hash_frames(frames, tuple(HASH_INSETS)).select(F.col("id").alias("query_id"), "hashes")
    found = similarity.nearest(hashed, index, keep=KEEP_NEAREST)
    kind = "array<struct<seq:bigint,id:string,finishes:array<string>>>"
    named = found.join(prints, "artwork", "left").groupBy("query_id", "place", "distance", "artwork").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("id").isNotNull(), F.struct(F.col("seq").cast("long").alias("seq"), "id", "finishes"))).cast(kind)
        ).alias("prints")
    )
    rows = named.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "distance", "artwork", "prints"))),
            lambda m: F.struct(m["distance"].alias("distance"), m["artwork"].alias("artwork"), m["prints"].alias("prints")),
        ).alias("found")
    )
    return similarity.scan_entries(rows.join(similarity.margins(found), "query_id"), "query_id")
