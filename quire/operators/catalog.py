"""Printings into cards: shredding, deduplication, folding, gates, order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import COLORS, FINISHES, PLAIN_SET_TYPES, SHAPE_FIELDS
from ..functions import masks, shapes
from ..session import materialize
from .folding import fold_best, gate_outcome, shape_counts
from .ranking import common_first, common_first_array, number_by_first_seen, number_rows, run_offsets
from .sizes import checked, maybe_broadcast

_TEXT = [
    "id", "oracle_id", "name", "printed_name", "printed_type_line", "printed_text", "lang", "released_at", "layout",
    "set", "set_name", "set_type", "collector_number", "rarity", "mana_cost", "type_line", "oracle_text", "power",
    "toughness", "loyalty", "defense", "border_color", "frame", "artist", "illustration_id", "flavor_text",
    "image_status", "card_faces",
]
_LISTS = ["colors", "color_identity", "keywords", "games", "finishes"]
_FLAGS = [
    "digital", "promo", "reprint", "variation", "oversized", "booster", "full_art", "textless", "reserved", "game_changer",
]
_PRICES = ["usd", "usd_foil", "usd_etched", "eur", "eur_foil", "eur_etched", "tix"]
# Faces are irregular and stay JSON text until something reads them.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
    + [T.StructField(c, T.BooleanType()) for c in _FLAGS]
    + [
        T.StructField("cmc", T.FloatType()),
        T.StructField("edhrec_rank", T.IntegerType()),
        T.StructField("legalities", T.MapType(T.StringType(), T.StringType())),
        T.StructField("prices", T.StructType([T.StructField(c, T.StringType()) for c in _PRICES])),
    ]
)
REQUIRED = [
    "id", "name", "lang", "released_at", "layout", "set", "set_name", "set_type", "collector_number", "rarity",
    "color_identity", "digital", "promo", "reprint", "variation", "oversized", "booster", "full_art", "textless",
    "reserved", "border_color", "frame", "image_status",
]


def color_checks() -> dict[str, Column]:
    """A letter that is no colour is a field of the wrong type."""
    known = F.array(*[F.lit(c) for c in COLORS])
    return {f"unknown colour in {c}": F.size(F.array_except(F.col(f"row.{c}"), known)) > 0 for c in ("colors", "color_identity")}


def shred_prints(raw: DataFrame) -> DataFrame:
    """Printings with the ids and artwork their faces may hold lifted up."""
    faces = shapes.parse_faces(F.col("card_faces"))
    none = F.array().cast("array<string>")
    return raw.withColumn("faces", faces).withColumns(
        {
            "oracle_id": shapes.lift_oracle_id(F.col("oracle_id"), F.col("faces")),
            "illustration_id": shapes.lift_illustration(F.col("illustration_id"), F.col("faces")),
            "finishes": F.coalesce("finishes", none),
            "games": F.coalesce("games", none),
            "keywords": F.coalesce("keywords", none),
            "kind": shapes.card_kind(F.col("layout")),
        }
    ).withColumn("back_illustration", shapes.back_illustration(F.col("illustration_id"), F.col("faces")))


def accept_in_order(df: DataFrame, order: Sequence[str], keys: Sequence[Sequence[str]]) -> DataFrame:
    """The rows a store with several unique keys would take, one after another.

    A row is refused only by one taken before it, so a refused row frees its
    other key. Rows alone in every key are taken outright. The few that clash
    are settled in rounds: the first of all its groups is taken, whoever shares
    a group with it is refused, and the rest go round again. A key with a null
    in it claims nothing, as in SQL. Rounds are as many as the longest chain of
    clashes; each takes the first row left at least.
    """
    at = F.struct(*order)
    rows = df.withColumn("_at", at)

    def grouped(held: DataFrame, names: Sequence[str], what: Column, name: str) -> DataFrame:
        return held.groupBy(*names).agg(what.alias(name))

    clashing = []
    for names in keys:
        many = grouped(rows.dropna(subset=list(names)), names, F.count(F.lit(1)), "_n").filter("_n > 1").drop("_n")
        clashing.append(rows.join(checked(many), list(names), "left_semi").select("_at"))
    clash = materialize(reduce(lambda a, b: a.union(b), clashing).distinct(), "clash")
    if clash.isEmpty():
        return df
    free = rows.join(maybe_broadcast(clash), "_at", "left_anti")
    left = materialize(rows.join(maybe_broadcast(clash), "_at", "left_semi"), "clash")
    taken = []
    while not left.isEmpty():
        marked = left
        for i, names in enumerate(keys):
            first = grouped(left.dropna(subset=list(names)), names, F.min("_at"), f"_f{i}")
            marked = marked.join(first, list(names), "left")
        leads = reduce(lambda a, b: a & b, [F.coalesce(F.col("_at") == F.col(f"_f{i}"), F.lit(True)) for i in range(len(keys))])
        won = materialize(marked.filter(leads).select(*left.columns), "taken")
        taken.append(won)
        for names in keys:
            left = left.join(won.select(*names).distinct(), list(names), "left_anti")
        left = materialize(left, "clash")
    return reduce(lambda a, b: a.unionByName(b), [free, *taken]).drop("_at")


def print_rank() -> Column:
    """Which printing stands for a card; the least wins."""
    return F.struct(
        F.col("digital"),
        ~F.col("set_type").isin(PLAIN_SET_TYPES),
        ~F.col("booster"),
        F.col("layout") == "reversible_card",
        -F.unix_date(F.to_date("released_at")),
        ~F.array_contains("finishes", FINISHES[0]),
        F.col("collector_number"),
        F.col("id"),
    )


def fold_cards(prints: DataFrame) -> DataFrame:
    """One card per oracle id out of its printings."""
    rows = prints.withColumns(
        {
            "text": F.col("oracle_text"),
            "colors": masks.canonical_colors(F.col("colors")),
            "color_identity": masks.canonical_colors(F.col("color_identity")),
            "cmc": F.col("cmc").cast("double"),
            "default_print": F.col("id"),
            "paper": ~F.col("digital"),
            "printings": F.when(~F.col("digital"), 1).otherwise(0).cast("long"),
        }
    )
    return fold_best(
        rows,
        "oracle_id",
        print_rank(),
        best=["name", "color_identity", "keywords", "reserved", "edhrec_rank", "game_changer", "default_print"],
        fill=["type_line", "mana_cost", "cmc", "text", "colors", "power", "toughness", "loyalty", "defense"],
        least=["kind"],
        either=["paper"],
        total=["printings"],
        union=["printed_name"],
    ).withColumnRenamed("printed_name", "printed_names")


def shape_present() -> dict[str, Column]:
    tests = {
        "cmc": F.col("cmc").isNotNull(),
        "finishes": F.size("finishes") > 0,
        "games": F.size("games") > 0,
        "legalities": F.size("legalities") > 0,
        "type_line": F.col("type_line").isNotNull(),
    }
    return {f: tests[f] for f in SHAPE_FIELDS}


def ingest(good: DataFrame, rejects: DataFrame, before: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, cards, report): what a file comes to, and the gates' verdict on
    it. The caller writes only where the outcome says so.

    Shape is counted over every readable record, kept or not.
    """
    shredded = materialize(shred_prints(good), "shredded")
    named = shredded.filter(F.col("oracle_id").isNotNull())
    prints = materialize(
        accept_in_order(named, ["file", "line"], [["set", "collector_number", "lang"], ["id"]]), "prints"
    )
    cards = materialize(fold_cards(prints), "cards")
    seen = shape_counts(shredded, shape_present())
    counts = (
        prints.agg(F.count(F.lit(1)).alias("written"))
        .join(F.broadcast(shredded.agg(F.count(F.lit(1)).alias("_read"))))
        .join(F.broadcast(rejects.agg(F.count(F.lit(1)).alias("_rejected"))))
        .join(F.broadcast(cards.agg(F.count(F.lit(1)).alias("cards"))))
        .join(F.broadcast(seen.select(*[F.col(c).alias(f"shape_{c}") for c in seen.columns])))
    )
    skipped = F.col("_read") - F.col("written") + F.col("_rejected")
    report = counts.withColumn("skipped", skipped).withColumn(
        "outcome",
        gate_outcome(
            F.col("written"), F.col("skipped"), F.lit(before).cast("long"), {f: F.col(f"shape_{f}") for f in SHAPE_FIELDS}
        ),
    )
    return prints, cards, report.drop("_read", "_rejected")


def export_order(prints: DataFrame, cards: DataFrame) -> DataFrame:
    """Paper printings numbered in the published order: cards by name, each
    card's best printing first. Within a card this is :func:`print_rank`."""
    rows = prints.filter(~F.col("digital")).join(
        cards.select("oracle_id", F.col("name").alias("card_name")), "oracle_id"
    )
    order = [
        F.asc("card_name"), F.asc("oracle_id"),
        (~F.col("set_type").isin(PLAIN_SET_TYPES)).asc(), F.desc("booster"),
        (F.col("layout") == "reversible_card").asc(), F.desc("released_at"),
        (~F.array_contains("finishes", FINISHES[0])).asc(), F.asc("collector_number"), F.asc("id"),
    ]
    return number_rows(rows, order, "seq")


def export_cards(cards: DataFrame) -> DataFrame:
    """Paper cards as the published file holds them, runs included."""
    rows = cards.filter("paper").select(
        "oracle_id", "name", "type_line", "mana_cost", "cmc",
        masks.color_mask(F.col("colors")).alias("colors"),
        masks.color_mask(F.col("color_identity")).alias("color_identity"),
        "kind", "printings", "edhrec_rank",
        shapes.stats_text(F.col("power"), F.col("toughness"), F.col("loyalty"), F.col("defense")).alias("stats"),
        masks.flags_mask(
            F.col("reserved"), F.col("game_changer"), shapes.is_commander(F.col("kind"), F.col("type_line"), F.col("text"))
        ).alias("flags"),
        "keywords",
    )
    return run_offsets(rows, [F.asc("name"), F.asc("oracle_id")], "printings", "first_print")


def card_faces(prints: DataFrame, cards: DataFrame) -> DataFrame:
    """Each card's faces, from the printing that says most about them."""
    rows = prints.filter(F.col("card_faces").isNotNull() & ~F.col("digital")).join(
        cards.filter("paper and kind < 2").select("oracle_id", masks.color_mask(F.coalesce("colors", F.lit(""))).alias("own")), "oracle_id"
    )
    rank = F.struct(F.get("faces", F.lit(0))["colors"].isNull(), F.col("id"))
    best = rows.filter(F.col("faces").isNotNull()).groupBy("oracle_id").agg(
        F.min_by(F.struct("faces", "own"), rank).alias("one")
    )
    return best.select("oracle_id", shapes.project_faces(F.col("one.faces"), F.col("one.own")).alias("faces"))


def export_prints(ordered: DataFrame) -> DataFrame:
    """Printings with their artwork numbered by first appearance."""
    art = number_by_first_seen(ordered, "illustration_id", ["seq"], "artwork")
    flags = masks.flags_mask(*[F.col(c) for c in ("promo", "variation", "full_art", "textless", "oversized")])
    rows = ordered.select(
        "seq", "id", "oracle_id", F.col("set").alias("set_code"), "collector_number", "finishes", "rarity", "layout", "image_status",
        "lang", "printed_name", F.when(F.col("artist") != "", F.col("artist")).alias("artist"), flags.alias("flags"), "illustration_id",
    )
    return rows.join(art, "illustration_id", "left")


def set_table(prints: DataFrame) -> DataFrame:
    """Sets with the name, kind and date of their first release."""
    rows = prints.filter(~F.col("digital"))
    first = F.min(F.struct("released_at", "set_name", "set_type")).alias("one")
    return rows.groupBy(F.col("set").alias("set_code")).agg(first).select("set_code", "one.released_at", "one.set_name", "one.set_type")


def finish_dictionary(prints: DataFrame) -> DataFrame:
    return common_first_array(prints.filter(~F.col("digital")), "finishes")


def column_dictionary(prints: DataFrame, column: str) -> DataFrame:
    return common_first(prints.filter(~F.col("digital") & (F.col(column) != "")), column)


def claimed_runs(cards: DataFrame, prints: DataFrame) -> None:
    """Refuse an export whose cards claim other printings than there are."""
    claimed = cards.filter("paper").agg(F.coalesce(F.sum("printings"), F.lit(0)).alias("n")).first()["n"]
    written = prints.filter(~F.col("digital")).count()
    if claimed != written:
        raise ValueError(f"cards claim {claimed} printings, {written} were written")
