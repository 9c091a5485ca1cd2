"""Columns worked out of raw records: ids, kinds, classes, labels, faces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import ART_LAYOUTS, FINISHES, LABEL_LANGS, TOKEN_LAYOUTS
from .masks import color_mask

FACE_SCHEMA = (
    "array<struct<name:string,type_line:string,mana_cost:string,colors:array<string>,power:string,"
    "toughness:string,loyalty:string,defense:string,oracle_id:string,illustration_id:string>>"
)


def parse_faces(text: Column) -> Column:
    return F.from_json(text, FACE_SCHEMA)


def lift_oracle_id(own: Column, faces: Column) -> Column:
    """The record's own id, else the first face's that has one."""
    ids = F.filter(F.transform(faces, lambda f: f["oracle_id"]), lambda i: i.isNotNull())
    return F.coalesce(own, F.get(ids, F.lit(0)))


def lift_illustration(own: Column, faces: Column) -> Column:
    """The record's own artwork, else the first face's and no other's."""
    return F.coalesce(own, F.get(faces, F.lit(0))["illustration_id"])


def back_illustration(front: Column, faces: Column) -> Column:
    """The second face's artwork, where it differs from the front's."""
    back = F.get(faces, F.lit(1))["illustration_id"]
    return F.when(front.isNotNull() & (back != front), back)


def card_kind(layout: Column) -> Column:
    return F.when(layout.isin(TOKEN_LAYOUTS), F.lit(1)).when(layout.isin(ART_LAYOUTS), F.lit(2)).otherwise(F.lit(0))


def stats_text(power: Column, toughness: Column, loyalty: Column, defense: Column) -> Column:
    """The corner of a card: ``power/toughness``, else loyalty, else defense."""
    both = F.concat(power, F.lit("/"), F.coalesce(toughness, F.lit("")))
    return F.when(power.isNotNull(), both).otherwise(F.coalesce(loyalty, defense))


def is_commander(kind: Column, type_line: Column, text: Column) -> Column:
    """Whether a card may head a deck; the words match whatever their case."""
    said = (
        F.ilike(type_line, F.lit("Legendary%Creature%"))
        | F.ilike(type_line, F.lit("Legendary%Spacecraft%"))
        | F.ilike(text, F.lit("%can be your commander%"))
    )
    return (kind == 0) & F.coalesce(said, F.lit(False))


def project_faces(faces: Column, card_mask: Column) -> Column:
    """Faces as the catalog shows them: a face's colours are its own, else its
    cost's, else the card's."""

    def one(face: Column) -> Column:
        mask = (
            F.when(face["colors"].isNotNull(), color_mask(F.array_join(face["colors"], "")))
            .when(F.coalesce(face["mana_cost"], F.lit("")) != "", color_mask(face["mana_cost"]))
            .otherwise(card_mask)
        )
        return F.struct(
            face["name"].alias("name"),
            face["type_line"].alias("typeLine"),
            face["mana_cost"].alias("manaCost"),
            mask.alias("colors"),
            stats_text(face["power"], face["toughness"], face["loyalty"], face["defense"]).alias("stats"),
        )

    return F.transform(faces, one)


def across_faces(own: Column, said: Column) -> Column:
    """A card's own value, or its faces' non-empty ones joined."""
    kept = F.filter(F.coalesce(said, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.when(F.size(kept) > 0, F.array_join(kept, " // ")))


def settle_finish(finishes: Column) -> Column:
    """The only finish there is, else nonfoil where made, else the first."""
    plain = F.lit(FINISHES[0])
    return (
        F.when(F.size(finishes) == 1, F.get(finishes, F.lit(0)))
        .when(F.array_contains(finishes, FINISHES[0]), plain)
        .otherwise(F.coalesce(F.get(finishes, F.lit(0)), plain))
    )


def stratum(layout: Column, type_line: Column, full_art: Column, border: Column, frame: Column) -> Column:
    """Which shape of card this is; the first class that fits."""
    return (
        F.when(layout.isin(*TOKEN_LAYOUTS, *ART_LAYOUTS), "token")
        .when(layout.isin("split", "flip", "planar", "scheme") | F.ilike(type_line, F.lit("Battle%")), "sideways")
        .when(F.ilike(type_line, F.lit("%Planeswalker%")), "walker")
        .when(full_art, "full-art")
        .when(border == "borderless", "borderless")
        .when(frame == "2015", "modern")
        .otherwise("older")
    )


def read_label(name: Column) -> Column:
    """``<set>-<number>[-<lang>]__<tag>-<tag>.<ext>`` as a struct, or null."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"^(.*)__(.*)$", 1)
    how = F.regexp_extract(stem, r"^(.*)__(.*)$", 2)
    set_code = F.regexp_extract(named, r"^([^-]*)-(.*)$", 1)
    rest = F.regexp_extract(named, r"^([^-]*)-(.*)$", 2)
    last = F.regexp_extract(rest, r"^(.*)-([^-]*)$", 2)
    known = last.isin(LABEL_LANGS)
    number = F.when(known, F.regexp_extract(rest, r"^(.*)-([^-]*)$", 1)).otherwise(rest)
    label = F.struct(
        set_code.alias("set_code"),
        number.alias("number"),
        F.when(known, last).otherwise(F.lit("en")).alias("lang"),
        F.split(how, "-").alias("tags"),
    )
    return F.when((set_code != "") & (number != "") & F.contains(stem, F.lit("__")), label)
