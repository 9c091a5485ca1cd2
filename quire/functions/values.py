"""Values in rows that come from outside: dates, money, tags, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (
    CURRENCY_PATTERN,
    FINISH_IN,
    FINISH_OUT,
    FLAG_TAGS,
    GRADES,
    MAX_TAGS,
    MONEY_PATTERN,
    TAG_BYTES,
    TRUE_WORDS,
    WHEN_PATTERN,
)
from .clip import clip_items
from .text import fold_key


def _lookup(words: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.element_at(table, key)


def finish_in(text: Column) -> Column:
    """A vendor's finish word as ours, or null for one nobody knows."""
    return _lookup(FINISH_IN, fold_key(text))


def finish_out(finish: Column) -> Column:
    return _lookup(FINISH_OUT, finish)


def grade_in(text: Column) -> Column:
    return _lookup({g.lower(): g for g in GRADES}, fold_key(text))


def grade_out(grade: Column) -> Column:
    return F.lower(F.regexp_replace(grade, "([a-z])([A-Z])", "$1_$2"))


def flag_in(text: Column) -> Column:
    return F.coalesce(fold_key(text).isin(TRUE_WORDS), F.lit(False))


def flag_out(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit("true")).otherwise(F.lit("false"))


def instant(text: Column) -> Column:
    """The moment a date text names, whatever offset wrote it, or null."""
    return F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T")))


def gated_instant(text: Column) -> Column:
    """The moment, only for text that begins with a full four-digit-year date."""
    return F.when(text.rlike(WHEN_PATTERN), F.coalesce(instant(text), F.try_to_timestamp(text)))


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gated_timestamp(text: Column) -> Column:
    return iso_text(gated_instant(text))


def money_pair(amount: Column, currency: Column) -> Column:
    """Whether an amount and a currency can be kept: both, or neither."""
    return F.coalesce(amount.rlike(MONEY_PATTERN) & currency.rlike(CURRENCY_PATTERN), F.lit(False))


def tags_of(flags: dict[str, Column], listed: Column) -> Column:
    """Flag columns that are set, then a comma list: trimmed, clipped,
    distinct, the first few."""
    marked = F.array_compact(F.array(*[F.when(flag_in(flags[t]), F.lit(t)) for t in FLAG_TAGS if t in flags]))
    split = clip_items(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda t: F.trim(t)), TAG_BYTES)
    every = F.concat(marked, F.filter(split, lambda t: t != ""))
    return F.slice(F.array_distinct(every), 1, MAX_TAGS)


def legible_lot(lot: Column) -> Column:
    """Whether a purchase lot could be read back whole from a file."""
    paid = lot["price"].isNotNull() | lot["currency"].isNotNull()
    worth = lot["marketValue"].isNotNull() | lot["marketCurrency"].isNotNull()
    dated = lot["at"].isNotNull()
    return (
        (~paid | money_pair(lot["price"], lot["currency"]))
        & (~worth | money_pair(lot["marketValue"], lot["marketCurrency"]))
        & (~dated | F.coalesce(lot["at"].rlike(WHEN_PATTERN), F.lit(False)))
        & (paid | worth | dated)
    )


def earlier(one: Column, other: Column) -> Column:
    """The text of the earlier moment, the first of two equal ones."""
    return F.when(instant(one) <= instant(other), one).otherwise(other)


def later(one: Column, other: Column) -> Column:
    """The text of the later moment; whichever is there when one is not."""
    return (
        F.when(one.isNull() | other.isNull(), F.coalesce(one, other))
        .when(instant(one) >= instant(other), one)
        .otherwise(other)
    )


def lots_by_date(lots: Column) -> Column:
    """Lots by moment, undated and unreadable first, otherwise as they stood."""
    placed = F.transform(
        lots,
        lambda lot, i: F.struct(
            F.coalesce(F.unix_micros(instant(lot["at"])), F.lit(-(1 << 62)).cast("long")).alias("moment"),
            i.alias("place"),
            lot.alias("lot"),
        ),
    )
    return F.transform(F.array_sort(placed), lambda p: p["lot"])


def clean_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))
