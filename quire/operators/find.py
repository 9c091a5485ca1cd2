"""Finding parents by their children: quantifiers, ranking and orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import RARITIES
from ..functions.text import kind_key, natural_key, normalize_text, spaced_words
from . import fulltext, inverted
from .predicates import Predicate, lenient_number, within_scope


def _with_flags(children: DataFrame, pred: Predicate, key: str) -> DataFrame:
    """Answer the any-child conditions once a parent and lay them on its rows.

    The conditions are reduced per parent by a partial aggregate and joined
    back, rather than by a window that would gather a hot parent in one task.
    """
    return _with_answers(children, pred.any_child, key)


def _with_answers(children: DataFrame, any_child: Mapping[str, Column], key: str) -> DataFrame:
    if not any_child:
        return children
    answers = children.groupBy(key).agg(
        *[F.max(condition).alias(flag) for flag, condition in any_child.items()]
    )
    return children.join(answers, key)


def match_cards(cards: DataFrame, prints: DataFrame, pred: Predicate, key: str) -> DataFrame:
    """Cards for which the predicate holds: of the card alone, or, where it
    reads any printing, of one printing that satisfies the whole of it."""
    if not pred.child:
        return cards.filter(pred.test)
    rows = _with_flags(prints, pred, key)
    own, asked = _by_side(pred)
    if own:
        # Each side answers its own leaves; only the answers meet.
        left = cards.select(key, *[c.alias(n) for n, c in own.items()])
        right = rows.select(key, *[c.alias(n) for n, c in asked.items()]).distinct()
        answered = left.join(right, key).filter(pred.flagged).select(key)
    else:
        answered = rows.filter(pred.test).select(key)
    return cards.join(answered, key, "left_semi")


#: Leaves whose answers go into one whole number.
_BITS = 62


def match_each(cards: DataFrame, prints: DataFrame, asked: Mapping[str, Predicate], key: str, name: str = "asked") -> DataFrame:
    """(``name``, ``key``): the cards of :func:`match_cards` for each of several
    predicates, with the printings read once for all of them.

    A printing is what it answers to every leaf, as bits; a card meets each
    different answer of its printings once.
    """
    reads = {n: pred for n, pred in asked.items() if pred.child}
    own, leaves, ever = {}, {}, {}
    for pred in reads.values():
        sides = _by_side(pred)
        own |= sides[0]
        leaves |= sides[1]
        ever |= pred.any_child
    flags = {}
    if reads:
        rows, names = _with_answers(prints, ever, key), list(leaves)
        masks = [names[i : i + _BITS] for i in range(0, len(names), _BITS)]

        def mask(held: list[str]) -> Column:
            return reduce(Column.bitwiseOR, [F.when(leaves[n], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, n in enumerate(held)])

        right = rows.select(key, *[mask(held).alias(f"_mask_{m}") for m, held in enumerate(masks)]).distinct()
        told = [(F.getbit(f"_mask_{m}", F.lit(i)) == 1).alias(n) for m, held in enumerate(masks) for i, n in enumerate(held)]
        left = cards.select(key, *[c.alias(n) for n, c in own.items()])
        flags = {n: f"_answer_{i}" for i, n in enumerate(reads)}
        met = left.join(right, key).select(key, *own, *told)
        answered = met.groupBy(key).agg(*[F.max(reads[n].flagged).alias(flag) for n, flag in flags.items()])
        cards = cards.join(answered, key, "left")
    each = F.array(*[F.when(F.col(flags[n]) if n in flags else pred.test, F.lit(n)) for n, pred in asked.items()])
    return cards.select(F.explode(F.array_compact(each)).alias(name), key)


def _by_side(pred: Predicate) -> tuple[dict[str, Column], dict[str, Column]]:
    """The predicate's leaves that read the parent, and those that read a child."""
    own = {n: c for n, (child, c) in pred.leaves.items() if not child}
    return own, {n: c for n, (child, c) in pred.leaves.items() if child}


def answering_print(
    prints: DataFrame, pred: Predicate, key: str, order: Sequence[str], value: str, name: str = "answer"
) -> DataFrame:
    """Per parent, the first child in ``order`` that satisfied the predicate,
    and the leading child where none did."""
    rows = _with_flags(prints, pred, key)
    place = F.struct(*order)
    # A condition inside the value keeps the aggregate partial on the map side.
    hit = F.when(pred.column, F.struct(place.alias("place"), F.col(value).alias("value")))
    lead = F.struct(place.alias("place"), F.col(value).alias("value"))
    return rows.groupBy(key).agg(F.min(hit).alias("_hit"), F.min(lead).alias("_lead")).select(
        key,
        F.coalesce(F.col("_hit")["value"], F.col("_lead")["value"]).alias(name),
        F.col("_hit").isNotNull().alias("answered"),
    )


def match_prints(cards: DataFrame, prints: DataFrame, pred: Predicate, key: str, name: str, text: str = "") -> DataFrame:
    """Each printing the tree holds of, its card's name containing ``text``."""
    flags = {flag: condition for flag, condition in pred.any_child.items()}
    own, asked = _by_side(pred)
    if text:
        cards = cards.filter(F.contains(normalize_text(F.col(name)), normalize_text(F.lit(text))))
    rows = prints.withColumns(flags).withColumns(asked)
    return cards.withColumns(own).join(rows, key).filter(pred.flagged).drop(*pred.leaves)


def name_tier(name: Column, wanted: Column) -> Column:
    """0 for the whole name, 1 for the start of a word, 2 for anywhere."""
    return (
        F.when(name == wanted, F.lit(0))
        .when(F.startswith(name, wanted) | F.contains(name, F.concat(F.lit(" "), wanted)), F.lit(1))
        .when(F.contains(name, wanted), F.lit(2))
    )


def with_popularity(cards: DataFrame, rank: str, printings: str, name: str = "score") -> DataFrame:
    """A rank where there is one, else the worst rank shared out over the
    printings. The worst rank is one row, so its broadcast is bounded."""
    worst = cards.agg(F.coalesce(F.max(rank), F.lit(0)).alias("_worst"))
    score = F.coalesce(F.col(rank).cast("double"), F.col("_worst") / F.col(printings))
    return cards.join(F.broadcast(worst)).withColumn(name, score).drop("_worst")


def rank_names(
    cards: DataFrame, text: str, name: str, kind: str, score: str, key: str, limit: int | None = 50
) -> DataFrame:
    """Name search: tier, then kind, then popularity, then name.

    The cheap name test comes before anything joined later; the limit becomes
    a top-k, so no full sort happens.
    """
    wanted = normalize_text(F.lit(text))
    held = cards.withColumn("_plain", normalize_text(F.col(name)))
    found = held.withColumn("tier", name_tier(F.col("_plain"), wanted))
    found = found.filter(F.col("tier").isNotNull() & (wanted != ""))
    found = found.orderBy("tier", kind, score, name, key)
    return (found.limit(limit) if limit is not None else found).drop("_plain")


def order_keys(order: str, name: str = "name", key: str = "id", reverse: bool = False) -> list[Column]:
    """Sort keys of a named order, tie-broken by name and id.

    Newest and most printed come first by themselves; what cannot be read as
    a number sorts last. ``reverse`` turns the whole list round, ties included.
    """
    unread = F.lit(float("inf"))

    def stat(side: int) -> Column:
        return F.coalesce(lenient_number(F.get(F.split(F.col("stats"), "/"), F.lit(side))), unread)

    scale = F.array(*[F.lit(r) for r in RARITIES])
    falling = order in ("printings", "released")
    builders = {
        "mv": lambda: F.coalesce(F.col("cmc"), F.lit(0.0)),
        "cmc": lambda: F.coalesce(F.col("cmc"), F.lit(0.0)),
        "pow": lambda: stat(0),
        "tou": lambda: stat(1),
        "printings": lambda: F.col("printings"),
        "edhrec": lambda: F.coalesce(F.col("edhrec_rank").cast("long"), F.lit((1 << 63) - 1)),
        "released": lambda: F.coalesce(F.col("released_at"), F.lit("")),
        "rarity": lambda: F.coalesce(F.array_position(scale, F.col("rarity")), F.lit(0)),
        "set": lambda: F.coalesce(F.col("set_code"), F.lit("")),
        "cn": lambda: natural_key(F.coalesce(F.col("collector_number"), F.lit(""))),
    }
    keys = [(builders[order](), falling)] if order in builders else []
    keys += [(F.col(name), False), (F.col(key), False)]
    return [c.desc() if down != reverse else c.asc() for c, down in keys]


_SHOWN = ["name", "kind", "paper", "default_print"]


def index_cards(cards: DataFrame, root: str, key: str = "oracle_id") -> None:
    """Write the index of the names of ``cards`` that :func:`search_cards` reads."""
    inverted.build_index(cards, key, "names", root, keep=_SHOWN)


def search_cards(
    cards: DataFrame,
    prints: DataFrame,
    query: str,
    key: str = "oracle_id",
    grouped: bool = True,
    tokens: bool = True,
    art_series: bool = True,
    limit: int = 20,
    index: str | None = None,
) -> DataFrame:
    """Full-text name search: one row a card with its representative printing,
    or every paper printing in published order. An exact name goes first, then
    kinds in order, then the better score.

    ``cards``: key, name, names (all printed ones in one text), kind, paper,
    default_print; ``prints``: key, id, digital, seq. ``index`` is where
    :func:`index_cards` wrote these cards; then no names are read.
    """
    if index is None:
        hits = fulltext.search_text(cards, key, "names", query, keep=_SHOWN)
    else:
        hits = inverted.search_index(cards.sparkSession, index, key, query, keep=_SHOWN)
    wanted = F.col("paper")
    if not tokens:
        wanted = wanted & (F.col("kind") != 1)
    if not art_series:
        wanted = wanted & (F.col("kind") != 2)
    hits = hits.filter(wanted)
    if grouped:
        rows = hits.join(prints.withColumnRenamed(key, "_owner"), F.col("default_print") == F.col("id"))
    else:
        rows = hits.join(prints.filter(~F.col("digital")), key)
    exact = (F.lower("name") == F.lower(F.lit(query.strip()))).cast("int").alias("exact")
    last = [] if grouped else [F.asc("seq")]
    ranked = rows.select(key, "name", "kind", F.round("score", 9).alias("score"), "id", "seq", exact)
    return ranked.orderBy(F.desc("exact"), F.asc("kind"), F.asc("score"), *last, F.asc(key), F.asc("id")).limit(limit)


def narrow_sets(sets: DataFrame, text: str, code: str = "set_code", name: str = "set_name", kind: str = "set_type") -> DataFrame:
    """Sets by name, by code, or by what they are in either spelling."""
    wanted = text.strip().lower()
    if not wanted:
        return sets
    return sets.filter(
        F.contains(F.lower(name), F.lit(wanted))
        | F.contains(F.col(code), F.lit(wanted))
        | F.contains(spaced_words(F.col(kind)), F.lit(wanted))
        | F.contains(F.col(kind), kind_key(F.lit(wanted)))
    )


def place_contents(stacks: DataFrame, prints: DataFrame, place: str | None, text: str = "") -> DataFrame:
    """What one place holds, by shown name: the printing's name, or its id
    where the catalog does not know it."""
    rows = stacks.filter(within_scope(place).column).join(prints, "printing", "left")
    shown = rows.withColumn("shown", F.coalesce("name", "printing"))
    wanted = text.strip().lower()
    return shown.filter(F.contains(F.lower("shown"), F.lit(wanted))) if wanted else shown
