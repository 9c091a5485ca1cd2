"""Costs as multisets of symbols."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, functions as F

GENERIC = "generic"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once a row, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def symbol_counts(parts: Column) -> Column:
    """An array of symbols as a map from symbol to count; numbers add up under
    one generic entry, everything else counts by its upper-case spelling."""
    def number(part: Column) -> Column:
        return part.try_cast("double")

    def counted(keyed: Column, names: Column) -> Column:
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda name: F.aggregate(
                    F.filter(keyed, lambda k: k["symbol"] == name),
                    F.lit(0.0),
                    lambda held, k: held + k["n"],
                ),
            ),
        )

    keyed = F.transform(
        parts,
        lambda p: F.struct(
            F.when(number(p).isNotNull(), F.lit(GENERIC)).otherwise(F.upper(p)).alias("symbol"),
            F.coalesce(number(p), F.lit(1.0)).alias("n"),
        ),
    )
    # ``parts`` may be a whole text cut into words: a lambda would do that again for every symbol.
    return _once(keyed, lambda keyed: _once(F.array_distinct(F.transform(keyed, lambda k: k["symbol"])), lambda names: counted(keyed, names)))


def cost_symbols(cost: Column) -> Column:
    """A cost, braced or shorthand, as its symbol counts."""
    braced = F.regexp_extract_all(cost, F.lit(r"\{([^}]+)\}"), F.lit(1))
    short = F.regexp_extract_all(cost, F.lit(r"([0-9]+|[A-Za-z/])"), F.lit(1))
    return symbol_counts(F.when(F.size(braced) > 0, braced).otherwise(short))


def literal_symbols(cost: str) -> dict[str, float]:
    """The same for the value of a predicate, folded before the plan is made."""
    parts = re.findall(r"\{([^}]+)\}", cost) or re.findall(r"\d+|[A-Za-z/]", cost)
    held: Counter = Counter()
    for part in parts:
        if re.fullmatch(r"\d+(\.\d+)?", part):
            held[GENERIC] += float(part)
        else:
            held[part.upper()] += 1.0
    return dict(held)


def compare_counts(held: Column, op: str, wanted: dict[str, float]) -> Column:
    """Multiset comparison of a column's counts with a literal's."""
    zero = F.lit(0.0)
    covers = F.lit(True)
    for symbol, n in wanted.items():
        covers = covers & (F.coalesce(F.element_at(held, F.lit(symbol)), zero) >= n)
    if wanted:
        want = F.create_map(*[x for s, n in wanted.items() for x in (F.lit(s), F.lit(n))])
        inside = F.forall(
            F.map_entries(held), lambda e: F.coalesce(F.element_at(want, e["key"]), zero) >= e["value"]
        )
    else:
        inside = F.forall(F.map_entries(held), lambda e: e["value"] <= 0.0)
    total = F.aggregate(F.map_values(held), zero, lambda a, n: a + n)
    size = float(sum(wanted.values()))
    return {
        ">": covers & (total > size),
        "<": inside & (total < size),
        "<=": inside,
        "!=": ~(covers & inside),
        "=": covers & inside,
    }.get(op, covers)
