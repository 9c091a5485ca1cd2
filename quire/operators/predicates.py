"""The query algebra: two-valued predicates over a parent and its children.

A builder returns a :class:`Predicate`; ``&``, ``|`` and ``~`` compose them.
Every leaf is made two-valued before it can be negated, so a missing field is
simply false and its negation true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, functions as F

from ..constants import FINISHES, RARITIES
from ..functions.costs import compare_counts, cost_symbols, literal_symbols
from ..functions.masks import named_mask, popcount
from ..functions.text import kind_key, normalize_text


_NUMBER = count()


@dataclass(frozen=True)
class Predicate:
    """A boolean over one row, and whether that row must be a child's.

    ``column`` is two-valued. ``test`` is true for the same rows but may be
    null for others; a filter uses it, so plain comparisons still reach the
    scan. ``child`` marks a predicate that reads a child row; ``any_child``
    holds conditions asked of all children of a parent whichever child is
    under test, keyed by the flag column that will carry the answer.

    ``leaves`` are the conditions it is made of, each with its side, and
    ``flagged`` is the whole over one flag column a leaf: where both sides are
    read, each leaf is answered on its own side before they meet, so a column
    name that both sides have never decides anything.
    """

    column: Column
    child: bool = False
    any_child: dict[str, Column] = field(default_factory=dict)
    raw: Column | None = None
    leaves: dict[str, tuple[bool, Column]] = field(default_factory=dict)
    flagged: Column | None = None

    def __post_init__(self) -> None:
        if self.flagged is None:
            name = f"_leaf_{next(_NUMBER)}"
            object.__setattr__(self, "leaves", {name: (self.child, self.column)})
            object.__setattr__(self, "flagged", F.col(name))

    @property
    def test(self) -> Column:
        return self.column if self.raw is None else self.raw

    def _join(self, other: "Predicate", column: Column, raw: Column, flagged: Column) -> "Predicate":
        any_child = {**self.any_child, **other.any_child}
        return Predicate(column, self.child or other.child, any_child, raw, {**self.leaves, **other.leaves}, flagged)

    def __and__(self, other: "Predicate") -> "Predicate":
        return self._join(other, self.column & other.column, self.test & other.test, self.flagged & other.flagged)

    def __or__(self, other: "Predicate") -> "Predicate":
        return self._join(other, self.column | other.column, self.test | other.test, self.flagged | other.flagged)

    def __invert__(self) -> "Predicate":
        return Predicate(~self.column, self.child, self.any_child, None, self.leaves, ~self.flagged)


def holds(condition: Column, child: bool = False) -> Predicate:
    """Any Column as a leaf, two-valued."""
    return Predicate(F.coalesce(condition, F.lit(False)), child, {}, condition)


def compare(mine: Column, op: str, other: Column | float) -> Column:
    """A numeric comparison in which a missing or non-finite side is false."""
    other = other if isinstance(other, Column) else F.lit(other)
    mine, other = mine.cast("double"), other.cast("double")
    bad = F.array(F.lit("NaN").cast("double"), F.lit("Infinity").cast("double"), F.lit("-Infinity").cast("double"))
    answer = {
        ">": mine > other,
        "<": mine < other,
        ">=": mine >= other,
        "<=": mine <= other,
        "!=": mine != other,
    }.get(op, mine == other)
    finite = mine.isNotNull() & other.isNotNull() & ~F.array_contains(bad, mine) & ~F.array_contains(bad, other)
    return F.coalesce(finite & answer, F.lit(False))


def lenient_number(text: Column | None) -> Column:
    """A number from text where an empty side counts as zero and anything
    unreadable is null."""
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))


def value_number(value: str | float) -> float | None:
    """The same for the value a predicate is given."""
    if isinstance(value, (int, float)):
        return float(value)
    if value.strip() == "":
        return 0.0
    try:
        return float(value)
    except ValueError:
        return None


def mask_compare(mask: Column, op: str, value: str | int) -> Column:
    """Set comparison of a colour mask with a named set or a count."""
    count = None if isinstance(value, str) and value.strip() == "" else value_number(value)
    if count is not None:
        return compare(popcount(mask), op, count)
    if str(value).lower() in ("m", "multicolor"):
        return F.coalesce(popcount(mask) > 1, F.lit(False))
    wanted = named_mask(str(value))
    if wanted is None:
        return F.lit(False)
    if wanted == 0:
        empty = {
            ">=": F.lit(True),
            ">": mask != 0,
            "!=": mask != 0,
            "<": F.lit(False),
        }.get(op, mask == 0)
        return F.coalesce(mask.isNotNull() & empty, F.lit(False))
    size = wanted.bit_count()
    covers = mask.bitwiseAND(F.lit(wanted)) == wanted
    inside = mask.bitwiseAND(F.lit(~wanted)) == 0
    answer = {
        ":": covers,
        ">=": covers,
        ">": covers & (popcount(mask) > size),
        "<=": inside,
        "<": inside & (popcount(mask) < size),
        "!=": ~(covers & inside),
    }.get(op, covers & inside)
    return F.coalesce(answer, F.lit(False))


def _sided(own: Column, faces: Column | None, ask: Callable[[Column], Column]) -> Column:
    """Asked of the card itself or of any of its faces."""
    mine = F.coalesce(ask(own), F.lit(False))
    if faces is None:
        return mine
    return mine | F.coalesce(F.exists(faces, lambda f: F.coalesce(ask(f), F.lit(False))), F.lit(False))


def color_is(op: str, value: str | int, colors: str = "colors", faces: Column | None = None) -> Predicate:
    """``faces`` is an array of masks. A null mask names no colours and is not
    colourless."""
    return holds(_sided(F.col(colors), faces, lambda m: mask_compare(m, op, value)))


def identity_is(op: str, value: str | int, identity: str = "color_identity") -> Predicate:
    return holds(mask_compare(F.col(identity), op, value))


def text_has(value: str, column: str, child: bool = False) -> Predicate:
    """The normalised text contains the normalised value."""
    return holds(F.contains(normalize_text(F.col(column)), normalize_text(F.lit(value))), child)


def type_has(value: str, column: str = "type_line") -> Predicate:
    return text_has(value, column)


def artist_has(value: str, column: str = "artist") -> Predicate:
    return text_has(value, column, child=True)


def mana_value(op: str, value: str | float, column: str = "cmc") -> Predicate:
    number = value_number(value)
    return holds(F.lit(False) if number is None else compare(F.col(column), op, number))


def mana_cost(op: str, cost: str, column: str = "mana_cost", faces: Column | None = None) -> Predicate:
    wanted = literal_symbols(cost)
    return holds(_sided(F.col(column), faces, lambda c: compare_counts(cost_symbols(c), op, wanted)))


def stat_is(side: int, op: str, value: str | float, column: str = "stats", faces: Column | None = None) -> Predicate:
    """One side of ``a/b`` compared with a number or with the other side."""

    def ask(stats: Column) -> Column:
        part = lambda i: lenient_number(F.get(F.split(stats, "/"), F.lit(i)))
        if value in ("pow", "power"):
            other = part(0)
        elif value in ("tou", "toughness"):
            other = part(1)
        else:
            number = value_number(value)
            if number is None:
                return F.lit(False)
            other = F.lit(number)
        return compare(part(side), op, other)

    return holds(_sided(F.col(column), faces, ask))


def power(op: str, value: str | float, **kw) -> Predicate:
    return stat_is(0, op, value, **kw)


def toughness(op: str, value: str | float, **kw) -> Predicate:
    return stat_is(1, op, value, **kw)


def flag_is(
    value: str, finishes: str = "finishes", card_flags: str = "card_flags", print_flags: str = "print_flags"
) -> Predicate:
    """A finish is asked of the printing; any other word is a flag of either side."""
    wanted = value.lower()
    if wanted in FINISHES:
        return holds(F.array_contains(F.col(finishes), wanted), child=True)

    def has(flags: str) -> Column:
        return F.exists(F.coalesce(F.col(flags), F.array().cast("array<string>")), lambda f: F.lower(f) == wanted)

    return holds(has(card_flags)) | holds(has(print_flags), child=True)


def ordinal(op: str, value: str, column: str, scale: Sequence[str], child: bool = False) -> Predicate:
    """Comparison by place in a list; anything unlisted is one step below it,
    on either side."""
    mine = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in scale]), F.col(column)), F.lit(0)) - 1
    other = scale.index(value) if value in scale else -1
    return holds(compare(mine, op, float(other)), child)


def rarity(op: str, value: str, column: str = "rarity") -> Predicate:
    return ordinal(op, value, column, RARITIES, child=True)


def in_set(value: str, column: str = "set_code") -> Predicate:
    return holds(F.col(column) == value.lower(), child=True)


def set_kind(value: str, column: str = "set_type") -> Predicate:
    return holds(F.col(column) == kind_key(F.lit(value)), child=True)


def collector_is(value: str, column: str = "collector_number") -> Predicate:
    return holds(F.col(column) == value, child=True)


def lang_is(value: str, column: str = "lang") -> Predicate:
    return holds(F.col(column) == value.lower(), child=True)


def layout_is(value: str, column: str = "layout") -> Predicate:
    return holds(F.col(column) == value, child=True)


def year(op: str, value: str | float, column: str = "released_at") -> Predicate:
    number = value_number(value)
    mine = F.substring(F.col(column).cast("string"), 1, 4).try_cast("double")
    return holds(F.lit(False) if number is None else compare(mine, op, number), child=True)


def ever_printed(value: str, columns: Sequence[str] = ("set_code", "rarity", "lang")) -> Predicate:
    """Whether any child at all carries the value, whichever one is under test."""
    wanted = value.lower()
    if wanted == "paper":
        return Predicate(F.lit(True), child=True)
    condition = F.lit(False)
    for name in columns:
        condition = condition | F.coalesce(F.col(name) == wanted, F.lit(False))
    return any_child(condition, "_ever_" + "_".join([wanted, *columns]))


def any_child(condition: Column, flag: str) -> Predicate:
    """A condition asked of all children: computed once a parent as ``flag``."""
    return Predicate(F.col(flag), True, {flag: F.coalesce(condition, F.lit(False))})


def has_art(column: str = "image_status", none: Sequence[str] = ()) -> Predicate:
    from ..constants import NO_ART

    return holds(~F.col(column).isin(list(none or NO_ART)), child=True)


def two_sided(column: str = "layout") -> Predicate:
    from ..constants import TWO_SIDED_LAYOUTS

    return holds(F.col(column).isin(TWO_SIDED_LAYOUTS), child=True)


def within_scope(container: str | None, column: str = "container", everything: bool = False) -> Predicate:
    """Every stack, or one container's, or those filed nowhere."""
    if everything:
        return Predicate(F.lit(True))
    return Predicate(F.col(column).eqNullSafe(F.lit(container)))
