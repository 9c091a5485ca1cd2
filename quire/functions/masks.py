"""Sets of words as bit masks, and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..constants import COLOR_NAMES, COLORS


def letters_mask(letters: str) -> int:
    """A literal's mask, folded before the plan is made."""
    return sum(1 << COLORS.index(one) for one in set(letters))


def color_mask(text: Column) -> Column:
    """Bits of the colours a text names; null in, null out."""
    bits = [F.when(F.contains(text, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(COLORS)]
    return F.when(text.isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), bits))


def canonical_colors(colors: Column) -> Column:
    """Colour letters in their conventional order, repeats kept."""
    order = F.array(*[F.lit(c) for c in COLORS])
    return F.array_join(
        F.array_sort(
            colors,
            lambda a, b: (F.array_position(order, a) - F.array_position(order, b)).cast("int"),
        ),
        "",
    )


def flags_mask(*flags: Column) -> Column:
    """Bit i set where the i-th condition holds; a missing one does not."""
    bits = [
        F.when(F.coalesce(f.cast("boolean"), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, f in enumerate(flags)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def words_mask(items: Column, names: Sequence[str]) -> Column:
    """Bits of an array's members over a short dictionary; others ignored."""
    bits = [
        F.when(F.coalesce(F.array_contains(items, n), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, n in enumerate(names)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0))


def mask_words(mask: Column, names: Sequence[str]) -> Column:
    """The dictionary words whose bits are set, in dictionary order."""
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])
    )


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit words differ."""
    return F.bit_count(a.bitwiseXOR(b))


def named_mask(value: str) -> int | None:
    """The mask a colour word, guild name or letter run stands for; None where
    it names no colour at all."""
    named = COLOR_NAMES.get(value.lower())
    if named is not None:
        return letters_mask(named)
    letters = value.upper()
    if letters and all(c in COLORS for c in letters):
        return letters_mask(letters)
    return None
