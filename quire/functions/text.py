"""Text functions as Columns: everything here stays inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column, functions as F

_MARK = regex.compile(r"\p{Diacritic}")

_HANGUL = (0xAC00, 0xD7A3)


def bare(text: str) -> str:
    """A driver-side text decomposed and stripped of its marks."""
    opened = unicodedata.normalize("NFD", text)
    return _MARK.sub("", opened)


@lru_cache(maxsize=1)
def _unaccent_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters opened and stripped of their marks, worked out from the Unicode
    data on the driver: one-to-one pairs, deletions, and the few that open
    into several letters."""
    source, target, gone, several = [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or _HANGUL[0] <= point <= _HANGUL[1]:
            continue
        char = chr(point)
        plain = bare(char)
        if plain == char:
            continue
        if not plain:
            gone.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            several.append((char, plain))
    # `translate` drops what has no counterpart, so deletions go last. The two
    # ASCII marks of the same class go with them.
    return "".join(source) + "".join(gone) + "^`", "".join(target), several


def _letters(text: str) -> Column:
    """A literal array of characters, built from one string."""
    return F.split(F.lit(text), "")


def _span(first: int, count: int) -> str:
    return "".join(chr(first + i) for i in range(count))


def _open_hangul(text: Column) -> Column:
    lead, vowel, tail = (_letters(_span(*at)) for at in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def one(char: Column) -> Column:
        at = F.ascii(char) - _HANGUL[0]
        last = (at % 28).cast("int")
        split = F.concat(
            F.get(lead, F.floor(at / 588).cast("int")),
            F.get(vowel, F.floor((at % 588) / 28).cast("int")),
            F.when(last > 0, F.get(tail, last - 1)).otherwise(F.lit("")),
        )
        return F.when((at >= 0) & (at <= _HANGUL[1] - _HANGUL[0]), split).otherwise(char)

    return F.array_join(F.transform(_letters_of(text), one), "")


def _letters_of(text: Column) -> Column:
    return F.split(text, "")


def _open_several(text: Column, several: list[tuple[str, str]]) -> Column:
    pairs = F.split(F.lit(",".join(f"{a}={b}" for a, b in several)), ",")
    return F.aggregate(
        pairs,
        text,
        lambda held, pair: F.replace(held, F.substring_index(pair, "=", 1), F.substring_index(pair, "=", -1)),
    )


def _class_of(letters: list[str]) -> str:
    """A pattern for any of some letters, neighbours written as a range."""
    runs: list[list[int]] = []
    for point in sorted(map(ord, letters)):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def strip_marks(text: Column) -> Column:
    """Canonical decomposition with every diacritic dropped."""
    source, target, several = _unaccent_tables()
    opened = F.translate(text, source, target)
    # Only scripts past Cyrillic hold letters that open into several; one range
    # test keeps most off the long way, and a test for these very letters keeps
    # off it what has but a dash or a curly quote from there.
    wide = F.when(text.rlike(r"[\uAC00-\uD7A3]"), _open_hangul(opened)).otherwise(opened)
    far = F.when(text.rlike(_class_of([a for a, _ in several])), _open_several(wide, several)).otherwise(wide)
    full = F.when(text.rlike(r"[\u0600-\x{10FFFF}]"), far).otherwise(opened)
    return F.when(text.rlike(r"^[\x00-\x5D\x5F\x61-\x7F]*$"), text).otherwise(full)


def normalize_text(text: Column) -> Column:
    """What two spellings of a name share: no marks, lower case, apostrophes
    gone, every other run of non-letters one space, trimmed."""
    plain = F.translate(F.lower(strip_marks(text)), "'’", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def fold_key(text: Column) -> Column:
    """Column names and vocabulary words with case and spacing ignored."""
    return F.regexp_replace(F.lower(text), r"[\s_-]", "")


def kind_key(text: Column) -> Column:
    """``Draft Innovation`` or ``draft-innovation`` as ``draft_innovation``."""
    return F.regexp_replace(F.lower(text), r"[\s-]+", "_")


def spaced_words(text: Column) -> Column:
    """camelCase or snake_case as lower-case words."""
    return F.lower(F.replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def product_words(kind: Column, plain: list[str]) -> Column:
    """The words of a set kind, or null for the kinds that go without saying."""
    return F.when(~kind.isin(plain), spaced_words(kind))


def readable_name(name: Column) -> Column:
    """The name, or null where it holds a private-use character."""
    return F.when((name != "") & ~name.rlike(r"[\x{E000}-\x{F8FF}]"), name)


def card_name(name: Column, printed: Column, lang: Column, wanted: str) -> Column:
    """The printed name where the printing is in the reader's language and its
    name can be read, else the card's own, with the language it is in."""
    usable = (lang == wanted) & readable_name(printed).isNotNull()
    return F.when(
        F.coalesce(usable, F.lit(False)),
        F.struct(printed.alias("text"), lang.alias("lang")),
    ).otherwise(F.struct(name.alias("text"), F.lit("en").alias("lang")))


def language_tag(tag: Column) -> Column:
    """A BCP-47 tag as a catalog language code; Chinese by script or region."""
    parts = F.split(F.lower(tag), "-")
    base = F.get(parts, F.lit(0))
    traditional = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("hant", "tw", "hk")]))
    return F.when(base != "zh", base).when(traditional, F.lit("zht")).otherwise(F.lit("zhs"))


def plain_slug(text: Column, default: str = "cards") -> Column:
    """A file name any file system takes."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def natural_key(text: Column) -> Column:
    """A key under which 9 sorts before 10 and ``329x`` right after ``329``.

    Digit runs lose leading zeros and gain a fixed-width length in front, so a
    plain string comparison orders them as numbers of any size.
    """

    def piece(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        padded = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(run.rlike("^[0-9]"), padded).otherwise(F.lower(run))

    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, piece), "")


def words(text: Column) -> Column:
    """Lower-case words of a passage, code and punctuation dropped."""
    open_code = F.regexp_replace(text, "(?s)```.*?```", " ")
    open_code = F.regexp_replace(open_code, "`[^`]*`", " ")
    plain = F.trim(F.regexp_replace(F.lower(open_code), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def describe_print(set_name: Column, set_code: Column, number: Column, *more: Column) -> Column:
    """One display line: where a printing sits, then whatever else is known."""
    head = F.concat(set_name, F.lit(" · "), F.upper(set_code), F.lit(" #"), number)
    return F.concat_ws(" · ", head, *[F.when(m != "", m) for m in more])


def image_url(base: str, key: Column, size: str, side: str = "front", suffix: str = "jpg") -> Column:
    """Where an image is served from: fanned out by the id's first two characters."""
    return F.concat(
        F.lit(f"{base}/{size}/{side}/"),
        F.substring(key, 1, 1),
        F.lit("/"),
        F.substring(key, 2, 1),
        F.lit("/"),
        key,
        F.lit(f".{suffix}"),
    )
