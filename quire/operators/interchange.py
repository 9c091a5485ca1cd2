"""Vendor files: which format a header fits, rows bound and judged, rows and
losses of an export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    FILLED_FIELDS,
    FLAG_TAGS,
    MAX_COPIES,
    NOTE_BYTES,
    NOTE_GRAPHEMES,
    OWN_BINDING,
    UUID_PATTERN,
    VENDOR_BINDING,
    VENDOR_HEADER,
)
from ..functions import values as v
from ..functions.clip import clip_text
from ..functions.text import fold_key
from .lookups import print_key


@dataclass(frozen=True)
class Format:
    """Which column feeds each field; read the other way, what an export writes."""

    name: str
    binding: dict[str, str]
    header: Sequence[str] = ()
    refuses: Sequence[str] = ()
    optional: Sequence[str] = ()

    @property
    def columns(self) -> list[str]:
        return list(self.header) or list(self.binding.values())

    @property
    def needed(self) -> list[str]:
        naming = ["scryfallId"] if "scryfallId" in self.binding else ["setCode", "collectorNumber"]
        return [*naming, "finish", "quantity"]

    @property
    def telling(self) -> list[str]:
        """Columns a header must have to be taken for this format."""
        return [c for f, c in self.binding.items() if f not in FILLED_FIELDS and f not in self.optional]


VENDOR = Format("vendor", VENDOR_BINDING, VENDOR_HEADER, refuses=("ph",), optional=("signed", "proxy"))
OWN = Format("own", OWN_BINDING)
FORMATS = [VENDOR, OWN]


def as_paid(format_: Format) -> Format | None:
    """The same file with its market value read as the price paid, where it has
    one and binds no price of its own."""
    binding = dict(format_.binding)
    if "marketValue" not in binding or "price" in binding or "currency" in binding:
        return None
    binding["price"] = binding.pop("marketValue")
    if "marketCurrency" in binding:
        binding["currency"] = binding.pop("marketCurrency")
    return replace(format_, binding=binding)


def _key(text: str) -> str:
    return "".join(c for c in text.lower() if not c.isspace() and c not in "_-")


def detect_format(head: Column, formats: Sequence[Format] = FORMATS) -> Column:
    """The first format all of whose telling columns a header has, or null."""
    names = F.transform(head, fold_key)
    found = F.lit(None).cast("string")
    for one in reversed(formats):
        wanted = F.array(*[F.lit(_key(c)) for c in one.telling])
        found = F.when(F.size(F.array_except(wanted, names)) == 0, F.lit(one.name)).otherwise(found)
    return found


def missing_columns(head: Column, format_: Format) -> Column:
    """The needed columns a header lacks, spelled as the file would have."""
    names = F.transform(head, fold_key)
    spelled = [(format_.binding.get(f, f)) for f in format_.needed]
    return F.array_join(
        F.array_compact(F.array(*[F.when(~F.array_contains(names, _key(c)), F.lit(c)) for c in spelled])), ", "
    )


def bind_columns(records: DataFrame, heads: DataFrame, format_: Format) -> DataFrame:
    """Every record after its file's header as named, trimmed text cells; a
    field the file does not carry is empty. The header is one row a file."""
    wanted = {f: _key(c) for f, c in format_.binding.items()}
    where = heads.select(
        "file", "head_line", *[F.array_position(F.transform("head", fold_key), k).alias(f"_p_{f}") for f, k in wanted.items()]
    )
    rows = records.join(where, "file").filter(F.col("line") > F.col("head_line"))
    rows = rows.filter(F.size("fields") >= len(format_.needed))

    def cell(name: str) -> Column:
        at = F.col(f"_p_{name}")
        return F.trim(F.coalesce(F.get("fields", (at - 1).cast("int")), F.lit("")))

    return rows.select("file", "line", *[cell(f).alias(f) for f in wanted])


def _cell(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def judge_rows(rows: DataFrame, format_: Format) -> DataFrame:
    """Each bound row with the reason it cannot be read, or null; the checks
    are made in order and the first that fails is the reason."""
    by_id = "scryfallId" in format_.binding
    set_code, number = _cell(rows, "setCode"), _cell(rows, "collectorNumber")
    named = (F.col("scryfallId") != "") if by_id else (set_code != "") & (number != "")
    count = F.col("quantity").try_cast("double")
    whole = count.isNotNull() & (count == F.floor(count)) & (count >= 1) & (count <= MAX_COPIES)
    reason = F.when(~named, F.lit("no print"))
    if by_id:
        reason = reason.when(~F.col("scryfallId").rlike(UUID_PATTERN), F.concat(F.lit("no such print "), F.col("scryfallId")))
    reason = reason.when(v.finish_in(F.col("finish")).isNull(), F.concat(F.lit("unknown finish "), F.col("finish")))
    reason = reason.when(~F.coalesce(whole, F.lit(False)), F.concat(F.col("quantity"), F.lit(" is not a count")))
    said = F.when((set_code != "") & (number != ""), F.concat(set_code, F.lit(" "), number)).otherwise(
        F.col("scryfallId") if by_id else F.lit("")
    )
    return rows.withColumns({"reason": reason, "said": said})


def stacks_of(rows: DataFrame, now: str) -> DataFrame:
    """Accepted rows as stacks: graded, tagged, their purchase as one lot."""
    cell = lambda name: _cell(rows, name)
    count = F.col("quantity").try_cast("double").cast("long")
    paid = v.money_pair(cell("price"), cell("currency"))
    worth = v.money_pair(cell("marketValue"), cell("marketCurrency"))
    at = v.gated_timestamp(cell("acquiredAt"))
    lot = F.struct(
        count.alias("quantity"),
        at.alias("at"),
        F.when(paid, cell("price")).alias("price"),
        F.when(paid, F.upper(cell("currency"))).alias("currency"),
        F.when(worth, cell("marketValue")).alias("marketValue"),
        F.when(worth, F.upper(cell("marketCurrency"))).alias("marketCurrency"),
    )
    tags = v.tags_of({t: cell(t) for t in FLAG_TAGS}, cell("tags"))
    note = clip_text(cell("note"), NOTE_BYTES, NOTE_GRAPHEMES)
    return rows.select(
        "file",
        "line",
        "said",
        F.when(cell("scryfallId") != "", F.lower(cell("scryfallId"))).alias("printing"),
        print_key(cell("setCode"), cell("collectorNumber")).alias("print_key"),
        v.finish_in(F.col("finish")).alias("finish"),
        count.alias("quantity"),
        v.grade_in(cell("condition")).alias("condition"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
        F.when(note != "", note).alias("note"),
        F.when(v.flag_in(cell("proxy")), F.lit(True)).alias("proxy"),
        F.coalesce(v.gated_timestamp(cell("createdAt")), F.lit(now)).alias("created"),
        v.gated_timestamp(cell("updatedAt")).alias("updated"),
        F.when(paid | worth | at.isNotNull(), F.array(lot)).alias("lots"),
    )


def name_by_key(stacks: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows named by set and number resolved through ``located`` (print_key,
    id); those the catalog cannot name come back as rejects."""
    named = stacks.join(located.select("print_key", F.col("id").alias("_id")), "print_key", "left")
    held = named.withColumn("printing", F.coalesce("printing", "_id")).drop("_id")
    lost = held.filter(F.col("printing").isNull()).select("file", "line", F.concat(F.lit("no such print "), "said").alias("reason"))
    return held.filter(F.col("printing").isNotNull()), lost


def check_finishes(stacks: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose printing was never made in their finish come back as rejects;
    a printing the catalog does not know is passed over. ``made`` is (printing,
    finishes)."""
    held = stacks.join(made.select("printing", F.col("finishes").alias("_made")), "printing", "left")
    wrong = F.col("_made").isNotNull() & ~F.array_contains("_made", F.col("finish"))
    reason = F.concat(F.col("said"), F.lit(" is "), F.array_join("_made", " and "), F.lit(" only, not "), F.col("finish"))
    return (
        held.filter(~wrong).drop("_made"),
        held.filter(wrong).select("file", "line", reason.alias("reason")),
    )


LOT_SAYS = {"price": "price", "marketValue": "marketValue", "acquiredAt": "at"}


def spend_stack_lots(stacks: DataFrame, format_: Format, quantity: str = "quantity", lots: str = "lots") -> DataFrame:
    """One row a lot, capped at the copies held, then one for copies no lot
    covers. A stack holds at most 64 lots, so this stays inside its row.

    ``unspent`` counts lots past the copies that this format had words for.
    """
    whole = F.transform(F.col(lots), lambda l: l.withField("quantity", F.floor(l["quantity"]).cast("long")))
    real = F.filter(F.coalesce(whole, F.array().cast(stacks.schema[lots].dataType)), lambda l: l["quantity"] >= 1)
    rows = stacks.withColumn("_lots", real).withColumn(
        "_before",
        F.transform(
            F.sequence(F.lit(0), F.size("_lots")),
            lambda i: F.aggregate(F.slice("_lots", F.lit(1), i), F.lit(0).cast("long"), lambda a, l: a + l["quantity"].cast("long")),
        ),
    )
    copies = F.col(quantity).cast("long")
    says = [LOT_SAYS[f] for f in LOT_SAYS if f in format_.binding]

    def carried(lot: Column) -> Column:
        said = F.lit(False)
        for name in says:
            said = said | (F.trim(F.coalesce(lot[name], F.lit(""))) != "")
        return said

    spent = F.transform(
        "_lots",
        lambda l, i: F.struct(
            F.greatest(F.lit(0).cast("long"), F.least(l["quantity"].cast("long"), copies - F.get("_before", i))).alias("take"), l.alias("lot")
        ),
    )
    rest = copies - F.element_at("_before", -1)
    none = F.lit(None).cast(stacks.schema[lots].dataType.elementType)
    given = F.filter(spent, lambda s: s["take"] > 0)
    extra = F.when(rest > 0, F.array(F.struct(rest.alias("take"), none.alias("lot")))).otherwise(
        F.slice(F.array(F.struct(rest.alias("take"), none.alias("lot"))), 1, 0)
    )
    unspent = F.size(F.filter(spent, lambda s: (s["take"] == 0) & carried(s["lot"])))
    return rows.withColumn("unspent", unspent).withColumn("_given", F.explode(F.concat(given, extra))).select(
        *stacks.columns, "unspent", F.col("_given.take").alias("take"), F.col("_given.lot").alias("lot")
    )


def loss_report(stacks: DataFrame, format_: Format) -> DataFrame:
    """What an export loses, in one pass: copies unnamed, unspelled, not kept
    or refused, and the fields no column holds.

    Columns: quantity, finish, known, lang, tags, lots, condition, container,
    note, proxy, updated.
    """
    bound = format_.binding
    copies = F.col("quantity")
    lots = F.coalesce(F.col("lots"), F.array().cast(stacks.schema["lots"].dataType))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    comma = F.exists(tags, lambda t: F.contains(t, F.lit(","))) if "tags" in bound else F.lit(False)
    vague = comma | F.exists(lots, lambda l: ~v.legible_lot(l))
    any_lot = lambda name: F.exists(lots, lambda l: l[name].isNotNull())
    fills = {
        "container": F.col("container").isNotNull(),
        "note": F.col("note").isNotNull(),
        "proxy": F.coalesce(F.col("proxy"), F.lit(False)),
        "condition": F.col("condition").isNotNull(),
        "price": any_lot("price"),
        "currency": any_lot("currency"),
        "marketValue": any_lot("marketValue"),
        "marketCurrency": any_lot("marketCurrency"),
        "acquiredAt": any_lot("at"),
        "createdAt": F.lit(True),
        "updatedAt": F.col("updated").isNotNull(),
    }
    kept_flags = [t for t in FLAG_TAGS if t in bound]
    homeless = F.lit(False) if "tags" in bound else F.exists(tags, lambda t: ~t.isin(kept_flags) if kept_flags else F.lit(True))
    lost = {f: c for f, c in fills.items() if f not in bound}
    lost["tags"] = homeless
    total = lambda c: F.coalesce(F.sum(F.when(c, copies)), F.lit(0)).cast("long")
    held = stacks.filter(copies >= 1)
    sums = held.agg(
        total(~F.col("known")).alias("unnamed"),
        total(v.finish_out(F.col("finish")).isNull()).alias("unspelled"),
        total(vague).alias("unkept"),
        total(F.col("lang").isin(list(format_.refuses)) if format_.refuses else F.lit(False)).alias("refused"),
    )
    flags = stacks.agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"_d_{f}") for f, c in lost.items()],
        F.coalesce(F.bool_or(F.col("container").isNotNull()), F.lit(False)).alias("_u"),
    )
    dropped = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_d_{f}"), F.lit(f)) for f in lost])), ",")
    unread = F.when(F.col("_u"), F.lit("container")).otherwise(F.lit("")) if "container" in bound else F.lit("")
    return sums.join(F.broadcast(flags)).select(
        "unnamed", "unspelled", "unkept", "refused", dropped.alias("dropped"), unread.alias("unread")
    )


def export_cells(rows: DataFrame, format_: Format, english: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One output cell a column of the format, from rows holding the stack, its
    printing's facts (null where unknown) and one lot; ``place`` is the name of
    the container, where the format has a column for it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    lang = F.coalesce(F.col("lang"), F.lit(""))
    if english and format_.refuses:
        lang = F.when(lang.isin(list(format_.refuses)), F.lit("en")).otherwise(lang)
    cells = {
        "scryfallId": text(F.col("printing")),
        "name": text(F.col("name")),
        "setCode": text(F.upper("set_code")),
        "setName": text(F.col("set_name")),
        "collectorNumber": text(F.col("collector_number")),
        "rarity": text(F.col("rarity")),
        "language": lang,
        "finish": F.coalesce(v.finish_out(F.col("finish")), F.col("finish")),
        "quantity": text(F.col("take")),
        "condition": text(v.grade_out(F.col("condition"))),
        "container": text(F.col("place")) if "place" in rows.columns else F.lit(""),
        **{t: v.flag_out(F.array_contains(tags, t)) for t in FLAG_TAGS},
        "tags": F.array_join(tags, ","),
        "note": text(F.col("note")),
        "proxy": v.flag_out(F.col("proxy")),
        "price": text(F.col("lot.price")),
        "currency": text(F.col("lot.currency")),
        "marketValue": text(F.col("lot.marketValue")),
        "marketCurrency": text(F.col("lot.marketCurrency")),
        "acquiredAt": text(F.col("lot.at")),
        "createdAt": text(F.col("created")),
        "updatedAt": text(F.col("updated")),
    }
    by_column = {c: f for f, c in format_.binding.items()}
    return rows.select(
        *keep,
        *[(cells[by_column[c]] if c in by_column else F.lit("")).alias(c) for c in format_.columns]
    )
