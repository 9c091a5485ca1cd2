"""JSON lines as typed rows, with a reason for every line that is not one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import MAX_LINE_BYTES
from .text_lines import numbered_lines, split_sizes

_CORRUPT = "_corrupt"


def scan_json_lines(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    required: Sequence[str] = (),
    checks: dict[str, Column] | None = None,
    splittable: bool = True,
    spread: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): typed rows with their file and line, and (file, line,
    reason) for the lines that are no such row.

    Blank lines are passed over. A missing required field, a field of the
    wrong type or a failed check refuses the one line. A line over the limit
    or of broken text fails the whole read, as no file holding one is what it
    says it is. A gzip file is one split, so lines are spread over tasks
    before they are parsed; ``splittable`` says the files are not compressed.
    """
    lines = numbered_lines(spark, path, split_sizes(spark, path) if splittable else None)
    fatal = (F.octet_length("value") >= MAX_LINE_BYTES) | ~F.is_valid_utf8("value")
    where = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is too long or not text"))
    lines = lines.withColumn("value", F.when(fatal, F.raise_error(where).cast("string")).otherwise(F.regexp_replace("value", "\r$", "")))
    lines = lines.filter(F.trim("value") != "")
    lines = lines.repartition(spread) if spread else lines.repartition(F.col("line"))

    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    # Parsed as a row and as what was said, each once: as columns of their own they are not put in where they are used.
    parsed = lines.withColumns({"row": F.from_json("value", full, options), "_said": F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))})
    shape = F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull() | ~_strict(F.col("_said"), schema)
    reason = F.when(shape, F.lit("not a record of this shape"))
    for name in required:
        reason = reason.when(F.col(f"row.{name}").isNull(), F.lit(f"no {name}"))
    for text, bad in (checks or {}).items():
        reason = reason.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    judged = parsed.select("file", "line", "row", reason.alias("reason"))
    good = judged.filter(F.col("reason").isNull()).select("file", "line", *[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])
    rejects = judged.filter(F.col("reason").isNotNull()).select("file", "line", "reason")
    return good, rejects


def _strict(whole: Column, schema: T.StructType) -> Column:
    """Whether a line, read in brackets, is one JSON value and its fields are of the kinds wanted.

    The parser by itself reads a number or an object as text and passes over
    what follows a value. In brackets, what follows breaks the array or makes
    it longer; a field's own kind is read before any conversion.
    """
    ok = F.coalesce(F.try_variant_get(whole, "$[0]", "variant").isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull(), F.lit(False))
    for f in schema.fields:
        kind = F.schema_of_variant(F.try_variant_get(whole, f"$[0]['{f.name}']", "variant"))
        if isinstance(f.dataType, T.StringType):
            fits = kind == "STRING"
        elif isinstance(f.dataType, T.BooleanType):
            fits = kind == "BOOLEAN"
        elif isinstance(f.dataType, T.ArrayType):
            wanted = "ARRAY<(STRING|VOID)>" if isinstance(f.dataType.elementType, T.StringType) else "ARRAY<"
            fits = kind.rlike(f"^{wanted}")
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            fits = kind.startswith("OBJECT")
        else:
            fits = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        ok = ok & F.coalesce(fits | (kind == "VOID"), F.lit(True))
    return ok


def bulk_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a bulk index file; fields nobody reads are ignored."""
    schema = (
        "object string, has_more boolean, data array<struct<id:string,type:string,name:string,"
        "updated_at:string,jsonl_download_uri:string,compressed_size:bigint>>"
    )
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("e")).select("e.*")


def bulk_entry(index: DataFrame, kind: str) -> DataFrame:
    """The index's first entry of one kind in file order, or nothing."""
    placed = index.withColumn("_place", F.monotonically_increasing_id()).filter(F.col("type") == kind)
    return placed.orderBy("_place").limit(1).drop("_place")


def version_gate(index: DataFrame, synced: DataFrame, schema_version: int) -> DataFrame:
    """Entries not yet ingested under this schema version. Versions are only
    the same or not; no order is read into them."""
    done = synced.filter(F.col("schema_version") == schema_version).select(F.col("kind").alias("type"), "updated_at")
    return index.join(done.distinct(), ["type", "updated_at"], "left_anti")
