"""CSV as records that know the line they start on.

Quotes decide where a record ends, and a quote anywhere turns quoting on or
off, so a line starts a record exactly where an even number of quotes comes
before it in its file. That is a running sum, which Spark distributes; only
the lines of one record are ever put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import HOT_ROWS, ranked
from .text_lines import numbered_lines, split_sizes


# Possessive loops: a field of any length is walked, never backed out of.
_QUOTED = r'"((?:[^"]++|"")*+)(?:"|\z)'
_FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|\z))*+)'


def split_record(record: Column) -> Column:
    """A record's fields, unquoted."""
    # A leading comma gives every field, an empty one included, a comma before it.
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def unquoted(field: Column) -> Column:
        bare = F.replace(F.regexp_replace(field, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
        return F.when(F.contains(field, F.lit('"')), bare).otherwise(field)

    return F.transform(raw, unquoted)


def scan_csv_lined(spark: SparkSession, path: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file, line, fields): every record of every file, LF, CRLF or CR ended,
    a leading byte-order mark dropped, rows as ragged as they come."""
    ended = F.concat("value", F.lit("\n"))
    # Each piece keeps its own ending, which matters inside quotes only.
    pieces = F.regexp_extract_all(ended, F.lit("([^\r\n]*(?:\r\n|\r|\n))"), F.lit(1))
    sizes = split_sizes(spark, path, pieces)
    longest = sizes.groupBy("file").agg(F.sum("_n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    hot = longest > hot_rows
    lines = numbered_lines(spark, path, sizes, pieces)
    lines = lines.withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^\uFEFF", "")).otherwise(F.col("value")))
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    opened = ranked(lines, ["file"], [F.asc("line")], rank=None, before={"_quotes": quotes}, hot=hot)
    starts = opened.withColumn("_start", (F.col("_quotes") % 2 == 0).cast("long"))
    placed = ranked(starts, ["file"], [F.asc("line")], rank=None, before={"_records": F.col("_start")}, hot=hot)
    record = placed.withColumn("_record", F.col("_records") + F.col("_start"))
    whole = record.groupBy("file", "_record").agg(
        F.min("line").alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "").alias("_text"),
    )
    # A quote nothing closes runs to the end of the file, its last ending too.
    quoted = F.length("_text") - F.length(F.replace("_text", F.lit('"'), F.lit("")))
    record = F.when(quoted % 2 == 0, F.regexp_replace("_text", "(\r\n|\r|\n)$", "")).otherwise(F.col("_text"))
    return whole.select("file", "line", split_record(record).alias("fields"))


def header_of(records: DataFrame) -> DataFrame:
    """(file, head): the first record of each file."""
    return records.groupBy("file").agg(F.min_by("fields", "line").alias("head"), F.min("line").alias("head_line"))


def csv_field(text: Column) -> Column:
    """A field quoted only where a bare one would read as something else."""
    held = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(held, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(held.rlike('["\r\n,]'), quoted).otherwise(held)


def csv_line(columns: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def write_csv(df: DataFrame, path: str, header: Sequence[str], order: str) -> None:
    """Text files that are each a whole CSV under the header, LF ended, rows by
    the ``order`` column, which is not written, from file to file. No rows
    leave one file of the header alone."""
    line = csv_line([F.col(c).cast("string") for c in df.columns if c != order])
    head = csv_line([F.lit(h) for h in header])
    if df.isEmpty():
        df.sparkSession.range(1).coalesce(1).select(head.alias("value")).write.text(path)
        return
    placed = df.select(F.col(order).alias("_key"), line.alias("value")).repartitionByRange(F.asc("_key")).sortWithinPartitions(F.asc("_key"))
    # Ids start anew, from a multiple of 2**33, in every partition and so in every file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    placed.select(F.when(first, F.concat(head, F.lit("\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)
