"""Aggregates that fold many rows into one record."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .ranking import ranked


def fold_best(
    df: DataFrame,
    key: str,
    rank: Column,
    best: Sequence[str] = (),
    fill: Sequence[str] = (),
    least: Sequence[str] = (),
    either: Sequence[str] = (),
    total: Sequence[str] = (),
    union: Sequence[str] = (),
) -> DataFrame:
    """One record a key: the best-ranked row's fields, some filled from the
    best row that has them, minima, ORs, sums and sets over all rows.

    Every part is a partial aggregate, so a key with a third of all rows is
    reduced before the shuffle.
    """
    held = df.withColumn("_rank", rank)
    parts: list[Column] = [F.min_by(c, "_rank").alias(c) for c in best]
    for c in fill:
        # Null ranks are ignored, so rows without a value never win.
        parts.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c))
    parts += [F.min(c).alias(c) for c in least]
    parts += [F.bool_or(c).alias(c) for c in either]
    parts += [F.sum(c).alias(c) for c in total]
    parts += [F.array_sort(F.collect_set(c)).alias(c) for c in union]
    return held.groupBy(key).agg(*parts)


def at_first(df: DataFrame, key: str, when: str, columns: Sequence[str]) -> DataFrame:
    """The earliest value of ``when`` and the other columns of the row holding it."""
    row = F.min(F.struct(F.col(when), *[F.col(c) for c in columns])).alias("_row")
    return df.groupBy(key).agg(row).select(key, f"_row.{when}", *[f"_row.{c}" for c in columns])


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    targets: dict[str, Callable[[Column], Column]],
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact order statistics a group: ``targets`` maps a name to the 1-based
    rank wanted out of n.

    Equal values are counted before anything is ranked, and the ranking spreads
    a hot group over tasks, so no group is gathered in one place.
    """
    # Short, and read for the ranks, for the sizes and for the check of hot groups.
    counted = materialize(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counted")
    more = {} if hot_rows is None else {"hot_rows": hot_rows}
    placed = ranked(counted, by, [F.asc(value)], rank=None, before={"_before": F.col("_n")}, **more)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_all")) if by else counted.agg(F.sum("_n").alias("_all"))
    sizes = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_all")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    held = placed.join(sizes if by else F.broadcast(sizes), same)
    picks = [
        F.max(
            F.when(
                (F.col("_before") < rank(F.col("_all"))) & (rank(F.col("_all")) <= F.col("_before") + F.col("_n")),
                F.col(value),
            )
        ).alias(name)
        for name, rank in targets.items()
    ]
    return held.groupBy(*by).agg(*picks) if by else held.agg(*picks)


def nearest_rank(share: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(share) * n)))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def fold_in_order(
    df: DataFrame, key: str, order: str, inputs: Sequence[str], start: Callable[[], Callable], name: str
) -> DataFrame:
    """A strictly ordered fold in each group, for folds whose next step depends
    on the last one: (key, order, ``name``), one row for each row.

    ``start()`` gives a group's step, called with ``inputs`` row by row to
    answer a whole number. Rows stream through in batches with many groups to
    a task, so neither long groups nor many short ones cost memory or set-up.
    """
    slim = df.select(key, order, *inputs).repartition(key).sortWithinPartitions(key, order)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, current = None, None
        for batch in batches:
            out = []
            for group, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs))):
                if step is None or group != current:
                    step, current = start(), group
                out.append(step(*values))
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(key), order: batch.column(order), name: pa.array(out, type=pa.int64())}
            )

    return slim.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{name}` long")


def fold_to_end(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], start: Callable[[], tuple[Callable, Callable]], out: str) -> DataFrame:
    """Where a strictly ordered fold ends: (key, *out), one row a group.

    ``start()`` gives a group's step, called with ``inputs`` row by row, and its
    end, which answers the values of ``out``. Rows stream through in order as
    in :func:`fold_in_order` and a group holds no more than its fold does.
    """
    slim = df.select(key, *dict.fromkeys([*order, *inputs])).repartition(key).sortWithinPartitions(key, *order)
    kinds = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(kinds)
        step, end, current = None, None, None

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        for batch in batches:
            out = []
            for group, *values in zip(*(batch.column(c).to_pylist() for c in (key, *inputs))):
                if step is None or group != current:
                    if step is not None:
                        out.append((current, *end()))
                    (step, end), current = start(), group
                step(*values)
            if out:
                yield told(out)
        if step is not None:
            yield told([(current, *end())])

    return slim.mapInArrow(run, kinds)


# Characters of one group's lines put together in one row; past it the hash is
# fed line by line instead.
DIGEST_CHARS = 16_000_000


def content_digest(df: DataFrame, by: Sequence[str], line: str, name: str = "digest", limit: int = DIGEST_CHARS) -> DataFrame:
    """SHA-256 over a group's lines, sorted and joined by newlines.

    Equal lines are counted first. A group whose text is bounded is one row's
    aggregate; a larger one is streamed through the hash in order, to the same
    answer.
    """
    counted = df.groupBy(*by, line).agg(F.count(F.lit(1)).alias("_n"))
    size = F.sum((F.length(line) + 1).cast("long") * F.col("_n"))
    over = counted.groupBy(*by).agg(size.alias("_size")).filter(F.col("_size") > limit).select(*by)

    def small(rows: DataFrame) -> DataFrame:
        repeated = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_n")), lambda _: F.col(line))
        joined = F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), F.array_join(repeated, "\n").alias("text"))))
        text = F.array_join(F.transform(joined, lambda x: x["text"]), "\n")
        return rows.groupBy(*by).agg(F.concat(F.lit("sha256-"), F.sha2(text.cast("binary"), 256)).alias(name))

    if over.isEmpty():
        return small(counted)

    keys = list(by)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + f", {name} string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, types = None, None, None

        def row():
            out = {c: pa.array([v], type=t) for c, v, t in zip(keys, current, types)}
            out[name] = pa.array([f"sha256-{held.hexdigest()}"])
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            for text, n, *group in zip(*(batch.column(c).to_pylist() for c in (line, "_n", *keys))):
                data, begun = text.encode(), held is not None and group == current
                if not begun:
                    if held is not None:
                        yield row()
                    held, current = hashlib.sha256(), group
                for _ in range(n):
                    held.update(b"\n" + data if begun else data)
                    begun = True
        if held is not None:
            yield row()

    large = counted.join(over, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, line)
    return small(counted.join(over, keys, "left_anti")).unionByName(large.mapInArrow(stream, schema))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A content name no partitioning or row order changes: row hashes folded
    by XOR and by a modular sum, with the count."""
    held = [F.col(c) for c in sorted(columns or df.columns)]
    one, two = F.xxhash64(*held), F.xxhash64(F.lit(1), *held)
    folded = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(one).alias("_x"),
        F.sum(two.cast("decimal(38,0)")).alias("_s"),
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.hex("_x"), F.col("_s").cast("string"))
    return folded.select("rows", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def shape_counts(df: DataFrame, present: dict[str, Column]) -> DataFrame:
    """How many rows carry each optional field, in one pass."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f) for f, c in present.items()])


def gate_outcome(written: Column, skipped: Column, before: Column, seen: dict[str, Column]) -> Column:
    """Which gate refuses an ingest, asked in order, or ``synced``."""
    from ..constants import KEEP_SHARE, SKIP_MINIMUM, SKIP_SHARE

    read = written + skipped
    none_of = F.lit(False)
    for count in seen.values():
        none_of = none_of | (count == 0)
    return (
        F.when(written == 0, F.lit("empty"))
        .when((read >= SKIP_MINIMUM) & (skipped > read * SKIP_SHARE), F.lit("skipped"))
        .when(F.coalesce(written < before * KEEP_SHARE, F.lit(False)), F.lit("shrunk"))
        .when(none_of, F.lit("shape"))
        .otherwise(F.lit("synced"))
    )


def missing_fields(seen: dict[str, Column]) -> Column:
    """Names of the fields no row carried."""
    return F.array_join(F.array_compact(F.array(*[F.when(c == 0, F.lit(f)) for f, c in seen.items()])), ", ")
