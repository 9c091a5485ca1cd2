"""What each of several filters removes in every order, from a stream.

All files are taken as micro-batches. A row's mask says which filters it fails;
whether its text was met under a smaller id is known only from state, one value
a text: the smallest id so far and the rows that have it. When a smaller id
arrives, those rows are retracted from the counters of their part and counted
anew as copies. What the stream hands on are changes of (part, mask) counters,
so any prefix of the stream adds up to the right counts of what it has read.

Rows that no state can change, larger ids of one text in one task and rows
without an id, are counted where they are read and only pass by the state, so a
text of a third of all rows sends it one row a task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sizes import at_most
from ..session import fresh_path, materialize
from ..streaming.keyed import any_table, files_a_batch, run_available
from ..streaming.tables import read_batches, write_batch

FILTERS = "ABCDE"
#: The filter that needs the state: the text was met under a smaller id.
COPY = 16
#: Micro-batches to make of the files there are.
BATCHES = 4
#: Texts a task holds before it hands them on.
HELD = 50_000
#: Tasks that share the rows of one id where labels are joined by shuffle, and labels that are not.
SHARES, SMALL = 16, 200_000
CHANGE = "part string, mask int, good boolean, toxic boolean, n bigint"
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # the bytes of a character after its first
_MARKS = b"#$%&*|"


def mask(text: bytes) -> int:
    """Which of the first four filters a text fails: 1 under 200 words, 2 fewer
    than half of them distinct, 4 over 3 % capitals, 8 any of ``#$%&*|``."""
    words = text.split()
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * len(text.translate(None, _INNER))) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _marked(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """id, key (SHA-256 of the text), part, mask: one short row a document."""

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), batch.column("part"),
                 pa.array([mask(x) for x in texts], pa.int32())],
                ["id", "key", "part", "mask"])

    kind = docs.schema[id].dataType.simpleString()
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return plain.mapInArrow(run, f"id {kind}, key binary, part string, mask int")


def _labelled(rows: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """``rows`` with good and toxic; an id labelled twice has what either label says."""

    def says(label):
        return F.coalesce(F.max(F.col(label) == 1), F.lit(False))

    told = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = materialize(told.filter("good or toxic"), "labels")
    if at_most(told, SMALL):  # short rows
        joined = rows.join(F.broadcast(told), "id", "left")
    else:
        # Rows without an id, or many of one id, meet their label in several tasks.
        share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int")
        told = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        # Spark's estimate leaves the shares out: unhinted, it may send all of them to the driver to be broadcast.
        joined = rows.withColumn("share", share).join(told.hint("merge"), ["id", "share"], "left")
    return joined.select("key", "id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def fold(least, rows: Counter, id, row: tuple, n: int, changes: Counter):
    """Take ``n`` rows of one text under ``id`` to the smallest id so far and its
    ``rows``; what that changes goes to ``changes``. The smallest id after."""
    part, mask, good, toxic = row
    copy = part, mask | COPY, good, toxic
    if least is not None and id > least:
        changes[copy] += n
        return least
    if least is None or id < least:
        for (p, m, g, t), k in rows.items():
            changes[p, m, g, t] -= k
            changes[p, m | COPY, g, t] += k
        rows.clear()
    rows[row] += n
    changes[row] += n
    return id


def _combined(rows: DataFrame) -> DataFrame:
    """key, id, part, mask, good, toxic, n: of each task and text the rows of the
    smallest id; all others, settled, under a key of two bytes."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["key", "id", "part", "mask", "good", "toxic", "n"]

    def run(batches):
        held: dict[bytes, list] = {}
        settled: Counter = Counter()

        def out():
            alone = next(iter(held), b"\0\0")[:2]  # as even as the texts' keys
            found = [(k, id, *row, n) for k, (id, own) in held.items() for row, n in own.items()]
            found += [(alone, None, *row, n) for row, n in settled.items() if n]
            held.clear()
            settled.clear()
            for i in range(0, len(found), 10_000):
                columns = list(zip(*found[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        types = None
        for batch in batches:
            types = [pa.binary(), batch.schema.field("id").type, pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
            for key, id, *row in zip(*(batch.column(c).to_pylist() for c in names[:-1])):
                row = tuple(row)
                if id is None:
                    settled[row] += 1
                    continue
                own = held.get(key)
                if own is None:
                    held[key] = [id, Counter({row: 1})]
                    continue
                before = Counter(own[1])
                changes: Counter = Counter()
                own[0] = fold(own[0], own[1], id, row, 1, changes)
                # The state will count what the text holds after this row; what else the row changes is settled.
                changes.update(before)
                changes.subtract(own[1])
                settled.update(changes)
            if len(held) > HELD:
                yield from out()
        if held or settled:
            yield from out()

    return rows.mapInArrow(run, f"key binary, id {kind}, {CHANGE}")


class Copies(StatefulProcessor):
    """The smallest id of each text, and changes of counters whenever it changes."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.state = handle.getValueState("least", f"id {self.kind}, rows array<struct<part:string,mask:int,good:boolean,toxic:boolean,n:bigint>>")

    def handleInputRows(self, key, rows, timerValues):
        changes: Counter = Counter()
        if len(key[0]) == 2:  # settled: no state
            for r in rows:
                changes[r.part, r.mask, r.good, r.toxic] += r.n
        else:
            before = self.state.get()
            least, held = (None, Counter()) if before is None else (before[0], Counter({tuple(r)[:4]: r[4] for r in before[1]}))
            known = least, dict(held)
            for r in rows:
                least = fold(least, held, r.id, (r.part, r.mask, r.good, r.toxic), r.n, changes)
            if (least, held) != known:
                self.state.update((least, [(*row, n) for row, n in held.items()]))
        for (part, mask, good, toxic), n in changes.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def count_stream(
    spark: SparkSession, path: str, labels: DataFrame, root: str, id: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES
) -> DataFrame:
    """part, mask, good, toxic, n: counters of all rows of the Parquet files under ``path``.

    Called again with the same ``root`` it takes only files it has not seen. The
    state, the counters' changes and the stream's progress lie under ``root``.
    """
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch(spark, path, batches)).parquet(any_table(path))
    rows = _combined(_labelled(_marked(docs, id, text, part), labels, id))
    kind = schema[id].dataType.simpleString()
    changes = rows.groupBy("key").transformWithState(Copies(kind), CHANGE, "append", "None")

    def take(df: DataFrame, number: int) -> None:
        write_batch(df.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), f"{root}/counters", number)

    run_available(changes, take, f"{root}/checkpoint")
    return counters(spark, root)


def counters(spark: SparkSession, root: str) -> DataFrame:
    """The counters as all batches so far leave them."""
    held = read_batches(spark, f"{root}/counters", CHANGE)
    return held.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def _bits(filters: Sequence[str]) -> int:
    return sum(1 << FILTERS.index(f) for f in filters)


def orders(counts: DataFrame) -> DataFrame:
    """Every order of the filters and every step of it, for each part of ``counts``.

    A part needs just one number a set of filters, how many rows fail none of
    it; what a step keeps and removes are differences of two.
    """
    sets = range(1 << len(FILTERS))

    def free(n: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, n).otherwise(0)) for s in sets])

    n = F.col("n")
    parts = counts.groupBy("part").agg(
        free(n).alias("all"), free(F.when(F.col("good"), n).otherwise(0)).alias("good"), free(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )
    every = sets[-1]
    steps = ", ".join(
        f"named_struct('filter_order', '{''.join(o)}', 'step', {i + 1}, 'bit', {_bits(o[i])}, 'before', {_bits(o[:i])}, 'after', {_bits(o[: i + 1])})"
        for o in permutations(FILTERS) for i in range(len(FILTERS))
    )

    def at(column: str, place) -> Column:
        return F.get(column, place)

    def share(f: str) -> Column:
        """What the filter removes, over all orders: by the filters that may stand before it."""
        bit, left = _bits(f), len(FILTERS) - 1
        return sum(
            (F.lit(factorial(s.bit_count()) * factorial(left - s.bit_count())) * (at("all", F.lit(s)) - at("all", F.lit(s | bit))) for s in sets if not s & bit),
            F.lit(0),
        ).cast("long")

    parts = parts.withColumn("shares", F.array(*[share(f) for f in FILTERS]))
    wide = parts.select("*", F.explode(F.expr(f"array({steps})")).alias("s")).select("*", "s.*")
    bit, before, after = F.col("bit"), F.col("before"), F.col("after")
    removed = at("all", before) - at("all", after)
    return wide.select(
        "part", "filter_order", "step", at("all", after).alias("kept"), removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", bit) - removed).alias("redundant"),
        (at("all", F.lit(every) - bit) - at("all", F.lit(every))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"), (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        at("shares", F.log2(bit.cast("double")).cast("int")).alias("shapley"),
    )


def audit(
    spark: SparkSession, path: str, labels: DataFrame, root: str | None = None, id: str = "doc_id", text: str = "text", part: str = "lang", batches: int = BATCHES
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty; a null part is the empty one. A row without an id is
    never a copy and makes none; rows that share an id and a text are no copies
    of each other. No rows, no parts. Labels of unknown ids and null labels
    count for nothing; only the named columns are read, so others cannot clash.
    """
    return orders(count_stream(spark, path, labels, root or fresh_path(spark, "audit"), id, text, part, batches))
