"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is ``WINDOW`` consecutive words of an item (a shorter item is
one window). As a set of shingles it is contained in a document only if all its
shingles are, so a prefix of one shingle is enough to join on, and the rarest
one in the documents makes the fewest candidates. A candidate keeps the place
of the shingle in both; the window must fit into the document there (positional
and length bounds), and its words are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.sizes import maybe_broadcast
from ..session import materialize
from . import arrays, bloom
from .frames import keyed

#: Words of a window, and of a shingle (fewer in shorter windows).
WINDOW, SHINGLE = 13, 5
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20
#: Rows of the benchmark side up to which it is broadcast.
SMALL = 200_000


def _words(flat, bounds):
    """Folded bytes, word starts, ends and first word of each row."""
    folded = arrays.FOLD[flat]
    return (folded, *arrays.words(folded, bounds, arrays.ALNUM))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every shingle of ``size`` words within one row."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = arrays.mix(arrays.rolling(arrays.prefix(hashes), size) + np.uint64(size))
    at = np.flatnonzero(arrays.inner_windows(first, size, 0, len(rolled)))
    return rolled[at], at


def windows(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, words (one string, single-spaced), size, shingles: every window of every item.

    Items without words have none; a repeated item repeats its windows.
    """

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                folded, start, end, first = _words(flat, bounds)
                hashes = arrays.word_hashes(folded, start, end)
                ids, texts, sizes, held = [], [], [], []
                for i, key in enumerate(part.column(id).to_pylist()):
                    a, b = first[i], first[i + 1]
                    n = min(window, b - a)
                    for w in range(a, b - n + 1) if n else ():
                        q = min(shingle, n)
                        own, _ = shingles(hashes[w : w + n], np.array([0, n]), q)
                        ids.append(key)
                        texts.append(b" ".join(folded[start[j] : end[j]].tobytes() for j in range(w, w + n)))
                        sizes.append(n)
                        held.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.column(id).type), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(held, pa.list_(pa.int64()))],
                    ["item", "words", "size", "shingles"])

    kind = items.schema[id].dataType.simpleString()
    return items.select(id, text).mapInArrow(run, f"item {kind}, words string, size int, shingles array<bigint>")


def _scan(docs: DataFrame, text: str, words: np.ndarray, bits: int, sizes: list[int], emit, schema: str, columns: list[str]) -> DataFrame:
    """Shingles of each piece of text that the filter lets by, given to ``emit``."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                folded, start, end, first = _words(flat, bounds)
                hashes = arrays.word_hashes(folded, start, end)
                found = []
                for size in sizes:
                    code, at = shingles(hashes, first, size)
                    near = bloom.hits(held.value, code.view(np.int64), bits)
                    found.append((code[near], at[near]))
                yield emit(part, folded, start, end, first, *(np.concatenate(x) for x in zip(*found)))

    return docs.select(*columns).mapInArrow(run, schema)


def _filter(codes: DataFrame) -> tuple[np.ndarray, int]:
    bits = bloom.bits_for(codes.count())
    return bloom.marks(codes.select(bloom.slot(F.col("code"), bits).alias("slot")).distinct(), bits), bits


def judge(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
          window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """id, n_words, n_hit, hits (word ranges), items (sorted ids as strings), contaminated.

    One row a row of ``docs``. Null or empty texts have no words and no hits;
    rows repeated with one id are judged each; null ids too. Without items
    nothing is hit. Other columns of either table are not read.
    """
    held = materialize(windows(items, item, text, window, shingle), "windows")
    # one row a different window; which items hold it is joined on only where it is found
    distinct = materialize(
        held.groupBy("words", "size").agg(F.first("shingles").alias("shingles")).withColumn("window", F.xxhash64("words", "size")),
        "distinct")
    owners = materialize(held.select(F.xxhash64("words", "size").alias("window"), F.col("item").cast("string").alias("item")).distinct(), "owners")
    spread = distinct.select("window", "size", F.posexplode("shingles").alias("place", "code"))
    codes = materialize(spread.select("code").distinct(), "codes")
    sizes = sorted({min(shingle, r[0]) for r in distinct.select("size").distinct().collect()}) or [shingle]  # at most `window` rows

    marks, bits = _filter(codes)

    def count(part, folded, start, end, first, code, at):
        values, n = np.unique(code, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["code", "n"])

    counted = _scan(docs, text, marks, bits, sizes, count, "code bigint, n bigint", [text])
    counts = counted.groupBy("code").agg(F.sum("n").alias("n")).join(maybe_broadcast(codes, SMALL), "code", "left_semi")
    rarity = spread.join(materialize(counts, "rarity"), "code", "left").select(
        "window", "size", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "code").alias("by"))
    prefix = materialize(
        rarity.groupBy("window", "size").agg(F.min("by").alias("by"))
        .filter("by.n > 0")  # a shingle no document holds: the window occurs nowhere
        .select("window", "size", "by.place", "by.code"),
        "prefix")

    near, near_bits = _filter(prefix.select("code").distinct())

    def emit(part, folded, start, end, first, code, at):
        row = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, row))
        row, at, code = row[order], at[order], code[order]
        low = np.maximum(at - window + 1, first[row])
        high = np.minimum(at + window, first[row + 1])
        around = [b" ".join(folded[start[j] : end[j]].tobytes() for j in range(a, b)) for a, b in zip(low.tolist(), high.tolist())]
        heads = np.searchsorted(row, np.arange(len(part) + 1))
        found = pa.StructArray.from_arrays(
            [pa.array(code.view(np.int64)), pa.array((at - first[row]).astype(np.int64)), pa.array((at - low).astype(np.int64)), pa.array(around, pa.binary()).cast(pa.string())],
            ["code", "at", "before", "around"])
        return pa.RecordBatch.from_arrays(
            [part.column(id), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), found)],
            [id, "n_words", "found"])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_words bigint, found array<struct<code:bigint,at:bigint,before:bigint,around:string>>"
    scanned = _scan(docs, text, near, near_bits, sizes, emit, schema, [id, text])
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")

    candidates = scanned.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    fitting = (
        candidates.join(maybe_broadcast(prefix, SMALL), "code")
        .withColumn("start", F.col("at") - F.col("place"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .join(maybe_broadcast(distinct.select("window", "words"), SMALL), "window")
    )
    here = F.array_join(F.slice(F.split("around", " "), (F.col("before") - F.col("place") + 1).cast("int"), F.col("size")), " ")
    hits = materialize(fitting.filter(here == F.col("words")).select("row", "start", "size", "window"), "hits")

    by = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    ranges = (
        hits.select("row", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
        .withColumn("head", F.when(F.col("start") <= reach, 0).otherwise(1))
        .withColumn("range", F.sum("head").over(by))
        .groupBy("row", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    )
    named = (
        hits.select("row", "window").distinct().join(maybe_broadcast(owners, SMALL), "window")
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long"))
    return (
        scanned.select("row", id, "n_words").join(ranges, "row", "left").join(named, "row", "left")
        .select(
            id, "n_words", n_hit.alias("n_hit"), F.coalesce("hits", F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated texts; an id goes if any row of it is contaminated. :func:`keep_clean` goes by rows."""
    gone = materialize(judge(docs, items, id, text).filter("contaminated").select(F.col(id).alias("gone")).distinct(), "contaminated")
    return docs.join(gone, docs[id].eqNullSafe(gone.gone), "left_anti")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is contaminated; row by row, so ids may repeat or be null."""
    held, row = keyed(docs)
    gone = materialize(judge(held, items, row, text).filter("contaminated").select(row), "contaminated")
    return held.join(gone, row, "left_anti").select(*docs.columns)
