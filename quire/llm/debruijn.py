"""Long repeated passages as the repeated paths of a De Bruijn graph.

An edge is ``WINDOW`` consecutive words (its nodes are the windows one word
shorter). Edges that the corpus holds twice are found as in :mod:`repeats`: by
runs under a shared anchor, which are stretches of the graph that need no joining,
and by single edges where runs differ. Then stretches compact: a join tells which
pieces have one way out and one way in at every place they occur, and pieces
chained that way become one path. Its coordinates in each source give the span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import arrays, repeats

#: Words of an edge, and of the gram that anchors it.
WINDOW, GRAM = 35, 15


def _read(flat, bounds):
    start, end, first = arrays.words(flat, bounds, arrays.SPACED)
    return arrays.word_hashes(flat, start, end), first


def _edges(plan: repeats.Plan, probes: DataFrame) -> DataFrame:
    """Every edge of the runs to look into, dealt by anchor, of hot anchors by edge."""

    def run(batches):
        for batch in batches:
            held = []
            for part, flat, bounds in arrays.pieces(batch):
                symbols, borders = plan.read(flat, bounds)
                p = arrays.prefix(symbols)
                for i, row in enumerate(part.select(["key", "first", "last", "at", "kind"]).to_pylist()):
                    first, last = np.array(row["first"]), np.array(row["last"])
                    n = last - first + 1
                    run_of = np.repeat(np.arange(len(n)), n)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run_of]
                    a = borders[i] + place
                    edge = arrays.mix(arrays.span(p, a, a + plan.length))
                    g = borders[i] + first + np.array(row["at"])
                    anchor = arrays.mix(arrays.span(p, g, g + plan.gram))[run_of]
                    kind = np.array(row["kind"], np.int8)[run_of]
                    anchor = np.where((kind & 7) == repeats.HOT, edge, anchor)
                    many = (kind & repeats.MANY) > 0
                    held.append([np.where(many, np.int8(repeats.MANY), np.int8(0)), anchor, edge,
                                 np.full(len(a), row["key"], np.int64), place.astype(np.int32), place.astype(np.int32), many.astype(np.int8)])
            if held:
                yield from repeats.send_windows(plan, [np.concatenate(c) for c in zip(*held)])

    return probes.mapInArrow(run, repeats.PACKED)


def pieces(docs: DataFrame, plan: repeats.Plan) -> DataFrame:
    """key, first, last, name: stretches of repeated edges, equal ones with one name."""
    packed = materialize(repeats.settle(plan, repeats.find_runs(plan, docs)), "runs")
    spans = materialize(repeats.by_key(packed, (repeats.PROBE, repeats.HOT), False), "probes")
    edges = materialize(repeats.settle_windows(plan, _edges(plan, repeats.with_spans(docs, spans))), "edges")
    rows = packed.unionByName(edges).select(F.explode(F.arrays_zip("kind", "key", "first", "last", "whole")).alias("r"))
    return rows.filter(F.col("r.kind").bitwiseAND(F.lit(7).cast("tinyint")) == repeats.FLAG).select(
        "r.key", "r.first", "r.last", F.col("r.whole").alias("name")
    )


def compact(pieces: DataFrame) -> DataFrame:
    """key, first, last: pieces chained wherever the path between them does not branch.

    ``pieces`` are disjoint; a piece with no neighbour stays as it is.
    """
    by = Window.partitionBy("key").orderBy("first")
    near = lambda c, n, touch: F.when(touch, (F.lead if n > 0 else F.lag)(c).over(by))
    after = F.lead("first").over(by) == F.col("last") + 1
    before = F.lag("last").over(by) == F.col("first") - 1
    beside = materialize(pieces.withColumns({"after": near("name", 1, after), "before": near("name", -1, before)}), "beside")

    def one(c):
        return (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))

    ways = materialize(beside.groupBy("name").agg(one("after").alias("out"), one("before").alias("in")), "ways")
    known = beside.join(ways, "name").select("key", "first", "last", F.coalesce("out", F.lit(False)).alias("out"), F.coalesce("in", F.lit(False)).alias("in"))
    chained = F.coalesce(F.col("in") & F.lag("out").over(by) & before, F.lit(False))
    paths = known.withColumn("head", (~chained).cast("int")).withColumn("path", F.sum("head").over(by))
    return paths.groupBy("key", "path").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("path")


OUT = "removed array<struct<start:int,end:int>>, kept string"


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, unequal: int = repeats.UNEQUAL) -> DataFrame:
    """id, n_words, removed (word ranges), kept (other words, single-spaced) of every row.

    A word goes if a window of ``window`` words over it occurs anywhere else
    too. Null text has no words; shorter texts lose none. Rows repeated with one
    id are documents of their own, so they repeat each other; a null id is as
    good as any. An empty table gives no rows; only ``id`` and ``text`` are read.
    """
    keyed = repeats.keyed(docs, id, text)
    plan = repeats.plan_for(keyed, _read, window, gram, False, unequal)
    paths = compact(pieces(keyed, plan))
    spans = paths.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))
    spans = materialize(spans.select("key", F.col("s.first").alias("first"), F.col("s.last").alias("last")), "spans")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                count, gone, kept = [], [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for data, first, last in zip(texts, part.column("first").to_pylist(), part.column("last").to_pylist()):
                    split = (data or b"").split()
                    starts, ends = repeats.covered(first or (), last or (), window)
                    stay = []
                    for a, b in zip([0, *ends], [*starts, len(split)]):
                        stay += split[a:b]
                    count.append(len(split))
                    gone.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                    kept.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(count, pa.int64()),
                     pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "removed", "kept"])

    kind = keyed.schema["id"].dataType.simpleString()
    out = repeats.with_spans(keyed, spans, others=True).select("id", "text", "first", "last")
    return out.mapInArrow(run, f"id {kind}, n_words bigint, {OUT}").withColumnRenamed("id", id)
