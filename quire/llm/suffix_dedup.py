"""Repeated byte strings by sorting suffixes.

Most suffixes need no sorting: :mod:`repeats` settles stretches that repeat as a
whole and drops anchors that occur once. The suffixes left, cut at ``WINDOW``
bytes, are range-partitioned by the eight bytes at their anchor with splitters
sampled over the corpus; splitters never part equal leading bytes, so equal
suffixes share a bucket and none continues across a boundary. A bucket sorts its
suffixes by multikey quicksort, eight bytes a character, setting aside at each
step what is alone. An anchor in very many different surroundings would swell
one bucket; its suffixes are dealt one by one by their own hash instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import arrays, repeats

#: Bytes of a string that counts as repeated, and of the gram that anchors it.
WINDOW, GRAM = 100, 36
#: Bytes of suffixes that a task holds before it sends them.
HELD = 1 << 25
ITEMS = "bucket int, key array<bigint>, first array<int>, n array<int>, data binary"


class Symbols:
    """Hash words of bytes, made slice by slice."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat

    def __len__(self) -> int:
        return len(self.flat)

    def __getitem__(self, at: slice) -> np.ndarray:
        return arrays.BYTE_WORDS[self.flat[at]]


def _read(flat, bounds):
    return Symbols(flat), bounds


def _lead(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian word."""
    out = np.zeros(len(places), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | flat[places + j].astype(np.uint64)
    return out


def repeated_suffixes(flat: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``length`` bytes at ``starts``.

    Returns (index into ``starts``, group) of those with an equal, by group.
    """
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    word = np.zeros(len(flat) + 1, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(word)]
    index, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, length, 8):
        key = word[starts[index] + depth]
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - (length - depth)))
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        index, key, group = index[order], key[order], group[order]
        head = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])] if len(index) else np.zeros(0, bool)
        group = np.cumsum(head)
        tied = np.bincount(group, minlength=1)[group] > 1
        index, group = index[tied], group[tied]
        if not len(index):
            break
    return index, group


def _splitters(packed: DataFrame, buckets: int) -> np.ndarray:
    """Quantiles of the sampled leading words; at most one a bucket reaches the driver."""
    some = packed.select(F.explode(F.arrays_zip("kind", "whole")).alias("r")).filter(F.col("r.kind") == repeats.SAMPLE)
    cuts = some.select(F.shiftrightunsigned("r.whole", 1).alias("lead")).approxQuantile(
        "lead", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return np.unique(np.array(cuts, np.float64)).astype(np.int64)


def _items(plan: repeats.Plan, probes: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Runs to look into as bytes, dealt by leading bytes; of hot anchors, single suffixes."""
    length = plan.length

    def send(key, first, n, place, data):
        order = np.argsort(place, kind="stable")
        place = np.array(place)[order]
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for a, b in zip(heads, [*heads[1:], len(order)]):
            own = order[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[a]], pa.int32()), pa.array([[key[i] for i in own]], pa.list_(pa.int64())),
                 pa.array([[first[i] for i in own]], pa.list_(pa.int32())), pa.array([[n[i] for i in own]], pa.list_(pa.int32())),
                 pa.array([b"".join(data[i] for i in own)], pa.binary())],
                ["bucket", "key", "first", "n", "data"])

    def run(batches):
        held, size = ([], [], [], [], []), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = batch.select(["key", "first", "last", "at", "kind"])
            for i in range(len(batch)):
                text = texts[i].as_py()
                row = {c: rows.column(c)[i].as_py() for c in rows.schema.names}
                for first, last, at, kind in zip(row["first"], row["last"], row["at"], row["kind"]):
                    if kind & 7 == repeats.HOT:
                        items = [(f, 1) for f in range(first, last + 1)]
                    else:
                        items = [(first, last - first + 1)]
                    for f, n in items:
                        data = text[f : f + n - 1 + length]
                        if kind & 7 == repeats.HOT:
                            symbols = arrays.BYTE_WORDS[np.frombuffer(data, np.uint8)]
                            code = int(arrays.mix(arrays.rolling(arrays.prefix(symbols), length))[0])
                            place = plan.buckets + code % plan.buckets
                        else:
                            lead = int.from_bytes(text[first + at : first + at + 8], "big") >> 1
                            place = int(np.searchsorted(splitters, lead, "right"))
                        for column, value in zip(held, (row["key"], f, n, place, data)):
                            column.append(value)
                        size += len(data) + 64
                if size >= HELD:
                    yield from send(*held)
                    held, size = ([], [], [], [], []), 0
        if size:
            yield from send(*held)

    return probes.mapInArrow(run, ITEMS)


def _sort_buckets(plan: repeats.Plan, items: DataFrame) -> DataFrame:
    """Flag every suffix but the first of its equals; packed and dealt by key."""

    def run(table: pa.Table) -> pa.Table:
        key, first, n = (np.concatenate([c.flatten().to_numpy() for c in table.column(x).chunks]) for x in ("key", "first", "n"))
        flat = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        size = n.astype(np.int64) + plan.length - 1
        base = np.cumsum(size) - size
        item = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        index, group = repeated_suffixes(flat, base[item] + step, plan.length)
        place = first[item[index]] + step[index]
        order = np.lexsort((place, key[item[index]], group))
        again = np.zeros(len(item), bool)
        again[index[order[1:]]] = group[order[1:]] == group[order[:-1]]
        # flagged suffixes that follow one another become one range
        at = np.flatnonzero(again)
        head = np.r_[True, (at[1:] != at[:-1] + 1) | (item[at[1:]] != item[at[:-1]])] if len(at) else np.zeros(0, bool)
        tail = np.r_[head[1:], True] if len(at) else head
        a, b = at[head], at[tail]
        count = len(a)
        empty = np.zeros(count, np.uint64)
        return repeats._table(
            [np.full(count, repeats.FLAG, np.int8), empty, empty, key[item[a]].astype(np.int64),
             (first[item[a]] + step[a]).astype(np.int32), (first[item[b]] + step[b]).astype(np.int32), np.zeros(count, np.int8)],
            plan.buckets)

    return items.groupBy("bucket").applyInArrow(run, repeats.PACKED)


def repeated_spans(docs: DataFrame, plan: repeats.Plan) -> DataFrame:
    """key, first[], last[]: the suffixes of each row that occur earlier too, as ranges."""
    packed = materialize(repeats.settle(plan, repeats.find_runs(plan, docs)), "runs")
    probes = materialize(repeats.by_key(packed, (repeats.PROBE, repeats.HOT), False), "probes")
    items = _items(plan, repeats.with_spans(docs, probes), _splitters(packed, plan.buckets))
    both = packed.unionByName(_sort_buckets(plan, items))
    return materialize(repeats.by_key(both, (repeats.FLAG,), True), "spans")


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, unequal: int = repeats.UNEQUAL) -> DataFrame:
    """id, n_bytes, removed (byte ranges), kept (bytes) of every row.

    A byte goes if a string of ``window`` bytes over it starts earlier too: at
    a smaller id, or before in the same text. Null text is empty; shorter texts
    lose nothing. Rows repeated with one id are documents of their own, in
    order of text; null ids come last. ``kept`` is binary, for a cut may part a
    character. An empty table gives no rows; only ``id`` and ``text`` are read.
    """
    keyed = repeats.keyed(docs, id, text)
    plan = repeats.plan_for(keyed, _read, window, gram, True, unequal, _lead)
    spans = repeated_spans(keyed, plan).select("key", "first", "last")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                count, gone, kept = [], [], []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for data, first, last in zip(texts, part.column("first").to_pylist(), part.column("last").to_pylist()):
                    data = data or b""
                    starts, ends = repeats.covered(first or (), last or (), window)
                    count.append(len(data))
                    gone.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                    kept.append(b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(count, pa.int64()),
                     pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "removed", "kept"])

    kind = keyed.schema["id"].dataType.simpleString()
    out = repeats.with_spans(keyed, spans, others=True).select("id", "text", "first", "last")
    return out.mapInArrow(run, f"id {kind}, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary").withColumnRenamed("id", id)
