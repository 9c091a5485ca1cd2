"""Repeated windows of symbols, found by anchors, for operators on long repeats.

A window of ``length`` symbols has one anchor, chosen by its content alone, so
equal windows meet under equal anchors. A run is all consecutive windows of one
row under one anchor. Packed arrays of runs are dealt by anchor; there:

* an anchor that occurs once holds no repeat;
* runs that are equal as a whole repeat as a whole;
* what is left, unequal runs under one anchor, is settled window by window.

Before every shuffle each task merges equal runs, so a text that makes up a
third of all rows sends one run a task. An anchor with very many unequal runs
(a common phrase in ever new company) is not settled in one place: its windows
are dealt one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import number_rows
from ..session import materialize
from . import arrays, bloom
from .frames import dealt

RUN, FLAG, PROBE, HOT, MARK, SAMPLE = range(6)
#: Added to a kind if the run stands for two or more.
MANY = 8
#: Runs that a task holds before it sends them.
HELD = 1 << 18
#: Unequal runs under one anchor past which its windows are dealt one by one.
UNEQUAL = 1 << 16
#: One anchor in so many is sampled for splitters.
SAMPLED = 1 << 10

NAMES = ["kind", "anchor", "whole", "key", "first", "last", "at"]
TYPES = [np.int8, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int8]
PACKED = (
    "bucket int, kind array<tinyint>, anchor array<bigint>, whole array<bigint>, key array<bigint>,"
    " first array<int>, last array<int>, at array<tinyint>"
)


@dataclass(frozen=True)
class Plan:
    """What a window is: ``read(flat, bounds)`` gives (symbols, row borders)."""

    read: Callable
    length: int
    gram: int
    keep_first: bool
    buckets: int
    unequal: int = UNEQUAL
    lead: Callable | None = None  # (flat, places) -> the leading word there, to sample splitters from


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(key, id, text) with ``key`` a distinct integer in the order of ``id``.

    Ids that are distinct and not null serve as they are. Else rows are
    numbered by id (nulls last), equal ids by text.
    """
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    whole = dict(held.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and held.groupBy("id").count().filter("id IS NULL OR count > 1").isEmpty():
        return held.select(F.col("id").cast("long").alias("key"), "id", "text")
    return materialize(number_rows(held, [F.asc_nulls_last("id"), F.asc("text")], "key"), "keyed")


def _empty() -> list[np.ndarray]:
    return [np.zeros(0, t) for t in TYPES]


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row a bucket, its records as arrays."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    offsets = pa.array(np.r_[heads, len(bucket)].astype(np.int32))
    signed = [c[order].view(np.int64) if c.dtype == np.uint64 else c[order] for c in columns]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in signed]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), *lists], ["bucket", *NAMES])


def unpack(table: pa.Table) -> list[np.ndarray]:
    out = []
    for name, kind in zip(NAMES, TYPES):
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]
        out.append((np.concatenate(parts) if parts else np.zeros(0, kind)).astype(kind, copy=False) if kind != np.uint64
                   else (np.concatenate(parts) if parts else np.zeros(0, np.int64)).view(np.uint64))
    return out


def _deal(values: np.ndarray, buckets: int) -> np.ndarray:
    return (arrays.mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _merged(plan: Plan, cols: list[np.ndarray]) -> list[np.ndarray]:
    """A task's own runs with equal ones merged: the earliest stays a run, marked
    MANY, the others are flagged. Sorted by (anchor, whole, key, first)."""
    kind, anchor, whole, key, first, last, at = cols
    order = np.lexsort((first, key, whole, anchor))
    kind, anchor, whole, key, first, last, at = (c[order] for c in (kind, anchor, whole, key, first, last, at))
    head = np.r_[True, (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1])]
    heads = np.flatnonzero(head)
    sizes = np.diff(np.r_[heads, len(kind)])
    many = np.maximum.reduceat((kind & MANY) > 0, heads) | (sizes > 1)
    kind = np.where(head, np.int8(RUN), np.int8(FLAG))
    kind[heads[many]] |= MANY
    return [kind, anchor, whole, key, first, last, at]


def _send(plan: Plan, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not len(cols[0]):
        return
    kind, anchor, whole, key, first, last, at = _merged(plan, cols)
    live = (kind & 7) == RUN
    index = np.flatnonzero(live)
    groups = np.flatnonzero(np.r_[True, anchor[index][1:] != anchor[index][:-1]])
    counts = np.diff(np.r_[groups, len(index)])
    hot = counts > plan.unequal
    marks = anchor[index][groups[hot]]
    if len(marks):
        hot_runs = index[np.repeat(hot, counts)]
        kind[hot_runs] = HOT | (kind[hot_runs] & MANY)
    by_key = (kind & 7) != RUN
    bucket = np.where(by_key, _deal(key, plan.buckets), _deal(anchor, plan.buckets))
    yield from pack(bucket, [kind, anchor, whole, key, first, last, at])
    if len(marks):
        n = len(marks)
        yield from pack(_deal(marks, plan.buckets), [
            np.full(n, MARK, np.int8), marks, np.zeros(n, np.uint64), np.full(n, -1, np.int64),
            np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int8)])


def find_runs(plan: Plan, docs: DataFrame) -> DataFrame:
    """Packed runs of all rows, dealt by anchor; what a task settles alone rides along."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch):
                symbols, borders = plan.read(flat, bounds)
                keys = part.column("key").to_numpy()
                for a, b, anchor, whole, at in arrays.runs(symbols, borders, plan.length, plan.gram):
                    row = np.searchsorted(borders, a, "right") - 1
                    held.append([np.zeros(len(a), np.int8), anchor, whole, keys[row],
                                 (a - borders[row]).astype(np.int32), (b - borders[row]).astype(np.int32), at.astype(np.int8)])
                    count += len(a)
                    if plan.lead:
                        some = anchor % np.uint64(SAMPLED) == 0
                        lead = plan.lead(flat, (a + at)[some])
                        n = len(lead)
                        yield from pack(_deal(lead, plan.buckets), [
                            np.full(n, SAMPLE, np.int8), np.zeros(n, np.uint64), lead, np.zeros(n, np.int64),
                            np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int8)])
                if count >= HELD:
                    yield from _send(plan, [np.concatenate(c) for c in zip(*held)])
                    held, count = [], 0
        if held:
            yield from _send(plan, [np.concatenate(c) for c in zip(*held)])

    return docs.select("key", "text").mapInArrow(run, PACKED)


def settle(plan: Plan, packed: DataFrame) -> DataFrame:
    """Settle runs under their anchors. Gives packed rows dealt by key: FLAG for
    runs whose windows all repeat (``whole`` names the run), PROBE and HOT for
    those to look into."""

    def run(table: pa.Table) -> pa.Table:
        cols = unpack(table)
        kind = cols[0] & 7
        through = [c[(kind != RUN) & (kind != MARK)] for c in cols]
        if not plan.keep_first:  # a run dealt window by window that a task has seen twice
            both = cols[0] == (HOT | MANY)
            seen = [c[both] for c in cols]
            through = [np.concatenate(x) for x in zip(through, [np.full(len(seen[0]), FLAG, np.int8), *seen[1:]])]
        marked = np.unique(cols[1][kind == MARK])
        live = [c[kind == RUN] for c in cols]
        # an anchor that occurs once and stands for one run is done with
        order = np.argsort(live[1], kind="stable")
        anchor = live[1][order]
        again = np.zeros(len(anchor), bool)
        if len(anchor):
            same = anchor[1:] == anchor[:-1]
            again[1:] |= same
            again[:-1] |= same
            again |= (live[0][order] & MANY) > 0
            again |= np.isin(anchor, marked)
        live = [c[order[again]] for c in live]
        out = [through]
        if len(live[0]):
            kind, anchor, whole, key, first, last, at = _merged(plan, live)
            head = (kind & 7) == RUN
            groups = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
            unequal = np.bincount(groups[head])[groups]
            hot = (unequal > plan.unequal) | np.isin(anchor, marked)
            mixed = head & ((unequal > 1) | hot)
            many = (kind & MANY) > 0
            flagged = ~head if plan.keep_first else (~head | many)
            for chosen, what in ((flagged, FLAG), (mixed & ~hot, PROBE), (mixed & hot, HOT)):
                k = np.where(many[chosen], np.int8(what | MANY), np.int8(what))
                out.append([k, *(c[chosen] for c in (anchor, whole, key, first, last, at))])
        return _table([np.concatenate(c) for c in zip(*out)], plan.buckets)

    return packed.groupBy("bucket").applyInArrow(run, PACKED)


def _table(cols: list[np.ndarray], buckets: int) -> pa.Table:
    lists = [pa.list_(pa.from_numpy_dtype(np.int64 if t == np.uint64 else t)) for t in TYPES]
    schema = pa.schema([("bucket", pa.int32()), *zip(NAMES, lists)])
    batches = pack(_deal(cols[3], buckets), cols)
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)


def send_windows(plan: Plan, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Single windows as runs of one, equal ones of this task merged and dealt by
    ``anchor``. ``at`` is 1 where the window is flagged already."""
    if len(cols[0]):
        cols = _merged(plan, cols)
        flag = (cols[0] & 7) == FLAG
        keep = ~flag | (cols[6] == 0)
        cols, flag = [c[keep] for c in cols], flag[keep]
        yield from pack(np.where(flag, _deal(cols[3], plan.buckets), _deal(cols[1], plan.buckets)), cols)


def settle_windows(plan: Plan, packed: DataFrame) -> DataFrame:
    """Flag the windows that repeat; packed and dealt by key."""

    def run(table: pa.Table) -> pa.Table:
        cols = unpack(table)
        flag = (cols[0] & 7) == FLAG
        out = [[c[flag] for c in cols]]
        live = [c[~flag] for c in cols]
        if len(live[0]):
            live = _merged(plan, live)
            head = (live[0] & 7) == RUN
            again = (~head if plan.keep_first else (~head | ((live[0] & MANY) > 0))) & (live[6] == 0)
            out.append([np.full(again.sum(), FLAG, np.int8), *(c[again] for c in live[1:])])
        return _table([np.concatenate(c) for c in zip(*out)], plan.buckets)

    return packed.groupBy("bucket").applyInArrow(run, PACKED)


SPANS = "key bigint, first array<int>, last array<int>, at array<tinyint>, kind array<tinyint>"


def by_key(packed: DataFrame, kinds: tuple[int, ...], join: bool) -> DataFrame:
    """One row a key with its records of these kinds in order; ``join`` unites
    ranges that touch or overlap."""

    def run(table: pa.Table) -> pa.Table:
        cols = unpack(table)
        chosen = np.isin(cols[0] & 7, kinds)
        kind, _, _, key, first, last, at = (c[chosen] for c in cols)
        order = np.lexsort((last, first, key))
        kind, key, first, last, at = (c[order] for c in (kind, key, first, last, at))
        if join and len(key):
            # the running maximum of ends within a key: keys are made to lie apart
            lane = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64) << 32
            reach = np.maximum.accumulate(lane + last)
            head = np.r_[True, (lane[1:] != lane[:-1]) | (lane[1:] + first[1:] > reach[:-1] + 1)]
            tail = np.r_[head[1:], True]
            last = (reach[tail] - lane[tail]).astype(np.int32)
            kind, key, first, at = kind[head], key[head], first[head], at[head]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[heads, len(key)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (first, last, at, kind)]
        return pa.Table.from_arrays([pa.array(key[heads]), *lists], ["key", "first", "last", "at", "kind"])

    narrowed = packed.filter(F.exists("kind", lambda k: k.bitwiseAND(F.lit(7).cast("tinyint")).isin(list(kinds))))
    return narrowed.groupBy("bucket").applyInArrow(run, SPANS)


def with_spans(docs: DataFrame, spans: DataFrame, others: bool = False) -> DataFrame:
    """Rows of ``docs`` with their spans; texts without any are not shuffled.

    ``spans`` is a written table. A Bloom filter of bounded size over its keys
    drops most other rows before the join; ``others`` gives them back with null spans.
    """
    bits = bloom.bits_for(spans.count())
    hashed = lambda c: F.xxhash64(c)
    words = bloom.marks(spans.select(bloom.slot(hashed("key"), bits).alias("slot")).distinct(), bits)
    named = docs.withColumn("slot_key", hashed("key"))
    near = bloom.keep_marked(named, words, "slot_key", bits).drop("slot_key")
    if not others:
        return near.join(spans, "key")
    far = bloom.keep_marked(named, words, "slot_key", bits, False).drop("slot_key")
    empty = [F.lit(None).cast(t).alias(n) for n, t in spans.dtypes if n != "key"]
    return near.join(spans, "key", "left").unionByName(far.select("*", *empty))


def plan_for(docs: DataFrame, read: Callable, length: int, gram: int, keep_first: bool, unequal: int = UNEQUAL, lead=None) -> Plan:
    return Plan(read, length, gram, keep_first, dealt(docs), unequal, lead)


def covered(first, last, length: int) -> tuple[list[int], list[int]]:
    """Symbol ranges [start, end) that windows ``first..last`` cover, joined."""
    starts, ends = [], []
    for a, b in zip(first, last):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b + length)
        else:
            starts.append(a)
            ends.append(b + length)
    return starts, ends
