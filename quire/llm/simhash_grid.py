"""SimHash near-duplicates by a grid over segment popcounts.

A fingerprint's 64 bits are 32 segments of two. Each segment's popcount, 0 to 2,
is one axis; written in unary the whole embedding is again one 64-bit word,
``unary``. The Manhattan distance of two embeddings is the number of bits their
words differ in, and never more than the fingerprints' Hamming distance.

Range join within Manhattan distance r: the axes are cut into ``GROUPS`` groups.
A pair within r differs in at most r groups, so it agrees on some GROUPS - r of
them; every such choice of groups is one layer of grid cells, and each
fingerprint falls in one cell a layer. Pairs meet in a cell, are cut by the
lower bound, and verified on the fingerprints. This loses no pair.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import components
from .frames import keyed

#: Links differ in so many bits at most.
DISTANCE = 3
#: Groups of axes: C(6, 3) = 20 layers, each cell fixes about 16 of 32 axes.
GROUPS = 6
#: A cell with more members is compared in pairs of blocks, each a task's own.
BLOCK = 4096
SEED = 42
_PAIRS = 0x5555555555555555
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, single-spaced."""
    split = text.lower().split()
    n = len(split)
    if n <= words:
        return [xxhash.xxh64_intdigest(b" ".join(split), SEED)] if n else []
    joined = b" ".join(split)
    ends = list(accumulate(map(len, split), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - words])]
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[words - 1 :])), repeat(SEED)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint a row from its run of hashes: bits set in over half of them.

    Eight bit counters of a byte each ride in one word, so up to 255 hashes are
    added at a time.
    """
    out = np.zeros(len(counts), np.uint64)
    have = np.flatnonzero(counts)
    if not len(have):
        return out
    first = np.cumsum(counts)[have] - counts[have]
    blocks = -(-counts[have] // 255)
    head = np.cumsum(blocks) - blocks
    at = np.repeat(first - 255 * head, blocks) + 255 * np.arange(blocks.sum())
    spread = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, at, axis=0).view(np.uint8).reshape(len(at), 64)
    totals = np.add.reduceat(sums, head, axis=0, dtype=np.int64)
    bits = 2 * totals > counts[have][:, None]
    out[have] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fp (bigint, the fingerprint's bits), one row a row of ``docs``; null text has no words."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [shingle_hashes(x or b"") for x in part.column(text).cast(pa.binary()).to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                hashes = np.fromiter((h for x in found for h in x), np.uint64, counts.sum())
                fp = pa.array(majority(hashes, counts).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(id), fp], [id, "fp"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, fp bigint")


def unary(fp: Column) -> Column:
    """Each two-bit segment's popcount in unary: 00, 01 or 11."""
    low = F.lit(_PAIRS)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    low = fp.bitwiseAND(low)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def layers(groups: int = GROUPS, distance: int = DISTANCE) -> list[int]:
    """One mask of axes, as a signed word, a choice of groups."""
    cut = [32 * i // groups for i in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(cut[i], cut[i + 1])) for i in range(groups)]
    masks = (sum(part[i] for i in chosen) for chosen in combinations(range(groups), groups - distance))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unary_np(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(_PAIRS)
    high = (fp >> np.uint64(1)) & low
    return ((high & fp & low) << np.uint64(1)) | high | (fp & low)


def cell_links(cell: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all close pairs in one cell do.

    Rows come sorted by cell. The d-th round compares each row with the d-th
    after it; a pair whose ends are joined already is not kept.
    """
    bits = fp.view(np.uint64)
    lower = _unary_np(bits)
    label = np.arange(len(fp))
    kept: list[tuple[int, int]] = []
    at, d = np.arange(len(fp)), 0
    while True:
        d += 1
        at = at[at + d < len(fp)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            return kept
        near = at[np.bitwise_count(lower[at] ^ lower[at + d]) <= distance]
        near = near[np.bitwise_count(bits[near] ^ bits[near + d]) <= distance]
        near = near[label[near] != label[near + d]]
        if not len(near):
            continue
        root = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        for i in near.tolist():
            a, b = find(int(label[i])), find(int(label[i + d]))
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((int(fp[i]), int(fp[i + d])))
        to = np.arange(len(fp))
        for x in root:
            to[x] = find(x)
        label = to[label]


def links(prints: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect what all pairs within ``distance`` connect.

    ``prints`` has distinct fingerprints in ``fp``.
    """
    word = unary(F.col("fp"))
    cells = prints.select("fp", F.posexplode(F.array(*[word.bitwiseAND(F.lit(m)) for m in layers(groups, distance)])).alias("layer", "part"))
    cells = cells.select(F.xxhash64("layer", "part").alias("cell"), "fp")
    large = materialize(
        cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "large-cells",
    )
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = (
        cells.join(large, "cell", "left")
        .select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
        .select(
            F.when((F.col("own") == 0) & (F.col("other") == 0), F.col("cell"))
            .otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"),
            "fp",
        )
    )

    def run(batches):
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            yield from out(cell[:cut], fp[:cut])
            held_cell, held_fp = cell[cut:], fp[cut:]
        yield from out(held_cell, held_fp)

    def out(cell, fp):
        found = cell_links(cell, fp, distance)
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links) of every row.

    Equal fingerprints are one node, so copies never meet as pairs. Texts
    without words, null or empty, have fingerprint zero and are linked like any
    other; a null id is never a component's id unless the component has no
    other. An empty table gives no rows; other columns are not read.
    """
    held = materialize(fingerprints(docs, id, text), "fingerprints")
    nodes = materialize(held.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    found = materialize(components(links(nodes.select("fp"), distance)), "components")
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return held.join(named, "fp").select(id, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, a null only if
    there is no other, and of rows that share it just one."""
    held, row = keyed(docs)
    # The order of rows as their id: nulls last, then by id, then by the row's own number.
    named = held.select(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(row).alias("row")).alias("by"), F.col(text).alias("text"))
    judged = near_groups(named, "by", "text")
    gone = materialize(judged.filter("by.row <> component_id.row").select(F.col("by.row").alias(row)), "gone")
    return held.join(gone, row, "left_anti").select(*docs.columns)
