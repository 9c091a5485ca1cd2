"""Packing token documents into sequences by cutting stock.

A document's ids are cut at every full sequence, and what is left over once more
after half a sequence if it is longer, so that no item of the cutting-stock
problem is too long to share a sequence. Only the histogram of item
lengths, of bounded size, reaches the driver. Column generation solves the
linear program over patterns (ways to fill a sequence): a simplex on the basis
of patterns, priced by a knapsack over the duals. Patterns are rounded down, the
few items left are packed best-fit, and every document, ranked among those of
its length, finds its place from the pattern table by arithmetic.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import ranked
from ..session import materialize
from . import arrays

#: Tokens of a sequence.
SEQUENCE = 1024
#: Lengths are rounded up to multiples of this for the program, so it has at most
#: SEQUENCE / 2 / GRAIN + 1 classes.
GRAIN = 4
#: Id after each document.
END = 0
#: Simplex steps at most; stopping early gives a valid packing, less tight.
STEPS = 6000
#: Share above the program's least value at which it stops.
GAP = 3e-3
#: Bytes of characters that every Unicode version classes alike: printable
#: ASCII, tab and line ends, and letters U+00C0 to U+027F. Other texts go to
#: the tokenizer whole.
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True


def _bytes_of(token: str) -> bytes:
    """A byte-level vocabulary's token as bytes: printable bytes stand for
    themselves there, the others for the characters from U+0100 on."""
    return bytes(_BYTES[c] for c in token)


_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _OWN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _OWN)}


class Encoder:
    """Ids of texts by a byte-level vocabulary.

    The tokenizer's file is read twice: as it is, and as ranks for a quicker
    encoder of the same vocabulary, used where both split words alike.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {_bytes_of(token): i for token, i in vocabulary.items() if all(c in _BYTES for c in token) and not token.startswith("<|")}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str, plain: bool) -> bytes:
        """Little-endian 32-bit words."""
        if plain and "<|" not in text:  # may hold a special token's string
            return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bounds_of(n: int, sequence: int) -> list[int]:
    """Where a document of ``n`` ids is cut, ends included."""
    cuts = [*range(0, n, sequence), n]
    half = sequence // 2
    if half < cuts[-1] - cuts[-2] < sequence:
        cuts.insert(-1, cuts[-2] + half)
    return cuts


def cut(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens: the pieces of every row, in order."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                odd = np.zeros(len(flat) + 1, np.int64)
                np.cumsum(~_PLAIN[flat], out=odd[1:])
                plain = (odd[bounds[1:]] == odd[bounds[:-1]]).tolist()
                data = flat.tobytes()
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for i in range(len(part)):
                    ids = encode(data[bounds[i] : bounds[i + 1]].decode(), plain[i]) + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    cuts = bounds_of(n, sequence)
                    for a, b in zip(cuts, cuts[1:]):
                        rows.append(i)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(ids[4 * a : 4 * b]))
                        totals.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                    [id, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _price(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """The most valuable pattern, by dynamic programming over the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    good = worth > 1e-12
    index, sizes_, worth_ = np.flatnonzero(good), sizes[good], worth[good]
    upto = np.searchsorted(sizes_, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        n = upto[w]
        if n:
            value = best[w - sizes_[:n]] + worth_[:n]
            k = int(value.argmax())
            if value[k] > best[w] + 1e-12:
                best[w], pick[w] = value[k], k
    pattern, w = np.zeros(len(sizes)), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[index[pick[w]]] += 1
            w -= sizes_[pick[w]]
    return pattern


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): rows of items a class, and how often each is used.

    ``sizes`` ascend, none above ``room``; demand is positive. Every demand is
    met exactly.
    """
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    fill = np.floor(room / sizes)
    columns = np.diag(fill)  # one pattern a column
    inverse, x = np.diag(1 / fill), demand / fill
    for _ in range(steps):
        duals = inverse.sum(axis=0)
        entering = _price(sizes, duals, room)
        if duals @ entering <= 1 + GAP:  # then the program's value is within that share of the least
            break
        direction = inverse @ entering
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        columns[:, leave] = entering
    whole = np.floor(x + 1e-6).astype(np.int64)
    made = columns.T.astype(np.int64)
    while (over := made.T @ whole - demand).max() > 0:  # rounding of floats alone
        c = int(over.argmax())
        whole[int(np.flatnonzero((made[:, c] > 0) & (whole > 0))[0])] -= 1
    left = demand - made.T @ whole
    rest: list[tuple[int, np.ndarray]] = []
    for c in range(m - 1, -1, -1):
        for _ in range(int(left[c])):
            fits = [k for k, (space, _) in enumerate(rest) if space >= sizes[c]]
            if fits:
                k = min(fits, key=lambda k: rest[k][0])
            else:
                k = len(rest)
                rest.append((room, np.zeros(m, np.int64)))
            rest[k][1][c] += 1
            rest[k] = (rest[k][0] - sizes[c], rest[k][1])
    used = whole > 0
    return np.vstack([made[used], *(p[None] for _, p in rest)]), np.concatenate([whole[used], np.ones(len(rest), np.int64)])


def places(sizes: np.ndarray, made: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """For each class and pattern: ranks ``low`` up to ``high`` go to sequences
    from ``base`` on, ``each`` of them to one, in slots from ``slot`` on."""
    base = np.cumsum(counts) - counts
    slot = np.cumsum(made[:, ::-1], axis=1)[:, ::-1] - made
    out = {k: [] for k in ("size", "low", "high", "base", "each", "slot")}
    for c in range(len(sizes)):
        own = np.flatnonzero(made[:, c])
        high = np.cumsum(made[own, c] * counts[own])
        for k, v in zip(out, (np.full(len(own), sizes[c]), high - made[own, c] * counts[own], high, base[own], made[own, c], slot[own, c])):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Pieces of every row with sequence_id and offset.

    Null text is empty and has its end id alone; rows repeated with one id, and
    null ids, are documents of their own; a text of any length is cut into
    full sequences and at most two items. An empty table gives no rows. Only ``id`` and
    ``text`` are read.
    """
    held = materialize(
        cut(docs, path, id, text, sequence).withColumns(
            {"size": F.ceil(F.col("length") / grain).cast("int"), "row": F.monotonically_increasing_id()}),
        "pieces")
    counted = sorted((r["size"], r["count"]) for r in held.groupBy("size").count().collect())  # sequence / grain rows at most
    sizes, demand = (np.array(x, np.int64) for x in zip(*counted)) if counted else (np.zeros(0, np.int64),) * 2
    table = places(sizes, *patterns(sizes, demand, sequence // grain))
    table["key"] = table["size"] * (1 << 40) + table["low"]  # sorted: sizes ascend, and low within
    spread = held.sparkSession.sparkContext.broadcast(table)  # patterns are bounded by the classes, not the data

    def run(batches):
        t = spread.value
        for batch in batches:
            rank = batch.column("rank").to_numpy() - 1
            at = np.searchsorted(t["key"], batch.column("size").to_numpy().astype(np.int64) * (1 << 40) + rank, "right") - 1
            step = rank - t["low"][at]
            names = [c for c in batch.schema.names if c not in ("rank", "size", "row")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(t["base"][at] + step // t["each"][at]), pa.array(t["slot"][at] + step % t["each"][at])],
                [*names, "sequence_id", "slot"])

    order = [F.asc_nulls_last(id), F.col("start"), F.col("row")]
    numbered = ranked(held, ["size"], order, hot=True)
    kind = docs.schema[id].dataType.simpleString()
    placed = numbered.mapInArrow(run, f"`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("slot")
