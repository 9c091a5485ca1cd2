"""Stretches of words that repeat with a period, by a dictionary of basic factors.

Level k of the dictionary names every factor of 2^k words, equal names for equal
factors of one document; two neighbouring names of one level make a name of the
next. Where a factor's next occurrence lies within twice its length, the
occurrences form an arithmetic progression whose step proposes a period. A
proposal is extended both ways by names of falling length, and proposals of
one run fall together once extended.

No run is missed. A run of period q and of ``times`` q words or more holds, for
the power of two with q <= 2^k < 2q, a factor of 2^k words and its copy q later;
no copy lies nearer, as the run's root is no power of a shorter word. Runs are
``least`` words or longer, so for small q the length ``least`` allows does as
well, and shorter lengths need not propose.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 24, 3
#: Words taken together; a longer document is taken alone.
TOGETHER = 1 << 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(codes: np.ndarray) -> np.ndarray:
    """Small numbers for values met twice or more, -1 for the rest and for those under 0."""
    out = np.full(len(codes), -1, np.int64)
    at = np.flatnonzero(codes >= 0)
    if len(at):
        _, inverse, n = np.unique(codes[at], return_inverse=True, return_counts=True)
        number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
        out[at] = number[inverse]
    return out


def basic_factors(codes: np.ndarray) -> list[np.ndarray]:
    """Names of all factors of 1, 2, 4 ... symbols by their start, while any factor occurs twice."""
    levels = [_named(codes)]
    while (levels[-1] >= 0).any():
        name, reach = levels[-1], 1 << len(levels) - 1
        pair = np.full(len(codes), -1, np.int64)
        if reach < len(codes):
            a, b = name[:-reach], name[reach:]
            pair[:-reach] = np.where((a >= 0) & (b >= 0), a * (int(name.max()) + 1) + b, -1)
        levels.append(_named(pair))
    return levels[:-1]


def _proposals(name: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, step) of every progression of occurrences that starts at its factor's next within ``2 * reach``."""
    at = np.flatnonzero(name >= 0)
    at = at[np.argsort(name[at], kind="stable")]
    same = name[at[:-1]] == name[at[1:]]
    place, step = at[:-1][same], (at[1:] - at[:-1])[same]
    near = step <= 2 * reach
    place, step = place[near], step[near]
    to = np.zeros(len(name), np.int64)
    to[place] = step
    # The same step one word or one step before belongs to the same run.
    first = (to[place - 1] != step) | (place == 0)
    first &= (to[np.maximum(place - step, 0)] != step) | (place < step)
    return place[first], step[first]


def _extend(levels: list[np.ndarray], place: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest stretch over ``place`` in which words ``step`` apart are equal."""
    n = len(levels[0])
    right, left = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        name, reach = levels[k], 1 << k
        there = np.minimum(right + step, n - 1)
        right += ((right + step < n) & (name[np.minimum(right, n - 1)] >= 0) & (name[np.minimum(right, n - 1)] == name[there])) * reach
        here = np.maximum(left - reach, 0)
        left -= ((left >= reach) & (name[here] >= 0) & (name[here] == name[np.minimum(here + step, n - 1)])) * reach
    return left, right + step - left


def find(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and then period.

    Documents may follow each other in ``codes`` if none shares a code with another.
    """
    if times < 3:
        raise ValueError("a run is three times its period at least")
    levels = basic_factors(codes)
    # The longest power of two with which any q up to least / times finds its copy within `least` words.
    low = max((least - least // times).bit_length() - 1, 0)
    found = [np.zeros((3, 0), np.int64)]
    for k in range(low, len(levels)):
        place, step = _proposals(levels[k], 1 << k)
        start, length = _extend(levels, place, step)
        keep = length >= np.maximum(least, times * step)
        found.append(np.stack([start[keep], length[keep], step[keep]]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # One stretch may have been proposed with multiples of its period as well.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _groups(texts: list[bytes]):
    """Runs of (row, words, codes) with about TOGETHER words, codes apart from row to row."""
    held, total = [], 0
    for row, text in enumerate(texts):
        words = text.split()
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if held and total + len(words) > TOGETHER:
            yield held
            held, total = [], 0
        held.append((row, words, codes))
        total += len(words)
    if held:
        yield held


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (array of start, length, period; by start, then period) and collapsed of every row.

    Words stand between ASCII white space. A run is a longest stretch with a
    smallest period, of ``least`` words and ``times`` its period at least.
    ``collapsed`` is the text without the words that some run holds after its
    first period, single-spaced. A null or empty text has no words; rows with
    repeated or null ids are judged each; an empty table gives no rows. Only
    ``id`` and ``text`` are read.
    """

    def judge(held):
        bounds = np.cumsum([0, *(len(w) for _, w, _ in held)])
        apart = np.cumsum([0, *(int(c.max(initial=-1)) + 1 for _, _, c in held)])
        start, length, period = find(np.concatenate([c + a for (_, _, c), a in zip(held, apart)]), least, times)
        edge = np.zeros(bounds[-1] + 1, np.int32)
        np.add.at(edge, start + period, 1)
        np.subtract.at(edge, start + length, 1)
        stays = np.cumsum(edge)[:-1] == 0
        cut = np.searchsorted(start, bounds)
        for j, (_, words, _) in enumerate(held):
            a, b = cut[j], cut[j + 1]
            own = [{"start": s, "length": n, "period": q} for s, n, q in zip((start[a:b] - bounds[j]).tolist(), length[a:b].tolist(), period[a:b].tolist())]
            left = compress(words, stays[bounds[j] : bounds[j + 1]].tolist()) if own else words
            yield len(words), own, b" ".join(left)

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            for held in _groups(texts):
                rows = list(judge(held))
                part = batch.slice(held[0][0], len(held))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(RUN)),
                     pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                    [id, "n_words", "runs", "collapsed"])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(id, text).mapInArrow(run, schema)
