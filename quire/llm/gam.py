"""Text quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and a few pairs of features have
a table over coarser bins. Training cycles through the tables: each step fits a
shallow tree to the loss's gradient over one feature's (or pair's) bins and adds
a small part of it to that table. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays, labelled

#: Labelled rows learnt from at most.
SAMPLE = 40_000
#: Bins of a feature's own table, and of each side of a pair's.
BINS, COARSE = 64, 8
CYCLES, PAIR_CYCLES, PAIRS = 150, 60, 8
RATE, PENALTY, LEAVES = 0.1, 5.0, 3
PREDICTED = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "odd_punctuation", "bang", "pipe", "beyond_ascii",
    "newline", "line_length", "distinct_words", "distinct_grams", "distinct_lines", "short_words", "long_words", "sentence_length",
    "top_run", "letters",
]
_SETS = [
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("punctuation", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
    ("odd_punctuation", b"#$%&*+<=>@[\\]^_`{}~"), ("bang", b"!"), ("pipe", b"|"), ("newline", b"\n"),
    ("stop", b".!?"), ("lower", b"abcdefghijklmnopqrstuvwxyz"),
]


def _per_row(hits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hits) + 1, np.int64)
    np.cumsum(hits, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _distinct(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct codes of each row over the row's codes; 1 without any."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((codes, rows))
    c, r = codes[order], rows[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])] if len(c) else np.zeros(0, bool)
    n = np.diff(first)
    return np.where(n > 0, np.bincount(r[new], minlength=len(n)) / np.maximum(n, 1), 1.0)


def features(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text; an empty text has the values of no words."""
    n = np.diff(bounds).astype(np.float64)
    some = np.maximum(n, 1)
    count = {name: _per_row(np.isin(np.arange(256), list(chars))[flat], bounds) for name, chars in _SETS}
    beyond = _per_row(flat >= 128, bounds)
    start, end, first = arrays.words(flat, bounds, arrays.SPACED)
    words = np.diff(first).astype(np.float64)
    some_words = np.maximum(words, 1)
    codes = arrays.word_hashes(flat, start, end)
    size = end - start
    line_start, line_end, line_first = arrays.words(flat, bounds, arrays.byte_table("\n", False))
    lines = arrays.word_hashes(flat, line_start, line_end)
    n_lines = np.maximum(np.diff(line_first), 1)
    grams = arrays.rolling(arrays.prefix(codes), 3)
    inside = arrays.inner_windows(first, 3, 0, len(grams)) if len(grams) else np.zeros(0, bool)
    gram_first = np.r_[0, np.cumsum(np.maximum(np.diff(first) - 2, 0))]
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[first[:-1][first[:-1] < len(codes)]] = False
    out = [
        np.log1p(n), np.log1p(words), _per_row(size, first) / some_words, count["upper"] / some, count["digit"] / some,
        count["punctuation"] / some, count["odd_punctuation"] / some, count["bang"] / some, count["pipe"] / some, beyond / some,
        count["newline"] / some, n / n_lines, _distinct(codes, first), _distinct(grams[inside], gram_first), _distinct(lines, line_first),
        _per_row(size <= 3, first) / some_words, _per_row(size >= 16, first) / some_words, words / (count["stop"] + 1),
        _per_row(same, first) / some_words, (count["upper"] + count["lower"] + beyond) / some,
    ]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)).astype(np.float32)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: the value it adds to each."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts)]
        gain, cut, i = max(found)
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of two levels over a grid: the better axis first, then the other on each side."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gain, cut = _best_cut(a.sum(axis=1), b.sum(axis=1))
        out = np.zeros_like(a)
        for lo, hi in ((0, cut), (cut, len(a))):
            if hi > lo:
                more, _ = _best_cut(a[lo:hi].sum(axis=0), b[lo:hi].sum(axis=0))
                gain += more
                out[lo:hi] = _tree(a[lo:hi].sum(axis=0), b[lo:hi].sum(axis=0), 2)[None]
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on a bounded sample; without both labels the score is their share, or a half."""
    count = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        none = [np.zeros(0, np.float32)] * count
        return Model(none, none, float(np.log(share / (1 - share))), [np.zeros(1)] * count, [], [])
    edges, coarse = [_cuts(x[:, j], BINS) for j in range(count)], [_cuts(x[:, j], COARSE) for j in range(count)]
    binned = [np.searchsorted(edges[j], x[:, j], "right") for j in range(count)]
    rough = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(count)]
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    tables = [np.zeros(len(e) + 1) for e in edges]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j in range(count):
            g, h = slopes()
            step = RATE * _tree(np.bincount(binned[j], g, len(tables[j])), np.bincount(binned[j], h, len(tables[j])), LEAVES)
            tables[j] += step
            total += step[binned[j]]

    def cells(a, b):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        g, h = slopes()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_grid_tree(*cells(a, b)[1:])[0], a, b) for a in range(count) for b in range(a)), reverse=True)[:PAIRS]
    pairs = [(a, b) for _, a, b in ranked]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_CYCLES):
        for k, (a, b) in enumerate(pairs):
            at, g, h = cells(a, b)
            step = RATE * _grid_tree(g, h)[1]
            grids[k] += step
            total += step.ravel()[at]
    return Model(edges, coarse, base, tables, pairs, grids)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold."""

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch):
                x = features(flat, bounds)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["label", "x"])

    got = labelled.sample(docs, labels, label, rows, id, text).mapInArrow(run, "label int, x array<float>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the order rows arrive in is no part of the model
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score of every row: the likelihood of label 1 by the whole text.

    Null text is empty; repeated rows are scored each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(id), pa.array(held.value.score(features(flat, bounds)))], [id, "score"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", at: float = PREDICTED) -> DataFrame:
    """id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id, text, label), id, text)
    return scored.select(id, labelled.held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
