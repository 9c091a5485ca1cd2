"""Toxic spans by a linear-chain conditional random field.

Labels come by document, so tokens of the sample are labelled first: in a toxic
document, those whose word, or whose first letters, toxic documents hold far
more often than others do. A chain is a sentence of at most ``CHAIN`` tokens;
each token is clean or toxic. The field weighs the word, its first letters and
its neighbours' words, and each step from state to state. Forward and backward
ratios give every token's marginal; tokens above a floor make up the document's
score, and runs of likely tokens are its spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import arrays, labelled

#: Labelled documents learnt from at most, and chains of them.
SAMPLE, CHAINS = 40_000, 20_000
#: Tokens of a chain at most, bytes of a word that are its first letters.
CHAIN, LETTERS = 32, 8
#: A word is telling if toxic documents hold it in so many places, and so many times
#: more often than others do.
LEAST, RATIO = 6, 12.0
#: Telling words and first letters kept at most, the most frequent.
LEXICON = 20_000
STEPS, RATE, PENALTY = 100, 0.4, 0.02
#: Marginals below the floor do not add up to a score; above the other they are spans.
FLOOR, SPAN = 0.2, 0.5
#: Evidence of a document in which no token passes the floor.
LITTLE = 1e-3
PREDICTED = 0.5
_STOPS = np.isin(np.arange(256), list(b".!?\n"))


def tokens(flat: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Words of all rows with their codes, and where chains begin."""
    folded = arrays.FOLD[flat]
    start, end, first = arrays.words(folded, bounds, arrays.ALNUM)
    word = arrays.word_hashes(folded, start, end)
    letters = arrays.word_hashes(folded, start, np.minimum(end, start + LETTERS)) ^ np.uint64(1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stops = np.r_[0, np.cumsum(_STOPS[flat])]
    begins = np.ones(len(start), bool)
    if len(start) > 1:
        begins[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] != stops[end[:-1]])
    heads = np.flatnonzero(begins)
    size = np.diff(np.r_[heads, len(start)])
    place = np.arange(len(start)) - np.repeat(heads, size)
    return {"start": start, "end": end, "first": first, "row": row, "word": word, "letters": letters, "begins": begins | (place % CHAIN == 0)}


def lookup(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code among the sorted ``known``, or their number if it is none."""
    if not len(known):
        return np.zeros(len(codes), np.int64)
    at = np.searchsorted(known, codes)
    at[at == len(known)] = 0
    return np.where(known[at] == codes, at, len(known))


@dataclass
class Model:
    known: np.ndarray  # sorted codes of words and first letters
    word: np.ndarray  # weights of known codes and, last, of any other: own word
    before: np.ndarray  # of the word before
    after: np.ndarray  # of the word after
    step: np.ndarray  # [from, to] log weights
    bias: float
    # the document's score is logistic in the logs of its evidence and its words
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)


def _signals(model: Model, t: dict[str, np.ndarray]) -> np.ndarray:
    """Each token's log odds of being toxic by its own features."""
    w = lookup(model.known, t["word"])
    p = lookup(model.known, t["letters"])
    none = len(model.known)
    before, after = np.full(len(w), none), np.full(len(w), none)
    before[1:] = np.where(t["begins"][1:], none, w[:-1])
    after[:-1] = np.where(t["begins"][1:], none, w[1:])
    return model.bias + model.word[w] + model.word[p] + model.before[before] + model.after[after]


def marginals(signal: np.ndarray, begins: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Each token's probability of the toxic state, all chains at once.

    Two states need one number each way: the ratio of the toxic to the clean
    message. Chains are walked side by side, longest first.
    """
    n = len(signal)
    if not n:
        return np.zeros(0)
    odds = np.exp(np.clip(signal, -30, 30))
    t = np.exp(step)
    heads = np.flatnonzero(begins)
    size = np.diff(np.r_[heads, n])
    order = np.argsort(-size, kind="stable")
    heads, size = heads[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    forward, backward = np.empty(n), np.ones(n)
    forward[heads] = odds[heads]
    for k in range(1, size[0]):
        at = heads[: active[k]] + k
        r = forward[at - 1]
        forward[at] = odds[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for k in range(size[0] - 1, 0, -1):
        at = heads[: active[k]] + k
        r = odds[at] * backward[at]
        backward[at - 1] = (t[1, 0] + r * t[1, 1]) / (t[0, 0] + r * t[0, 1])
    both = forward * backward
    return both / (1 + both)


def fit(known: np.ndarray, t: dict[str, np.ndarray], label: np.ndarray) -> Model:
    """Maximise the chains' likelihood by gradient steps of adapted size."""
    none = len(known)
    w, p = lookup(known, t["word"]), lookup(known, t["letters"])
    inner = np.flatnonzero(~t["begins"])
    before, after = np.full(len(w), none), np.full(len(w), none)
    before[inner], after[inner - 1] = w[inner - 1], w[inner]
    model = Model(known, np.zeros(none + 1), np.zeros(none + 1), np.zeros(none + 1), np.zeros((2, 2)), -3.0)
    y = label.astype(np.float64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    speed = [np.zeros(none + 1), np.zeros(none + 1), np.zeros(none + 1), np.zeros((2, 2)), np.zeros(1)]
    for _ in range(STEPS):
        q = marginals(_signals(model, t), t["begins"], model.step)
        wrong = y - q
        # pairs of neighbours: their joint probability follows from the marginals
        # and the odds ratio of the step, solved per pair
        pair = _pairs(q[inner - 1], q[inner], model.step)
        expected = np.array([[(1 - q[inner - 1] - q[inner] + pair).sum(), (q[inner] - pair).sum()], [(q[inner - 1] - pair).sum(), pair.sum()]])
        slopes = [
            np.bincount(w, wrong, none + 1) + np.bincount(p, wrong, none + 1) - PENALTY * model.word,
            np.bincount(before, wrong, none + 1) - PENALTY * model.before,
            np.bincount(after, wrong, none + 1) - PENALTY * model.after,
            seen - expected,
            np.array([wrong.sum()]),
        ]
        for weights in slopes[:3]:
            weights[none] = 0  # what is not known says nothing
        moves = []
        for total, slope in zip(speed, slopes):
            total += slope**2
            moves.append(RATE * slope / (np.sqrt(total) + 1e-9))
        model.word += moves[0]
        model.before += moves[1]
        model.after += moves[2]
        model.step += moves[3]
        model.bias += float(moves[4][0])
    return model


def _pairs(a: np.ndarray, b: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(both toxic) of neighbours with marginals ``a`` and ``b``.

    In a chain the joint of two neighbours has the step's odds ratio
    theta = t11 t00 / (t01 t10); with both margins that fixes it.
    """
    theta = np.exp(step[1, 1] + step[0, 0] - step[0, 1] - step[1, 0])
    if abs(theta - 1) < 1e-6:
        return a * b
    s = 1 + (a + b) * (theta - 1)
    return (s - np.sqrt(np.maximum(s * s - 4 * theta * (theta - 1) * a * b, 0))) / (2 * (theta - 1))


def _telling(held: DataFrame) -> np.ndarray:
    """Sorted codes that toxic documents hold far more often; at most LEXICON reach the driver.

    A word must have different neighbours in toxic documents, else it may be
    one document's own and that one copied.
    """

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch):
                t = tokens(flat, bounds)
                word, label = t["word"], part.column("label").to_numpy()[t["row"]]
                near = np.zeros(len(word), np.uint64)
                near[1:] = np.where(t["begins"][1:], np.uint64(0), word[:-1])
                near[:-1] += np.where(t["begins"][1:], np.uint64(0), arrays.mix(word[1:]))
                row = t["row"]
                code, label, near, row = np.r_[word, t["letters"]], np.r_[label, label], np.r_[near, near] | np.uint64(1), np.r_[row, row]
                order = np.lexsort((row, code))
                c, r = code[order], row[order]
                once = order[np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]] if len(c) else order
                values, at = np.unique(code[once], return_inverse=True)
                toxic = np.bincount(at, label[once] == 1, len(values)).astype(np.int64)
                n = np.bincount(at, minlength=len(values)).astype(np.int64)
                there = label == 1
                none = np.zeros(there.sum(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[code[there], values].view(np.int64)), pa.array(np.r_[near[there], np.zeros(len(values), np.uint64)].view(np.int64)),
                     pa.array(np.r_[none, toxic]), pa.array(np.r_[none, n - toxic])],
                    ["code", "near", "toxic", "clean"])

    totals = held.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    clean = totals.n - totals.toxic
    if not totals.toxic or not clean:
        return np.zeros(0, np.uint64)
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    places = held.mapInArrow(run, "code bigint, near bigint, toxic bigint, clean bigint").groupBy("code", "near").agg(*sums)
    counts = places.groupBy("code").agg(F.count_if(F.col("near") != 0).alias("places"), *sums)
    odds = (F.col("toxic") / totals.toxic) / ((F.col("clean") + 1) / clean)
    got = counts.filter((F.col("places") >= LEAST) & (F.col("toxic") >= LEAST) & (odds >= RATIO)).orderBy(F.desc("toxic"), "code").limit(LEXICON).select("code").toArrow()
    return np.sort(got.column("code").to_numpy().view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE, chains: int = CHAINS) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold and
    at most ``chains`` chains of them, half of these with toxic tokens, by hash."""
    held = labelled.sample(docs, labels, label, rows, id, text)
    known = _telling(held)
    spread = held.sparkSession.sparkContext.broadcast(known)  # at most LEXICON words

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch):
                t = tokens(flat, bounds)
                toxic = part.column("label").to_numpy()[t["row"]] == 1
                telling = (lookup(spread.value, t["word"]) < len(spread.value)) | (lookup(spread.value, t["letters"]) < len(spread.value))
                y = (toxic & telling).astype(np.int8)
                heads = np.flatnonzero(t["begins"])
                if not len(heads):
                    continue
                # a chain's hash, for a fair choice; toxic documents none of whose words tell teach nothing
                code = arrays.mix(np.add.reduceat(t["word"], heads)).view(np.int64)
                any_toxic = np.maximum.reduceat(y, heads)
                some = np.bincount(t["row"], y, len(part)) > 0
                fit_for = ~toxic[heads] | some[t["row"][heads]]
                offsets = pa.array(np.r_[heads, len(y)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (t["word"].view(np.int64), t["letters"].view(np.int64), y)]
                yield pa.RecordBatch.from_arrays([pa.array(any_toxic), pa.array(code), *lists], ["toxic", "code", "word", "letters", "y"]).filter(pa.array(fit_for))

    schema = "toxic tinyint, code bigint, word array<bigint>, letters array<bigint>, y array<tinyint>"
    rows = materialize(held.mapInArrow(run, schema), "chains")
    toxic = labelled.least_hashes(rows.filter("toxic = 1"), F.col("code"), chains // 2, "word")
    clean = labelled.least_hashes(rows.filter("toxic = 0"), F.col("code"), chains - chains // 2, "word")
    got = toxic.unionAll(clean).toArrow()
    sizes = np.array([len(x) for x in got.column("y").to_pylist()], np.int64)
    if not len(sizes) or not len(known):
        none = np.zeros(1)
        return Model(np.zeros(0, np.uint64), none, none, none, np.zeros((2, 2)), -10.0)
    flat = {c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in got.column(c).chunks]) for c in ("word", "letters", "y")}
    begins = np.zeros(sizes.sum(), bool)
    begins[np.cumsum(sizes) - sizes] = True
    t = {"word": flat["word"].view(np.uint64), "letters": flat["letters"].view(np.uint64), "begins": begins}
    model = fit(known, t, flat["y"].astype(np.int64))
    weighed = held.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch):
                evidence, t, _ = _evidence(weighed.value, flat, bounds)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(evidence), pa.array(np.diff(t["first"]))], ["label", "x", "n"])

    got = held.mapInArrow(weigh, "label int, x double, n bigint").toArrow()  # three numbers a document of the sample
    _calibrate(model, *(got.column(c).to_numpy().astype(np.float64) for c in ("x", "n", "label")))
    return model


def _logs(evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log(evidence + LITTLE), np.log1p(words), np.ones(len(words))], axis=1)


def _calibrate(model: Model, evidence: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
    """Newton steps for a logistic of three numbers; a little ridge keeps them finite."""
    order = np.lexsort((y, words, evidence))
    x, y = _logs(evidence[order], words[order]), y[order]
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        move = np.linalg.solve(bend, slope)
        w = w + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    model.weights = (float(max(w[0], 0.0)), float(w[1]), float(w[2]))


def _evidence(model: Model, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """Each row's sum of -log(1 - marginal) over tokens above the floor; tokens and marginals."""
    t = tokens(flat, bounds)
    q = marginals(_signals(model, t), t["begins"], model.step)
    sure = np.where(q >= FLOOR, -np.log1p(-np.minimum(q, 1 - 1e-12)), 0.0)
    rows = len(bounds) - 1
    return (np.bincount(t["row"], sure, rows) if len(q) else np.zeros(rows)), t, q


def _tagged(model: Model, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and spans, in characters, of each row."""
    evidence, t, q = _evidence(model, flat, bounds)
    score = 1 / (1 + np.exp(-np.clip(_logs(evidence, np.diff(t["first"])) @ np.array(model.weights), -30, 30)))
    rows = len(bounds) - 1
    spans: list[list[dict]] = [[] for _ in range(rows)]
    hit = np.flatnonzero(q >= SPAN)
    if len(hit):
        head = np.r_[True, (hit[1:] != hit[:-1] + 1) | t["begins"][hit[1:]]]
        tail = np.r_[head[1:], True]
        letters = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]  # characters before each byte
        for a, b in zip(hit[head].tolist(), hit[tail].tolist()):
            row = int(t["row"][a])
            base = letters[bounds[row]]
            spans[row].append({"start": int(letters[t["start"][a]] - base), "end": int(letters[t["end"][b]] - base)})
    return score, spans


SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def tag(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, spans (character ranges) of every row's whole text.

    Null or empty texts score as any without a toxic token; repeated rows are scored each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON weights

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                score, spans = _tagged(held.value, flat, bounds)
                yield pa.RecordBatch.from_arrays([part.column(id), pa.array(score), pa.array(spans, _SPANS)], [id, "score", "spans"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, score double, spans {SPANS}")


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", at: float = PREDICTED) -> DataFrame:
    """id, held_out, score, predicted, spans."""
    tagged = tag(docs, train(docs, labels, id, text, label), id, text)
    return tagged.select(id, labelled.held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", at: float = PREDICTED) -> DataFrame:
    """``docs`` without the rows that score ``at`` or more; row by row, so ids may repeat or be null."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON weights

    def run(batches):
        for batch in batches:
            for part, flat, bounds in arrays.pieces(batch, text):
                yield part.filter(pa.array(_tagged(held.value, flat, bounds)[0] < at))

    return docs.mapInArrow(run, docs.schema)
