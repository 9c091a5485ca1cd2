"""Periodic runs, against every period tried at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import periods, registry

from . import brute

ROOT = "/root/testdata/sf0.001"


def all_runs(words, least=24, times=3):
    """(start, length, period) by comparing all words of every distance."""
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    held = {}
    for q in range(1, len(codes) // times + 1):
        equal = np.flatnonzero(np.diff(np.concatenate([[0], (codes[q:] == codes[:-q]).astype(int), [0]])))
        for a, b in zip(equal[::2].tolist(), equal[1::2].tolist()):
            length = b - a + q
            if length >= max(least, times * q):
                held.setdefault((a, length), q)  # the smallest period of the stretch comes first
    return sorted(((a, n, q) for (a, n), q in held.items()), key=lambda r: (r[0], r[2]))


def planted(doc, text):
    words = re.findall(brute.SPACED, text or "")
    if doc is None:
        return words
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(words):
    found = all_runs(words)
    best = (None,) * 4
    for s, n, q in found:
        if best[0] is None or n * best[2] > best[1] * q:
            best = s, n, q, 1000 * n // q
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (len(found), *best, *sha)


def test_query(spark):
    got = registry.op13_periods(spark, ROOT)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = registry.table(spark, ROOT, "documents").collect()
    rows = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert rows == {r.doc_id: row(planted(r.doc_id, r.text)) for r in docs} and sum(r[0] > 0 for r in rows.values()) > 10


def test_hard_rows(spark, hard, empty):
    more = spark.createDataFrame(
        [(50, "a " * 24), (51, "a " * 23), (52, "a b c d e f g h i " * 3), (53, "a b c d e f g h i " * 2 + "a b c d e f g h"), (54, ("x y " * 20 + "z ") * 5), (55, "a a b " * 40)], "doc_id bigint, text string"
    )
    both = hard.select("doc_id", "text").unionAll(more)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.runs(both).collect())

    def want(doc, text):
        words = re.findall(brute.SPACED, text or "")
        found = all_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        return str(doc), len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)

    assert got == sorted(want(r.doc_id, r.text) for r in both.collect())
    assert periods.runs(empty).count() == 0
    planted_rows = registry.planted(both).collect()
    assert sorted(" ".join((r.text or "").split()) for r in planted_rows) == sorted(" ".join(planted(r.doc_id, r.text)) for r in both.collect())


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_find(data):
    parts = data.draw(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 8)), max_size=6))
    word = "".join(p * n for p, n in parts)
    start, length, period = periods.find(np.array([ord(c) for c in word], np.int64))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == all_runs(word)
    least, times = data.draw(st.sampled_from([(1, 3), (5, 3), (9, 4), (2, 5)]))
    start, length, period = periods.find(np.array([ord(c) for c in word], np.int64), least, times)
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == all_runs(word, least, times)


def test_documents_taken_together_stay_apart(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(60)))) for i in range(300)] + [(300, "a b " * 40000), (301, "b a " * 20)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got.pop(300) == [(0, 80000, 2)]
    assert got == {i: all_runs(t.split()) for i, t in rows if i != 300}
    with pytest.raises(ValueError):
        periods.find(np.zeros(3, np.int64), 24, 2)
