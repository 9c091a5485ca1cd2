"""Exact, near, substring and suffix dedup against brute force."""

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.llm import debruijn, exact_dedup, registry, repeats, simhash_grid, suffix_dedup
from quire.llm.components import components

from . import brute

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").select("doc_id", "text").collect()]


def numbered(df):
    """Rows with distinct ids, in the order the operators give rows that share one."""
    got = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(i, r.text) for i, r in enumerate(got)], [r.doc_id for r in got]


def words_row(r):
    import hashlib

    return r.n_words, sum(s["end"] - s["start"] for s in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()


def bytes_row(r):
    import hashlib

    return r.n_bytes, sum(s["end"] - s["start"] for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()


@pytest.mark.parametrize("unequal", [repeats.UNEQUAL, 2])
def test_repeated_words(docs, rows, unequal):
    got = {r.doc_id: words_row(r) for r in debruijn.remove(docs, unequal=unequal).collect()}
    assert got == brute.repeated_words(rows)


@pytest.mark.parametrize("unequal", [repeats.UNEQUAL, 2])
def test_repeated_bytes(docs, rows, unequal):
    got = {r.doc_id: bytes_row(r) for r in suffix_dedup.remove(docs, unequal=unequal).collect()}
    assert got == brute.repeated_bytes(rows)


def test_registered_digests(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op9_debruijn(spark, ROOT).collect()}
    assert got == brute.repeated_words(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op4_suffix_dedup(spark, ROOT).collect()}
    assert got == brute.repeated_bytes(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op8_simhash_grid(spark, ROOT).collect()}
    assert got == brute.simhash(rows)


def test_hard_rows_words(hard):
    plain, ids = numbered(hard)
    want = brute.repeated_words(plain)
    got = debruijn.remove(hard).collect()
    assert Counter((r.doc_id, *words_row(r)) for r in got) == Counter((ids[i], *want[i]) for i in want)


def test_hard_rows_bytes(hard):
    plain, ids = numbered(hard)
    want = brute.repeated_bytes(plain)
    got = suffix_dedup.remove(hard).collect()
    assert Counter((r.doc_id, *bytes_row(r)) for r in got) == Counter((ids[i], *want[i]) for i in want)


def test_empty_tables(empty):
    assert debruijn.remove(empty).count() == 0
    assert suffix_dedup.remove(empty).count() == 0
    assert simhash_grid.near_groups(empty).count() == 0
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.keep_one(empty).columns == empty.columns
    assert simhash_grid.keep_one(empty).count() == 0


def test_exact_hard_rows(hard):
    got = exact_dedup.groups(hard).collect()
    assert len(got) == hard.count()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
    kept = exact_dedup.keep_one(hard)
    assert kept.columns == hard.columns and kept.count() == len(by)


def test_near_hard_rows(hard):
    got = simhash_grid.near_groups(hard).collect()
    assert len(got) == hard.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {4, 5, 6} and {r.component_id for r in zero} == {4}
    assert simhash_grid.keep_one(hard).columns == hard.columns


def test_fingerprint_hash_is_the_engine_s(spark):
    text = "Der Ötzi  ist\tALT und müde"
    split = text.translate(brute.ASCII).split()
    grams = [" ".join(split[i : i + 3]) for i in range(len(split) - 2)]
    row = spark.range(1).select(*[F.xxhash64(F.lit(g)).alias(str(i)) for i, g in enumerate(grams)]).first()
    assert [h & (1 << 64) - 1 for h in row] == simhash_grid.shingle_hashes(text.encode())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 4), st.sets(st.integers(0, 63), max_size=6)), max_size=25))
def test_layers_lose_no_pair(centres, flips):
    """Every close pair shares a cell, and links join what close pairs join."""
    import numpy as np

    prints = set(centres)
    for i, bits in flips:
        x = centres[i % len(centres)]
        for b in bits:
            x ^= 1 << b
        prints.add(x)
    fp = np.array(sorted(prints), np.uint64).view(np.int64)
    word = simhash_grid._unary_np(fp.view(np.uint64)).view(np.int64)
    found = set()
    for mask in simhash_grid.layers():
        cell = word & mask
        order = np.argsort(cell, kind="stable")
        found |= {tuple(sorted(p)) for p in simhash_grid.cell_links(cell[order], fp[order], 3)}

    def groups(links):
        root = {int(x): int(x) for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}

    close = [(int(a), int(b)) for a in fp for b in fp if a < b and ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 3]
    assert groups(found) == groups(close)


def test_large_cells_in_blocks(spark):
    centre = 0x0123456789ABCDEF
    near = [centre] + [centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    prints = spark.createDataFrame([(x,) for x in near], "fp bigint")
    linked = components(simhash_grid.links(prints, block=16))
    assert linked.count() == len(near) and linked.select("root").distinct().count() == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_compaction_chains_only_where_nothing_branches(spark):
    pieces = [("a", 0, 4, 1), ("a", 5, 9, 2), ("a", 10, 12, 3), ("b", 3, 7, 1), ("b", 8, 12, 2), ("b", 14, 15, 3)]
    keys = {"a": 1, "b": 2}
    df = spark.createDataFrame([(keys[k], a, b, n) for k, a, b, n in pieces], "key bigint, first int, last int, name bigint")
    got = {tuple(r) for r in debruijn.compact(df).select("key", "first", "last").collect()}
    assert got == {(1, 0, 9), (1, 10, 12), (2, 3, 12), (2, 14, 15)}


def test_which_row_of_a_group_stays_depends_on_the_rows_alone(spark):
    rows = [(1, "abc", 1, {"a": 1}), (1, "Abc", 1, {"a": 1}), (1, "ABC", 2, None), (None, "abc", 9, None), (2, "xyz", 1, None), (2, "xyz", 3, None), (3, None, 1, None), (4, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sha int, key map<string,int>")
    want = {(1, "abc", 1), (2, "xyz", 3), (4, "", 0)}
    for n in (1, 2, 5):
        kept = exact_dedup.keep_one(docs.repartition(n))
        assert kept.schema == docs.schema and {tuple(r)[:3] for r in kept.collect()} == want
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0
