"""Packing, preference pairs and the pipeline."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from quire.llm import crf, packing, preference, registry

from . import brute

ROOT = "/root/testdata/sf0.001"


def check(pieces, texts):
    """Pieces against the tokenizer itself; ``texts`` in any order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts)
    left = {}
    for ids in want:
        n = len(ids) // 4
        cuts = packing.bounds_of(n, 1024)
        for a, b in zip(cuts, cuts[1:]):
            key = (a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n)
            left[key] = left.get(key, 0) + 1
    for r in pieces:
        left[r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    assert not any(left.values())
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held), sum(r.length for r in pieces)


def test_packing(spark):
    texts = [r.text for r in registry.table(spark, ROOT, "documents").collect()]
    sequences, tokens = check(registry.op10_packing(spark, ROOT).collect(), texts)
    assert tokens / (1024 * sequences) > 0.97


def test_packing_hard_rows(spark, hard, empty):
    more = spark.createDataFrame([(50, "<|endoftext|> x"), (51, "ſ\u0600 日本 \x1c \x85"), (52, "a   b \n\n c  "), (53, "it's  I'LL\t x\r\n")], "doc_id bigint, text string")
    both = hard.select("doc_id", "text").unionAll(more)
    check(packing.pack(both, registry.tokenizer_path()).collect(), [r.text for r in both.collect()])
    assert packing.pack(empty, registry.tokenizer_path()).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_patterns_meet_demand(demand):
    sizes = np.array(sorted(demand))
    wanted = np.array([demand[s] for s in sizes])
    made, counts = packing.patterns(sizes, wanted, 80)
    assert (made.T @ counts == wanted).all() and (made @ sizes <= 80).all()
    assert counts.sum() <= -(-int(sizes @ wanted) // 80) * 1.15 + 3
    table = packing.places(sizes, made, counts)
    slots = set()
    for k in range(len(table["size"])):
        for rank in range(table["low"][k], table["high"][k]):
            step = rank - table["low"][k]
            slots.add((table["base"][k] + step // table["each"][k], table["slot"][k] + step % table["each"][k]))
    assert len(slots) == wanted.sum()


def test_preference(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "thanks"),
        (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "bad"),
        (5, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, None, None), (7, None, "user", "first"), (None, 0, "user", "lost"),
        (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 1, "assistant", "alone"),
    ]
    turns = preference.numbered(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, place string"))
    pairs = spark.createDataFrame([(0, 1, "chosen"), (0, 2, "rejected"), (1, 5, "chosen"), (1, 6, "rejected"), (2, 7, "chosen"), (2, 8, "rejected")], "pair_id bigint, conv_id bigint, side string")
    got = sorted(preference.format_pairs(turns, pairs).collect(), key=lambda r: (r.pair_id, r.part, r.segment))
    text = {}
    for r in got:
        assert len(text.setdefault((r.pair_id, r.part), "")) == r.start
        text[r.pair_id, r.part] += r.rendered
    assert text[0, "prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert text[0, "chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nthanks<|end|>\n"
    assert [text[0, r.part][r.mask_from : r.mask_to] for r in got if r.mask_to] == ["good<|end|>\n", "bad<|end|>\n"]
    assert (1, "prompt") in text and (1, "chosen") not in text
    assert text[2, "chosen"] == "<|user|>\nfirst<|end|>\n<||>\n<|end|>\n" and text[2, "rejected"].count("x") == 2
    paired = preference.alike(turns)
    by = {r.conv_id: r.pair_id for r in paired.collect()}
    assert len(by) == 6 and by[1] == by[2] if (1 in by and 2 in by) else True
    assert preference.format_pairs(turns.limit(0), pairs).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = registry.table(spark, ROOT, "documents"), []
    from quire.session import materialize

    for _, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, ROOT))
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark, stages):
    rows = [[(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()] for before, _ in stages]
    model = crf.train(*(registry.table(spark, ROOT, t) for t in ("documents", "labels")))
    scored = {r.doc_id: r.score for r in crf.tag(stages[0][0], model).collect()}
    assert ids(stages[0][1]) == {i for i, s in scored.items() if s < crf.PREDICTED}
    last = {t.translate(brute.ASCII): i for i, t in rows[1]}
    assert ids(stages[1][1]) == set(last.values())
    assert ids(stages[2][1]) == {i for i, (_, c) in brute.simhash(rows[2]).items() if i == c}
    items = [(r.item_id, r.text) for r in registry.table(spark, ROOT, "benchmark").collect()]
    assert ids(stages[3][1]) == {i for i, r in brute.contamination(rows[3], items).items() if not r[4]}
    check(stages[4][1].collect(), [t for _, t in rows[4]])
    for before, after in stages[:4]:
        assert after.columns == before.columns and after.count() == len(ids(after))


def test_run_is_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, ROOT).count() == stages[-1][1].count()


def test_stages_pass_other_columns_and_empty_tables(spark, hard, empty):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, hard, ROOT).columns == hard.columns
        assert stage(spark, empty, ROOT).count() == 0


def test_preference_sql_where_first_turns_repeat(spark):
    import duckdb

    from quire.llm import sql
    from tools.check import rows_of

    begins = {1: "a", 2: "b", 3: "a", 4: "c", 5: "b", 6: "a", 7: "d"}
    turns = [(i, 0, "user", t) for i, t in begins.items()] + [(i, 1, "assistant", f"answer {i % 3}") for i in begins] + [(None, 0, "user", "a"), (1, None, None, None)]
    given = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.register("conversations", given.toArrow())
    held = preference.numbered(given)
    ours = preference.format_pairs(held, preference.alike(held))
    theirs = con.sql(sql.PREFERENCE)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(theirs.columns, theirs.fetchall())
