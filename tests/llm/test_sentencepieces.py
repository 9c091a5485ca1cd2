"""Encoding by an agenda of merges, against the library."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import registry, sentencepieces

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words():
    return sentencepieces.Vocabulary(registry.pieces_path())


def digests(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query(spark, words):
    texts = {r.doc_id: r.text for r in registry.table(spark, ROOT, "documents").collect()}
    got = registry.op11_sentencepieces(spark, ROOT).collect()
    assert len(got) == len(texts) and all(r.as_library for r in got)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {k: digests(words.library, t) for k, t in texts.items()}


def test_hard_rows(spark, hard, empty, words):
    model = registry.pieces_path()
    more = spark.createDataFrame(
        [(50, "▁▁a ▁"), (51, "① <0x41> <s></s>\x00"), (52, " " * 90), (53, "don't  a1b2 ,x"), (54, "日本語" * 400), (55, "\U0001f600 é́ שלום")], "doc_id bigint, text string"
    )
    both = hard.select("doc_id", "text").unionAll(more)
    rows = sentencepieces.decode(sentencepieces.encode(both, model), model).collect()
    assert all(r.same and r.same_decoded for r in rows)
    want = sorted((str(r.doc_id), words.library.encode(r.text or "")) for r in both.collect())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert sentencepieces.encode(empty, model).count() == 0
    with pytest.raises(ValueError):
        sentencepieces.decode(spark.createDataFrame([([5], 1)], "ids array<int>, Decoded int"), model)
    assert sentencepieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), model).select("decoded").collect() == [(None,), ("",)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ▁ab'é日①\U0001f600\n12the,.»"), max_size=40))
def test_ids_are_the_library_s(words, text):
    ids, same = words.encode(text)
    assert same and ids == words.library.encode(text)


def test_any_ids_decode_as_the_library_does(words):
    draw = random.Random(1)
    near = [0, 1, 2, 259, 28705, 3 + 0xE2, 3 + 0x91, 3 + 0xA0, 3 + 0xF0, 3 + 0xC3]
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.choice(near)]) for _ in range(draw.randrange(9))]
        assert words.decode(ids) == (words.library.decode(ids), True)


def test_long_texts_in_stretches(words, monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["word", " ", "  ", "▁", " a", "é", "日本", ", "]) for _ in range(3000))
    want = words.library.encode(text)
    for size in (1, 7, 100, 10**6):
        monkeypatch.setattr(sentencepieces.stretches, "__defaults__", (size,))
        assert len(list(sentencepieces.stretches(text))) > 1 or size > len(text)
        assert words.encode(text) == (want, True)
    monkeypatch.setattr(sentencepieces.stretches, "__defaults__", (1,))
    for text in ("a b ", "a b", "a ", " ", "", "ab  c"):
        assert words.encode(text) == (words.library.encode(text), True)


def test_forgetting_words_changes_nothing(words, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    text = " ".join(f"word{i % 7} other{i % 5}" for i in range(200))
    assert words.encode(text) == (words.library.encode(text), True)


def test_what_the_library_finds_otherwise_is_told(monkeypatch):
    words = sentencepieces.Vocabulary(registry.pieces_path())
    right = words.seen.merge
    words.seen.merge = lambda word: (5,) if word in ("▁bad", "▁" + "x" * 99) else right(word)
    for _ in range(2):
        assert [same for _, same in words.encode_all(["good", "a bad one", "", "x" * 99, "good bad"])] == [True, False, True, False, False]


def test_words_step_together_as_each_alone(words):
    draw = random.Random(3)
    some = {"".join(draw.choice("▁▁aehilnorst'.é日") for _ in range(draw.randrange(1, 40))) for _ in range(4000)}
    some |= {"▁" * n for n in range(1, 33)} | {"a" * n for n in range(1, 33)} | {"\U0001f600a", "①"}
    together = words.together(sorted(some))
    assert together == {word: words.merge(word) for word in together}
    plain = {word for word in some if len(word) <= sentencepieces.LONGEST and all(c in words.id_of for c in word)}
    assert set(together) == plain and len(plain) > 1000
    assert words.together([]) == {} == words.together(["①"])


def test_new_words_of_a_batch_are_not_merged_one_by_one(monkeypatch):
    words = sentencepieces.Vocabulary(registry.pieces_path())
    alone = []
    right = words._short
    monkeypatch.setattr(words, "_short", lambda word: alone.append(word) or right(word))
    texts = [f"these are words never met {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["one ①"]
    assert words.encode_all(texts) == [(words.library.encode(text), True) for text in texts]
    assert alone == ["▁①"]


def test_lists_decode_at_once_as_each_alone(words):
    draw = random.Random(4)
    near = [0, 1, 2, 259, 28705, 3 + 0xE2, 3 + 0x91, 3 + 0xA0, 3 + 0xF0, 3 + 0xC3]
    rows = [[draw.choice([draw.randrange(32000), draw.choice(near)]) for _ in range(draw.randrange(9))] for _ in range(1000)]
    rows[::50] = [None] * 20
    for column in (pa.array(rows, pa.list_(pa.int32())), pa.array([[5], *rows, [6]], pa.list_(pa.int32())).slice(1, 1000)):
        texts, same = words.decode_all(column)
        assert texts == [None if ids is None else words.library.decode(ids) for ids in rows] and all(same)
    for rows in ([], [None], [[]], [[], None]):
        assert words.decode_all(pa.array(rows, pa.list_(pa.int32()))) == ([None if x is None else "" for x in rows], [True] * len(rows))
