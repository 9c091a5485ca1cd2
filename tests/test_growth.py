"""What a query moves and holds as its input grows, and that it still answers the same."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quire.functions import costs, text as tx
from quire.operators import find, passages, predicates as p, similarity, stacks
from quire.plans import streams
from quire.sources import catalog_files


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_repeats_are_dealt_once_and_without_their_words(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 14))) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(40, None), (None, lines[0] * 3)]
    df = spark.createDataFrame(docs, "k int, t string")
    found = passages.repeated_within(df, "k", "t", run=5)
    got = sorted(map(tuple, found.collect()))
    first, want = {}, []
    for k, t in docs:
        w = (t or "").split()
        for at in range(len(w) - 4) if k is not None else ():
            first.setdefault(tuple(w[at : at + 5]), k)
    for k, t in docs[:40]:
        w, open_ = t.split(), None
        for at in range(len(w) - 4):
            source = first[tuple(w[at : at + 5])]
            if source == k:
                continue
            if open_ and open_[1] == source and at <= open_[3]:
                open_[3] = at + 5
            else:
                open_ = [k, source, at, at + 5]
                want.append(open_)
    assert got == sorted(map(tuple, want)) and len(got) > 40
    # Neither the words of a run nor the runs a second time go through a join.
    assert "phrase" not in plan(found) and "Join" not in plan(found)


def test_a_block_is_compared_in_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(similarity, "TILE_ROWS", 5)
    monkeypatch.setattr(similarity, "TILE_COLUMNS", 7)
    ask, held = (rng.integers(0, 1 << 6, (n, 2)).astype(np.uint64) for n in (23, 40))
    far = np.array([[min((int(a) ^ int(h)).bit_count() for a in x for h in y) for y in held] for x in ask])
    tiles = list((at, c, apart.copy()) for at, c, apart in similarity._tiles(ask, held))
    assert max(apart.size for _, _, apart in tiles) <= 35
    assert all((apart == far[at : at + len(apart), c : c + apart.shape[1]]).all() for at, c, apart in tiles)
    for keep in (1, 3, 9, 50):
        rows, cols, apart = similarity._nearest_rows(ask, held, keep)
        want = [(i, j, far[i, j]) for i in range(23) for j in sorted(range(40), key=lambda j: (far[i, j], j))[:keep]]
        assert list(zip(rows, cols, apart)) == want


def test_ranks_are_counted_in_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(similarity, "RANK_ROWS", 5)
    monkeypatch.setattr(similarity, "RANK_COLUMNS", 3)
    kinds = [(1, 1), (1, 2), (2, 2), (2, 1)]
    for spread in (1 << 6, 1 << 63):
        ask, held = (rng.integers(0, spread, (n, 2)).astype(np.uint64) for n in (23, 41))
        held[7], held[8], ask[3] = 0, (1 << 64) - 1, (1 << 64) - 1
        copies = rng.choice([1, 1, 3], len(held))
        apart = [[[min((int(a) ^ int(h)).bit_count() for a in x[:w] for h in y[:v]) for y in held] for x in ask] for w, v in kinds]
        bounds = np.array([[-1 if i == 5 else draw[i % 41] for i, draw in enumerate(far)] for far in apart], np.int16)
        nearer, same, least, beyond = similarity._ranked(ask, held, copies, bounds, kinds)
        for k in range(len(kinds)):
            for i, (far, t) in enumerate(zip(apart[k], bounds[k])):
                counts = sum(n for d, n in zip(far, copies) if d < t), sum(n for d, n in zip(far, copies) if d == t)
                assert (nearer[k, i], same[k, i], least[k, i]) == (*counts, min(far))
                if counts[0] == 0 and counts[1] <= 1:  # past the bound nothing may be left: further than any hash
                    assert min(beyond[k, i], 65) == min([d for d in far if d > t], default=65)


def test_every_pair_of_blocks_has_a_task_of_its_own(spark, monkeypatch):
    for n in (1, 7, 60):
        names = spark.createDataFrame([(i,) for i in similarity._apart_in_partitions(spark, n)], "block bigint").repartition(n, "block")
        assert names.select(F.spark_partition_id().alias("p")).distinct().count() == n
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 10)
    monkeypatch.setattr(similarity, "INDEX_BLOCK", 10)
    rows = spark.range(40).selectExpr("id", "array(id) AS hashes").localCheckpoint()
    met = similarity._paired(rows, "id", rows, "id", []).applyInArrow(
        lambda x, y: pa.table({"p": [TaskContext.get().partitionId()], "n": [x.num_rows * y.num_rows]}), "p bigint, n bigint").collect()
    assert len({r.p for r in met}) == len(met) >= 16 and sum(r.n for r in met) == 1600


def test_a_text_is_cut_up_once_for_all_its_symbols(spark):
    df = spark.createDataFrame([("a b a 2 3 c",), ("",), (None,)], "t string")
    counts = costs.symbol_counts(F.split("t", " "))
    # The words stand once in the expression, wherever its symbols are counted.
    assert plan(df.select(counts)).count("split(t#") == 1
    got = [r[0] for r in df.select(costs.symbol_counts(F.filter(F.split("t", " "), lambda w: w != ""))).collect()]
    assert got == [{"A": 2.0, "B": 1.0, "generic": 5.0, "C": 1.0}, {}, None]


def test_what_lands_is_dealt_by_how_much_there_is(spark, monkeypatch):
    rows = spark.range(1000).toDF("n")
    assert streams._share(rows) == 1
    monkeypatch.setattr(streams, "_LANDED", 50)
    assert streams._share(rows) == 11


def test_equal_places_are_looked_for_by_hash(spark):
    rows = spark.createDataFrame([("a", i, 60 + i) for i in range(4)] + [("b", 1, 3)], "k string, o int, q long")
    placed = stacks.assign_bins(rows, "k", "o", F.col("q"), F.lit(0), copies=100)
    assert sorted((r.k, r.o, r.bin) for r in placed.collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 0)]
    with pytest.raises(ValueError, match="two rows"):
        stacks.assign_bins(rows.union(rows), "k", "o", F.col("q"), F.lit(0), copies=100)


def test_published_rows_are_come_by_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(n):
        calls.add(1)
        return f"x{n % 3}"

    rows = spark.range(9).select("id", said("id").alias("said"), F.array(said("id")).alias("all"))
    rows = rows.select("id", "said", F.col("all"))
    catalog_files.write_catalog(rows, str(tmp_path), "1", ["said"], [F.asc("id")], arrays={"all": "places"})
    back = catalog_files.read_catalog(spark, str(tmp_path), ["id", "said", "all"])
    assert sorted((r.id, r.said, r["all"]) for r in back.collect()) == [(i, f"x{i % 3}", [f"x{i % 3}"]) for i in range(9)]
    assert calls.value <= 18


def test_each_predicate_finds_what_it_finds_alone(spark):
    cards = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (4, "b")], "id int, kind string")
    prints = spark.createDataFrame(
        [(1, "x", 1), (1, "y", 2), (2, "x", 2), (2, None, 1), (3, "y", None), (None, "x", 1), (1, "x", 1)], "id int, kind string, n int"
    )
    x, two = p.holds(F.col("kind") == "x", child=True), p.holds(F.col("n") == 2, child=True)
    own = p.holds(F.col("kind") == "a")
    asked = {
        "own": own, "x": x, "both": x & two, "either": x | two, "not": ~x & ~two, "mixed": own & two, "any": own | x,
        "ever": p.any_child(F.col("kind") == "y", "_y") & two, "neither": ~own & ~x,
    }
    got = find.match_each(cards, prints, asked, "id")
    want = [(n, r.id) for n, pred in asked.items() for r in find.match_cards(cards, prints, pred, "id").collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    few = find.match_each(cards, prints, {"x": x, "mixed": own & two, "own": own}, "id")
    assert plan(few).count("kind#") and plan(few).count("Scan ExistingRDD") == 3  # cards twice, printings once


def test_only_letters_that_open_into_several_go_the_long_way(spark):
    several = dict(tx._unaccent_tables()[2])
    texts = ["O’A Brién — x", *several, "ậz 각 …", "plain", None, "क़’é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", tx.strip_marks(F.col("t")).alias("s"), F.col("t").rlike(tx._class_of(list(several))).alias("long")).collect()
    assert [r.s for r in sorted(rows)] == [None if t is None else tx.bare(t) for t in texts]
    assert [r.long for r in sorted(rows)] == [None if t is None else any(c in several for c in t) for t in texts]
