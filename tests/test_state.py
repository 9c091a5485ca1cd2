"""State that outlives a batch: snapshots, replays, list moves, copies taken back."""

import random

import pytest

from quire.operators import entries, stacks
from quire.session import fresh_path
from quire.streaming import drain, edits, tables


def test_a_batch_reads_one_snapshot_and_what_came_after(spark):
    root, want, read = fresh_path(spark, "state"), {}, []
    draw = random.Random(3)
    for n in range(20):
        changed = {draw.randrange(12): n for _ in range(3)}
        for again in range(2 if n in (4, 7, 8) else 1):  # some batches are tried again
            held = tables.read_newest(spark, root, "k bigint, v bigint", ["k"], n)
            assert {r.k: r.v for r in held.collect()} == want
            read.append(len({f.rsplit("/", 2)[1] for f in held.inputFiles()}))
            tables.write_batch(spark.createDataFrame(list(changed.items()), "k bigint, v bigint"), root, n)
            tables.compact(spark, root, "k bigint, v bigint", ["k"], n, every=4)
        want = {**want, **changed}
    assert {r.k: r.v for r in tables.read_newest(spark, root, "k bigint, v bigint", ["k"]).collect()} == want
    assert max(read) <= 5
    # What only snapshots long gone needed is deleted.
    assert tables.finished(spark, root) == list(range(16, 20)) and tables.finished(spark, f"{root}/_newest") == [15, 19]


def test_a_half_written_batch_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    tables.write_batch(spark.createDataFrame([(1, 1)], "k bigint, v bigint"), root, 0)
    tables.write_batch(spark.createDataFrame([(1, 2)], "k bigint, v bigint"), root, 1)
    (tmp_path / "batch=1" / "_SUCCESS").unlink()
    assert tables.finished(spark, root) == [0]
    assert tables.read_newest(spark, root, "k bigint, v bigint", ["k"]).collect() == [(1, 1)]


def test_draining_many_batches(spark, monkeypatch):
    monkeypatch.setattr(tables.compact, "__defaults__", (2,))
    root, want = fresh_path(spark, "drained"), {}
    for n in range(5):
        part = spark.createDataFrame([(f"p{n}", "d", [(0, "a", n + 1, 0), (1, f"b{n % 2}", 2, 0)]), ("p0", "d", [(0, "a", 1, 0), (1, "b0", 2, 0)])], drain.PART)
        drain.drain_batch(spark, root, part, n)
        want["a"] = want.get("a", 0) + n + 1
        want[f"b{n % 2}"] = want.get(f"b{n % 2}", 0) + 2
    assert {r.identity: r.quantity for r in drain.collection(spark, root).collect()} == want
    assert sorted(r.part_key for r in drain.applied(spark, root).collect()) == [f"p{n}" for n in range(5)]


def test_a_part_that_cannot_be_applied_is_set_aside(spark):
    root = fresh_path(spark, "drained")
    parts = [("good", "d", [(0, "a", 2, 0), (1, "a", 1, 0)]), ("twice", "d", [(0, "a", 6, 0), (0, "b", 6, 0)]), ("none", "e", None), ("unplaced", "e", [(None, "a", 1, 0)])]
    for number in (0, 1):
        drain.drain_batch(spark, root, spark.createDataFrame(parts, drain.PART), number)
    assert [(r.identity, r.quantity) for r in drain.collection(spark, root).collect()] == [("a", 3)]
    assert sorted(r.part_key for r in drain.refused(spark, root).collect()) == ["none", "twice", "unplaced"]


def moved(spark, log, before=(), prints=(("two", ["nonfoil", "foil"]), ("etched", ["etched", "foil"]), ("one", ["foil"]), ("none", []))):
    state = spark.createDataFrame(list(before), edits.ENTRY)
    rows = spark.createDataFrame([("e", i, *edit) for i, edit in enumerate(log)], edits.EDIT)
    known = spark.createDataFrame(list(prints), "printing string, finishes array<string>")
    return edits.fold_edits(state, rows, known).first()


@pytest.mark.parametrize(
    "log, want",
    [
        ([("add", "two"), ("choose", "one")], {"printing": "one", "finish": "foil", "picked": True}),
        ([("add", "etched"), ("choose", "etched")], {"finish": "etched", "picked": True}),
        # Agreeing with what was read leaves the finish alone.
        ([("add", "two"), ("refinish", "foil"), ("choose", "two")], {"finish": "foil", "picked": True}),
        ([("add", "two"), ("refinish", "foil"), ("choose", "etched")], {"finish": "etched"}),
        ([("add", "two"), ("refinish", "etched")], {"finish": "nonfoil"}),
        ([("add", "two"), ("cycled", None)], {"finish": "foil"}),
        ([("add", "two"), ("cycled", None), ("cycled", None)], {"finish": "nonfoil"}),
        ([("add", "one"), ("cycled", None)], {"finish": "foil"}),
        ([("add", "none"), ("cycled", None), ("refinish", "foil")], {"finish": "nonfoil"}),
        ([("add", "unknown"), ("refinish", "foil")], {"finish": "nonfoil"}),
        ([("choose", "one"), ("add", "two")], {"printing": "two", "picked": False}),
        ([("add", "two"), ("reported", "t1"), ("reported", "t2"), ("regraded", "good"), ("dropping", "true"), ("dropping", "false")],
         {"reported": "t2", "condition": "good", "dropped": False}),
        ([("add", "two"), ("plus", None), ("minus", None), ("minus", None), ("choose", "one")], {"quantity": edits.GONE, "printing": "two"}),
        ([("add", "two"), ("counted", "0"), ("plus", None)], {"quantity": 2}),
        ([("add", "two"), ("drop", None), ("plus", None)], {"quantity": edits.GONE}),
    ],
)
def test_moves(spark, log, want):
    got = moved(spark, log)
    assert {k: got[k] for k in want} == want


def test_moves_go_on_from_what_a_batch_left(spark):
    first = moved(spark, [("add", "two"), ("refinish", "foil"), ("reported", "t")])
    got = moved(spark, [("cycled", None), ("plus", None)], before=[first])
    assert (got.finish, got.quantity, got.reported, got.printing) == ("nonfoil", 2, "t", "two")


def test_moves_of_one_long_entry_and_many_short_ones(spark):
    rows = [("long", 0, "add", "two")] + [("long", i, "plus", None) for i in range(1, 5000)] + [(f"s{i}", 1, "add", "one") for i in range(2000)]
    log = spark.createDataFrame(rows, edits.EDIT).repartition(4)
    none = spark.createDataFrame([], edits.ENTRY)
    got = {r.entry: r.quantity for r in edits.fold_edits(none, log).collect()}
    assert got.pop("long") == 5000 and got == {f"s{i}": 1 for i in range(2000)}
    assert edits.fold_edits(none, log.limit(0)).count() == 0


PART = "part_key string, digest string, entries array<struct<position:bigint,identity:string,quantity:bigint,note:string>>"


def test_copies_taken_back(spark):
    rows = [
        ("a", "d", [(1, "x", 4, "n"), (2, "y", 1, None), (3, "x", 5, "m")]), ("b", "d", [(1, "x", 2, None)]), ("c", "e", [(1, "x", 9, None), (2, "z", 1, None)]),
        ("0", "e", [(1, "x", 50, None)]), ("f", "g", []), ("g", "g", None),
    ]
    parts = spark.createDataFrame(rows, PART)
    done = spark.createDataFrame([("0",)], "part_key string")
    wanted = spark.createDataFrame([("x", 10), ("x", 2), ("z", 0), ("absent", 3)], "identity string, copies bigint")
    got = {r.part_key: (r.action, r.taken, [tuple(e) for e in r.entries]) for r in stacks.take_back(parts, wanted, done=done, hot_rows=2).collect()}
    assert got == {"a": ("update", 9, [(2, "y", 1, None)]), "b": ("delete", 2, []), "c": ("update", 1, [(1, "x", 8, None), (2, "z", 1, None)])}
    assert sorted(tuple(r) for r in stacks.owed(parts.filter("size(entries) > 0"), done).collect()) == [("d", 2, 4, 12), ("e", 1, 2, 10)]


def test_reads_of_a_list(spark):
    kind = "id int, chosen string, matched array<struct<distance:bigint,prints:array<struct<id:string,finishes:array<string>>>>>"
    rows = [(1, "p9", [(3, [("p1", ["foil"]), ("p2", [])]), (5, [("p3", None)])]), (2, "p1", []), (3, None, None)]
    held = spark.createDataFrame(rows, kind)
    m, c = held.matched, held.chosen
    got = {r.id: (r.a, r.o, r.s) for r in held.select("id", entries.among(m).alias("a"), entries.offered(m, c).alias("o"), entries.sure(held.id * 4, m).alias("s")).collect()}
    assert got == {1: (["p1", "p2"], False, False), 2: ([], False, False), 3: ([], False, False)}
    assert sorted(r.id for r in entries.referenced(held).collect()) == ["p1", "p2", "p3", "p9"]
