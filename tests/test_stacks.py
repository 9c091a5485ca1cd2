"""The stack algebra against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import stacks
from quire.streaming import drain, edits


def rows(seed, n=160, top=9):
    r = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{r.randrange(6)}", i, r.randrange(1, top), r.randrange(3)) for i in range(n)]


def fill(items, policy, copies, lots):
    """(bin of each item) by trying bins in order."""
    bins, out = [], []
    first = None
    for q, n, fixed in items:
        tries = [] if fixed else range(len(bins)) if policy == "first" else [first] if policy == "only" and bins else [len(bins) - 1] if bins else []
        for at in tries:
            if bins[at][0] + q <= copies and bins[at][1] + n <= lots:
                bins[at][0] += q
                bins[at][1] += n
                out.append(at)
                break
        else:
            first = len(bins) if first is None else first
            bins.append([q, n])
            out.append(len(bins) - 1)
    return out


@pytest.mark.parametrize("policy", ["first", "only", "last"])
@pytest.mark.parametrize("seed", [1, 2])
def test_bins(spark, policy, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, i int, q int, n int")
    got = {r.i: r.bin for r in stacks.assign_bins(df, "k", "i", F.col("q"), F.col("n"), policy, copies=20, max_lots=4).collect()}
    for key in {d[0] for d in data}:
        held = [d for d in data if d[0] == key]
        assert [got[d[1]] for d in held] == fill([(q, n, False) for _, _, q, n in held], policy, 20, 4)


def test_equal_rows_take_the_ranked_way(spark):
    data = [("hot", i, 3, 1) for i in range(50)] + [("cold", i, 1, 0) for i in range(4)]
    df = spark.createDataFrame(data, "k string, i int, q int, n int")
    placed = stacks.assign_bins(df, "k", "i", F.col("q"), F.col("n"), copies=10, max_lots=64, hot_rows=7)
    got = {(r.k, r.i): r.bin for r in placed.collect()}
    assert [got["hot", i] for i in range(50)] == [i // 3 for i in range(50)]
    assert {got["cold", i] for i in range(4)} == {0}


def test_collapse_conserves_copies_and_dates(spark):
    data = [("a", 0, 2, ["y", "x", "x"], "2024-01-02T00:00:00Z", None), ("a", 1, 3, ["x", "y", "x"], "2024-01-01T22:00:00-05:00", "2024-05-01T00:00:00Z"),
            ("b", 2, 9, ["q", "p", "q"], "2024-01-01T00:00:00Z", None), ("a", 3, 5, ["x", "y"], "2023-01-01T00:00:00Z", "2024-04-01T00:00:00Z")]
    df = spark.createDataFrame(data, "k string, i int, quantity int, tags array<string>, created string, updated string")
    got = {(r.k, r.bin): r for r in stacks.collapse(df, "k", "i", lots=None, copies=9, tags="tags", created="created", updated="updated").collect()}
    assert {k: r.quantity for k, r in got.items()} == {("a", 0): 5, ("a", 1): 5, ("b", 0): 9}
    assert got["a", 0].created == "2024-01-02T00:00:00Z" and got["a", 0].updated == "2024-05-01T00:00:00Z"
    assert got["a", 0].tags == ["x", "y"]
    # A row that merged with none is kept as written.
    assert got["b", 0].tags == ["q", "p", "q"]


def test_identity_text(spark):
    c = F.col
    df = spark.createDataFrame([("i", "foil", None, None, None, ["b", "a", "b"], 'say "x"\n')], "p string, f string, c string, b string, x boolean, t array<string>, n string")
    got = df.select(stacks.stack_identity(c("p"), c("f"), c("c"), c("b"), c("x"), c("t"), c("n")).alias("s")).first().s
    assert got == '["i","foil",null,null,false,["a","b","b"],"say \\"x\\"\\n"]'


@pytest.mark.parametrize("seed", [3, 4])
def test_reconcile(spark, seed):
    data = rows(seed)
    held = [(f"k{i % 6}", f"rec{i}", 3 + i, i) for i in range(10)] + [("hot", "rec-hot", 15, 99)]
    got = stacks.reconcile(
        spark.createDataFrame([d[:3] for d in data], "k string, at int, quantity int"),
        spark.createDataFrame(held, "k string, held_id string, quantity int, at int"), "k", "at", copies=20,
    ).collect()
    want = {}
    for key in {d[0] for d in data}:
        start = [(h[1], h[2]) for h in held if h[0] == key]
        new = [d[2] for d in data if d[0] == key]
        bins = fill([(q, 0, True) for _, q in start] + [(q, 0, False) for q in new], "first", 20, 64)
        for at, q in zip(bins[len(start):], new):
            want.setdefault((key, at), [start[at][0] if at < len(start) else None, start[at][1] if at < len(start) else 0])[1] += q
    assert sorted((r.k, r.held_id or "", r.after) for r in got) == sorted((k, h or "", q) for (k, _), (h, q) in want.items())


@pytest.mark.parametrize("block", [10**6, 40])
def test_pack(spark, block):
    r = random.Random(5)
    data = [("big", i, r.randrange(1, 40)) for i in range(333)] + [("one", 0, 500), ("two", 0, 90), ("two", 1, 11)]
    df = spark.createDataFrame(data, "f string, i int, s int")
    got = {(x.f, x.i): x.part for x in stacks.pack_parts(df, "f", "i", F.col("s"), entries=7, chars=100, block=block).collect()}
    part = count = size = 0
    last = None
    for f, i, s in data:
        if f != last:
            part = count = size = 0
            last = f
        if count >= 7 or (size + s > 100 and count):
            part, count, size = part + 1, 0, 0
        count, size = count + 1, size + s
        assert got[f, i] == part, (f, i)


def test_allocate_fractions(spark):
    df = spark.createDataFrame([("a", 1, 2.7, 4), ("a", 2, 0.9, 4), ("a", 3, 5.0, 4), ("a", 4, 1.0, 4)], "k string, i int, q double, copies int")
    got = [r["take"] for r in stacks.allocate(df, ["k"], [F.asc("i")], "q", "copies").orderBy("i").collect()]
    assert got == [2, 0, 2, 0]


def test_then_changes(spark):
    schema = "uri string, dropped boolean, v int"
    first = spark.createDataFrame([("a", False, 1), ("b", False, 2), ("c", True, None)], schema)
    second = spark.createDataFrame([("a", False, 5), ("b", True, None), ("c", False, 9)], schema)
    got = {r.uri: (r.written, r.v) for r in stacks.then_changes(first, second, "uri", "dropped").collect()}
    assert got == {"a": (True, 5), "b": (False, None), "c": (True, 9)}


def test_drained_part_replays_once(spark, tmp_path):
    part = spark.createDataFrame(
        [("p", "d", [(0, "a", 6, 0), (1, "a", 6, 0), (2, "b", 1, 0)]), ("q", "e", [(0, "b", 2, 0)])], drain.PART
    )
    root = str(tmp_path)
    for number in (0, 0, 1):  # the second is a replay, the third a re-send
        drain.drain_batch(spark, root, part, number, copies=10)
    held = sorted((r.identity, r.quantity) for r in drain.collection(spark, root).collect())
    assert held == [("a", 6), ("a", 6), ("b", 3)]
    assert {r.part_key for r in drain.applied(spark, root).collect()} == {"p", "q"}


def test_edits_stop_at_gone(spark):
    log = [("a", 1, "add", None), ("a", 2, "plus", None), ("a", 3, "minus", None), ("a", 4, "minus", None), ("a", 5, "add", None),
           ("b", 1, "plus", None), ("b", 2, "add", None), ("b", 3, "counted", "20000"), ("b", 4, "regraded", "good"), ("b", 5, "dropping", "true")]
    none = spark.createDataFrame([], "entry string, quantity bigint, finish string, condition string, dropped boolean, seq bigint")
    got = {r.entry: r for r in edits.fold_edits(none, spark.createDataFrame(log, "entry string, seq bigint, op string, value string")).collect()}
    assert got["a"].quantity == edits.GONE
    assert (got["b"].quantity, got["b"].condition, got["b"].dropped) == (10000, "good", True)
