import random

from pyspark.sql import functions as F

from quire.operators import folding, ranking


def rows(n=400, seed=1):
    r = random.Random(seed)
    # A third of all rows sit in one group, and some keys are null.
    return [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{r.randrange(8)}", i, r.randrange(5)) for i in range(n)]


def test_hot_groups_rank_like_others(spark):
    df = spark.createDataFrame(rows(), "g string, i int, v int")
    order = [F.desc("v"), F.asc("i")]
    ask = lambda hot: sorted(map(tuple, ranking.ranked(df, ["g"], order, "rn", {"s": F.col("v")}, hot_rows=hot).collect()), key=str)
    assert ask(5) == ask(10**6)


def test_global_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame(rows(), "g string, i int, v int").repartition(7)
    got = {r.i: r.seq for r in ranking.number_rows(df, [F.desc("v"), F.asc("i")]).collect()}
    want = sorted(rows(), key=lambda r: (-r[2], r[1]))
    assert got == {r[1]: at for at, r in enumerate(want, 1)}


def test_run_offsets(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 2), ("d", 1)], "k string, n int")
    assert {r.k: r.start for r in ranking.run_offsets(df, [F.asc("k")], "n").collect()} == {"a": 0, "b": 3, "c": 3, "d": 5}


def test_quantiles_of_a_hot_group(spark):
    df = spark.createDataFrame([(g or "", v + i % 7) for g, i, v in rows()], "g string, v int")
    targets = {"mid": folding.upper_middle, "p90": folding.nearest_rank(0.9), "p50": folding.nearest_rank(0.5)}
    got = {r.g: (r.mid, r.p90, r.p50) for r in folding.quantiles(df, ["g"], "v", targets, hot_rows=3).collect()}
    by = {}
    for g, i, v in rows():
        by.setdefault(g or "", []).append(v + i % 7)
    for g, held in by.items():
        held.sort()
        rank = lambda p: held[min(len(held), max(1, -(-p * len(held) // 100))) - 1]
        assert got[g] == (held[len(held) // 2], rank(90), rank(50))


def test_digest_is_the_same_streamed(spark):
    import hashlib

    lines = [("a", f"{i % 7}\tx{i % 5}é") for i in range(60)] + [("b", "one")]
    df = spark.createDataFrame(lines, "k string, line string")
    small = {r.k: r.digest for r in folding.content_digest(df, ["k"], "line").collect()}
    large = {r.k: r.digest for r in folding.content_digest(df, ["k"], "line", limit=10).collect()}
    text = "\n".join(sorted((t for k, t in lines if k == "a"), key=str.encode))
    assert small == large
    assert small["a"] == "sha256-" + hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.createDataFrame(rows(), "g string, i int, v int")
    name = lambda d: folding.table_fingerprint(d).first()["hash"]
    assert name(df) == name(df.orderBy(F.desc("i")).repartition(5, "g"))
    assert name(df) != name(df.filter("i <> 3"))
    assert name(df) != name(df.unionByName(df.filter("i = 3")))


def test_first_seen_and_common_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "i int, w string")
    assert {r.w: r.number for r in ranking.number_by_first_seen(df, "w", ["i"]).collect()} == {"b": 0, "a": 1, "c": 2}
    assert [(r.value, r.position) for r in ranking.common_first(df, "w").orderBy("position").collect()] == [("b", 0), ("a", 1), ("c", 2)]
