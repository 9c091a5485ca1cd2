"""Results over the whole input where a shorter look would miss some."""

from pyspark.sql import functions as F

from quire.operators import similarity


def test_the_nearest_alike_may_lie_past_any_rank(spark):
    # One artwork and its like 40 bits away, thirty strangers 1 bit away, copies, a lone label, a null one.
    rows = [(0, [0], 1), (1, [(1 << 40) - 1], 1)] + [(10 + i, [1 << i], 2) for i in range(30)]
    rows += [(50, [-1], 3), (51, [-1], 3), (52, [-1], 3), (60, [5], 4), (70, [6], None), (71, [6], None)]
    index = spark.createDataFrame(rows, "artwork bigint, hashes array<bigint>, label int")
    asked = index.withColumnRenamed("artwork", "query_id")
    got = {r.query_id: r.distance for r in similarity.nearest_alike(asked, index, "label").collect()}
    assert got == {0: 40, 1: 40, **{10 + i: 2 for i in range(30)}, 50: 0, 51: 0, 52: 0}
    ten = similarity.nearest(asked, index, keep=11)
    assert ten.filter((F.col("query_id") == 0) & (F.col("artwork") == 1)).count() == 0


def test_nearest_alike_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity, "INDEX_BLOCK", 16)
    import random

    draw = random.Random(3)
    rows = [(i, [draw.getrandbits(63), draw.getrandbits(63)], i % 3) for i in range(90)]
    index = spark.createDataFrame(rows, "artwork bigint, hashes array<bigint>, label int")
    got = {r.query_id: r.distance for r in similarity.nearest_alike(index.withColumnRenamed("artwork", "query_id"), index, "label").collect()}
    assert got == {i: min((x ^ y).bit_count() for j, b, m in rows if m == k and j != i for x in a for y in b) for i, a, k in rows}
