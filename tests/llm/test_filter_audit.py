"""The filter audit against a plain walk of every order, however files fall into batches."""

import math
import random
import re
from collections import Counter
from itertools import permutations

from quire.llm import filter_audit
from quire.session import fresh_path
from quire.streaming import keyed

from . import brute


def walk(docs, labels):
    """{(part, order, step): the seven counts} for [(id, text, part)]."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails, out = {}, {}
    for n, (i, text, part) in enumerate(docs):
        text = text or ""
        words = re.findall(brute.SPACED, text)
        fails[n] = (part or "", i in good, i in toxic, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]})
    shapley = Counter()
    for part in {f[0] for f in fails.values()}:
        for order in permutations("ABCDE"):
            left = [f for f in fails.values() if f[0] == part]
            seen = set()
            for step, name in enumerate(order, 1):
                own = [f for f in fails.values() if f[0] == part and f[3][name]]
                gone = [f for f in left if f[3][name]]
                left = [f for f in left if not f[3][name]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(any(f[3][o] for o in seen) for f in own), sum(sum(f[3].values()) == 1 for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone))
                seen.add(name)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(n, draw):
    words = [f"w{i}" for i in range(400)] + ["AB", "x#", "é"]
    texts = [None, "", " ".join(words[:250]), "a " * 300, " ".join(words), "UPPER CASE", "short one", "50% off " * 10]
    return [(None if draw.random() < 0.1 else draw.randrange(60), draw.choice(texts), draw.choice([None, "", "en", "de"])) for _ in range(n)]


def write(spark, docs, path, mode="errorifexists"):
    schema = "doc_id bigint, text string, lang string, key int, mask string"
    spark.createDataFrame([(*d, 1, "m") for d in docs], schema).repartition(5).write.mode(mode).parquet(path)


def labelled(spark, draw):
    told = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 0)]
    return told, spark.createDataFrame(told, "doc_id bigint, quality int, toxic int")


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_any_order_of_arrival(spark, monkeypatch):
    draw = random.Random(5)
    told, labels = labelled(spark, draw)
    docs = [r for r in rows(300, draw)]
    path, root = fresh_path(spark, "given"), fresh_path(spark, "audit")
    monkeypatch.setattr(filter_audit, "HELD", 3)
    write(spark, docs[:150], path)
    got = filter_audit.audit(spark, path, labels, root, batches=5)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found(got) == walk(docs[:150], told)
    # More files later, labels by shuffle: only they are read, and smaller ids retract what was counted.
    write(spark, docs[150:], path, "append")
    monkeypatch.setattr(filter_audit, "SMALL", 1)
    assert found(filter_audit.audit(spark, path, labels, root, batches=3)) == walk(docs, told)
    batches = filter_audit.read_batches(spark, f"{root}/counters", filter_audit.CHANGE)
    assert batches.select("batch").distinct().count() > 5 and batches.filter("n < 0").count() > 0


def test_empty_table(spark):
    path = fresh_path(spark, "none")
    write(spark, [], path)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark, path, labels).count() == 0


def test_a_large_group_of_copies_sends_the_state_one_row_a_task(spark):
    rows = spark.range(20_000).selectExpr("id", "X'0102' AS k", "'en' AS part", "CAST(0 AS INT) AS mask", "true AS good", "false AS toxic")
    rows = rows.selectExpr("id", "unhex(repeat('ab', 32)) AS key", "part", "mask", "good", "toxic").repartition(4)
    sent = filter_audit._combined(rows.select("key", "id", "part", "mask", "good", "toxic")).collect()
    assert len(sent) <= 8 and sum(r.n for r in sent) == 20_000
    assert sum(r.n for r in sent if len(r.key) == 32) == 4


def test_many_labels_are_not_broadcast_by_an_estimate(spark, monkeypatch):
    docs = spark.range(50).selectExpr("unhex(sha2(CAST(id AS STRING), 256)) AS key", "IF(id % 7 = 0, NULL, id % 20) AS id", "'en' AS part", "0 AS mask")
    labels = spark.range(0, 20, 2).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS quality", "CAST(id % 3 = 0 AS INT) AS toxic")
    few = filter_audit._labelled(docs, labels, "doc_id")
    monkeypatch.setattr(filter_audit, "SMALL", 1)
    many = filter_audit._labelled(docs, labels, "doc_id")
    plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (few, many)]
    assert ["Broadcast" in p for p in plans] == [True, False]
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_shares_add_up(spark):
    draw = random.Random(6)
    docs = rows(80, draw)
    counts = walk(docs, [])
    for part in {k[0] for k in counts}:
        removed = sum(v[1] for k, v in counts.items() if k[0] == part and k[1] == "ABCDE")
        by = {k[1][k[2] - 1]: v[-1] for k, v in counts.items() if k[0] == part}
        assert sum(by.values()) == removed * math.factorial(5)


def test_files_a_batch(spark):
    path = fresh_path(spark, "files")
    write(spark, rows(20, random.Random(1)), path)
    n = len(spark.read.parquet(path).inputFiles())
    assert [keyed.files_a_batch(spark, path, b) for b in (1, n, 2 * n)] == [n, 1, 1]
