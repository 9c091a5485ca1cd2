"""Decontamination, URL reputation and the two trained scores."""

import pytest

from quire.llm import crf, decontaminate, gam, labelled, registry, url_reputation

from . import brute

ROOT = "/root/testdata/sf0.001"


def row_of(r):
    import hashlib

    sha = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
    return r.n_words, r.n_hit, len(r["items"]), sha, r.contaminated


def test_contamination_on_given_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in registry.op1_decontaminate(spark, ROOT).collect()}
    assert got == brute.contamination(docs, items)


def test_contamination_edges(spark, hard, empty):
    items = [(1, "seven eight"), (2, "One two, THREE four five six seven eight nine ten eleven twelve thirteen fourteen!"), (3, ""), (4, None), (5, "wörter"), (2, "seven eight"), (6, "absent words only here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plain = [(i, r.text) for i, r in enumerate(hard.select("doc_id", "text").collect())]
    want = brute.contamination(plain, items)
    got = decontaminate.judge(hard, bench).collect()
    assert sorted(map(row_of, got)) == sorted(want.values())
    kept = decontaminate.drop_contaminated(hard, bench)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 11, 12, 13, 14}
    assert decontaminate.judge(empty, bench).count() == 0
    assert decontaminate.judge(hard, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


@pytest.mark.parametrize("url, host, path", [
    ("http://A.Example.ORG/x?y=/z", "a.example.org", "/x"), ("https://h:80#f", "h:80", ""), ("nothing", "", ""), (None, "", ""),
    ("x://É.com?q", "É.com", ""), ("a://b://c/d", "b:", "//c/d"), ("", "", ""),
])
def test_host_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string")
    from pyspark.sql import functions as F

    assert tuple(df.select(*url_reputation.host_path(F.col("url"))).first()) == (host, path)


def test_rules_and_reputation(spark):
    urls = [
        (1, "http://org/a"), (2, "http://x.example.org/es/1"), (3, "http://x.example.org/en/12"), (4, "http://x.com/fr/1"),
        (5, "http://x.com/de/1"), (6, "http://badorg/es/"), (7, "http://bad.net/q"), (8, "http://good.net/q"), (9, None), (9, "http://org"),
    ]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in urls], "page_id bigint, url string, host string, bound double")
    seen = [("http://bad.net/1", 1)] * 60 + [("http://good.net/1", 0)] * 60 + [("http://ok.net/", 0)] * 200 + [(None, 1), ("http://bad.net/", None)]
    outcomes = spark.createDataFrame(seen, "url string, bad int")
    got = {(r.page_id, r.host): (r.rule, r.verdict) for r in url_reputation.judge(pages, outcomes).collect()}
    assert got[1, "org"] == ("org/", "allow") and got[2, "x.example.org"] == ("example.org/es/", "block")
    assert got[3, "x.example.org"] == ("example.org/en/1", "block") and got[4, "x.com"] == ("com/fr/", "allow")
    assert got[5, "x.com"] == ("com/de/", "block") and got[6, "badorg"][0] is None
    assert got[7, "bad.net"] == (None, "block") and got[8, "good.net"] == (None, "allow")
    assert got[9, ""][0] is None and got[9, "org"][0] is None
    assert url_reputation.judge(pages.limit(0), outcomes).count() == 0
    assert url_reputation.judge(pages, outcomes.limit(0)).count() == len(urls)


def test_a_domain_lends_its_name_to_a_new_host(spark):
    pages = spark.createDataFrame([(1, "http://new.bad.net/"), (2, "http://new.good.net/")], "page_id bigint, url string")
    seen = [(f"http://{h}{i}.{d}.net/", int(d == "bad")) for h in "ab" for i in range(5) for d in ("bad", "good") for _ in range(40)]
    got = {r.page_id: r.verdict for r in url_reputation.judge(pages, spark.createDataFrame(seen, "url string, bad int")).collect()}
    assert got == {1: "block", 2: "allow"}


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_held_out_quality_and_toxicity(spark):
    root = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    for query, name, least in ((registry.op5_quality_gam, "quality", 0.97), (registry.op6_toxicity_crf, "toxic", 0.94)):
        rows = [r for r in query(spark, root).collect() if r.held_out and r.doc_id in labels]
        assert auc([(r.score, labels[r.doc_id][name]) for r in rows]) > least
        assert sum(r.predicted == labels[r.doc_id][name] for r in rows) / len(rows) > 0.95


def test_scores_do_not_see_held_out_labels(spark):
    docs, labels = (registry.table(spark, ROOT, t) for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in gam.judge(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_trained_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, 0), (7, 1, 0), (9, 0, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    for judge in (gam.judge, crf.judge):
        got = judge(hard, labels).collect()
        assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
        assert judge(hard, labels.limit(0)).count() == hard.count()
        assert judge(empty, labels).count() == 0
    model = crf.train(hard, labels)
    assert crf.drop_toxic(hard, model).columns == hard.columns


def test_spans_name_the_offending_words(spark):
    clean = "plain words of an ordinary kind stand here. "
    rows = [(i, f"{clean}Ä{i} {'slur' if i % 4 == 0 else 'calm'}{i % 3}x of {i * 7 % 11} {clean}{i}.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    for r in crf.judge(docs, labels).join(docs, "doc_id").collect():
        found = [r.text[s.start : s.end] for s in r.spans]
        assert found == ([f"slur{r.doc_id % 3}x"] if r.doc_id % 4 == 0 else []) and r.predicted == int(r.doc_id % 4 == 0)


def test_marginals_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    signal, step = rng.normal(size=9), rng.normal(size=(2, 2))
    begins = np.isin(np.arange(9), [0, 4, 5])
    got = crf.marginals(signal, begins, step)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        weight, toxic = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(signal[a + i] for i, s in enumerate(path) if s) + sum(step[x, y] for x, y in zip(path, path[1:])))
            weight += w
            toxic += w * np.array(path)
        assert np.allclose(got[a:b], toxic / weight)
