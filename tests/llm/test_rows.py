"""Operators that go by rows or groups, whatever the ids."""


def test_conversations_that_begin_alike_pair_together(spark):
    from quire.llm import preference

    # Groups of 1, 2 and 3 in each of many hash orders; a group's ids are not neighbours.
    for salt in range(8):
        begins = {1: "a", 2: "b", 3: "c", 4: "b", 5: "c", 6: "d", 7: "c", 8: "e", 9: "f", 10: "f"}
        rows = [(i, 0, "user", f"{salt}{t}") for i, t in begins.items()] + [(i, 1, "assistant", f"answer {i}") for i in begins]
        turns = preference.numbered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
        sides = {}
        for r in preference.alike(turns).collect():
            sides.setdefault(r.pair_id, {})[r.side] = r.conv_id
        pairs = sorted((p["chosen"], p["rejected"]) for p in sides.values())
        assert [p for p in pairs if begins[p[0]] == begins[p[1]]] == [(2, 4), (3, 5), (9, 10)]
        assert sorted(sides) == list(range(5)) and sorted(x for p in pairs for x in p) == list(range(1, 11))


def test_clean_rows_stay_beside_contaminated_rows_of_one_id(spark):
    from quire.llm import decontaminate

    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(None, passage), (None, "clean without an id"), (None, None), (7, passage), (7, "clean under the same id"), (8, "clean")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, row_key int")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.row_key for r in kept.collect()) == [1, 2, 4, 5]
    import corpus_pipeline

    assert ("benchmark decontamination", corpus_pipeline.drop_contaminated) in corpus_pipeline.STAGES
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    given = spark.createDataFrame([(None, item), (None, "clean without an id")], "doc_id bigint, text string")
    assert [r.text for r in corpus_pipeline.drop_contaminated(spark, given, "/root/testdata/sf0.001").collect()] == ["clean without an id"]


def test_one_row_of_near_copies_stays_whatever_their_ids(spark):
    from quire.llm import simhash_grid

    base = " ".join(f"word{i}" for i in range(400))
    near = [base + " tail", base + " other", base + " third"]
    alone = "an entirely different text about rivers and mountains and the weather of last year"
    far = " ".join(f"other{i}" for i in range(300))
    for ids, kept_id in (((None, None, None), None), ((4, 4, 4), 4), ((None, 5, 9), 5)):
        rows = [*zip(ids, near), (None, alone), (4, far)]
        docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, row int")
        assert simhash_grid.near_groups(docs, "row").filter("row < 3").select("component_id").distinct().count() == 1
        kept = simhash_grid.keep_one(docs)
        got = sorted((r.row, r.doc_id) for r in kept.collect())
        assert kept.columns == docs.columns and [r for r, _ in got if r > 2] == [3, 4]
        assert len(got) == 3 and got[0][1] == kept_id
