"""Inputs that once lost, multiplied or misread rows."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from quire.operators import find, stacks
from quire.operators import predicates as p
from quire.operators.catalog import accept_in_order
from quire.sources.jsonl import bulk_entry, scan_json_lines
from quire.streaming import drain, edits, refresh


def test_predicates_keep_to_their_side(spark):
    cards = spark.createDataFrame([("a", "Creature", 2.0), ("b", "Land", 9.0)], "id string, type_line string, cmc double")
    prints = spark.createDataFrame([("a", "Token", 7.0, "rare"), ("b", "Creature", 2.0, "rare"), ("a", "Creature", 2.0, "common")], "id string, type_line string, cmc double, rarity string")
    both = p.type_has("creature") & p.rarity("=", "rare")
    assert [r.id for r in find.match_cards(cards, prints, both, "id").collect()] == ["a"]
    assert [r.id for r in find.match_cards(cards, prints, p.mana_value("=", 2) & p.rarity("=", "rare"), "id").collect()] == ["a"]
    assert {r.id for r in find.match_cards(cards, prints, ~p.type_has("creature") | p.rarity("=", "common"), "id").collect()} == {"a", "b"}
    assert find.match_prints(cards.withColumnRenamed("type_line", "of"), prints, p.rarity("=", "rare") & p.text_has("land", "of"), "id", "of").count() == 1


def test_json_of_another_kind_is_refused(spark, tmp_path):
    lines = ['{"id":"x","n":1}', '{"id":5}', '{"id":{"x":1}}', '{"id":"y"} trailing', '{"id":"a"}{"id":"b"}', '{"id":"a"},{"id":"b"}', '{"id":null,"n":2}', '{"id":"z","tags":["t"]}', '{"id":"z","tags":"t"}', '{"id":"w","n":"1"}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\n")
    schema = T.StructType.fromDDL("id string, n bigint, tags array<string>")
    good, bad = scan_json_lines(spark, str(tmp_path), schema)
    assert sorted(r.line for r in good.collect()) == [1, 7, 8]
    assert sorted(r.line for r in bad.collect()) == [2, 3, 4, 5, 6, 9, 10]


def test_first_entry_in_file_order(spark):
    index = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "type string, n int").coalesce(1)
    assert bulk_entry(index, "k").first().n == 1


def test_a_null_key_claims_nothing(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "c", "x"), (5, "c", None), (6, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "n int, k string, j string")
    assert {r.n for r in accept_in_order(df, ["n"], [["k"], ["j"]]).collect()} == {1, 3, 5, 6, 7}


def test_replaying_a_batch_keeps_the_version(spark, tmp_path):
    root, land, check = (str(tmp_path / x) for x in ("root", "land", "check"))
    spark.range(5).write.parquet(str(tmp_path / "data"))
    refresh.notify(spark, land, "cards", "v1", str(tmp_path / "data"), 1)

    def ingest(data, before):
        return data, {"outcome": "synced", "written": data.count(), "skipped": 0}

    refresh.refresh_stream(spark, land, root, check, ingest)
    refresh.refresh_stream(spark, land, root, str(tmp_path / "again"), ingest)  # no commit kept: batch 0 once more
    assert refresh.published(spark, root, "cards").count() == 5


def test_orders_that_tie(spark):
    rows = spark.createDataFrame([("i", 1, 80), ("i", 1, 70)], "identity string, at bigint, quantity bigint")
    with pytest.raises(ValueError):
        stacks.assign_bins(rows, "identity", "at", F.col("quantity"), F.lit(0), copies=100).collect()
    held = spark.createDataFrame([("i", "a", 5, 1), ("i", "b", 6, 1)], "identity string, held_id string, quantity bigint, at bigint")
    got = spark.createDataFrame([("i", 1, 3)], "identity string, at bigint, quantity bigint")
    steps = stacks.reconcile(got, held, "identity", "at").collect()
    assert [(r.held_id, r.before, r.after) for r in steps] == [("a", 5, 8)]


def part(key, *entries):
    return (key, "d", [(i, identity, n, 1) for i, (identity, n) in enumerate(entries)])


def test_parts_land_whole_and_copies_do_not_multiply(spark, tmp_path):
    root = str(tmp_path)
    for number, parts in enumerate(([part("p", ("i", 80), ("i", 70))], [part("q", ("i", 10)), part("p", ("i", 80), ("i", 70))])):
        drain.drain_batch(spark, root, spark.createDataFrame(parts, drain.PART), number, copies=100)
    held = drain.collection(spark, root).collect()
    assert sum(r.quantity for r in held) == 160 and max(r.quantity for r in held) <= 100


def test_lots_bind_too(spark):
    held = spark.createDataFrame([("i", "a", 1, 2, 1), ("i", "b", 1, 0, 2)], "identity string, held_id string, quantity bigint, lots bigint, at bigint")
    new = spark.createDataFrame([("i", 1, 1, 2), ("i", 2, 1, 1)], "identity string, at bigint, quantity bigint, lots bigint")
    steps = {r.held_id: (r.after, r.lots_after) for r in stacks.reconcile(new, held, "identity", "at", lots="lots", max_lots=3).collect()}
    assert steps == {"a": (2, 3), "b": (2, 2)}
    laid = stacks.landing(held, new, "identity", "at", lots="lots", max_lots=3).collect()
    assert sorted((r.held_id or "", r.written, r.waiting) for r in laid) == [("", 0, 1), ("a", 1, 1), ("b", 1, 0)]


def test_two_edits_of_one_record(spark):
    held = spark.createDataFrame([("u", "i", 5, 1), ("v", "j", 4, 2)], "uri string, identity string, quantity bigint, at bigint")
    log = spark.createDataFrame([("u", None, 7, 1), ("u", None, 9, 2), ("v", "i", None, 1), ("v", None, 2, 3)], "uri string, identity string, quantity bigint, seq bigint")
    got = {r.uri: (r.identity, r.quantity, r.merged) for r in edits.amend_stacks(held, log, copies=10).collect()}
    assert got == {"u": ("i", 9, 1), "v": ("i", 2, 1)}


def test_a_finish_nobody_makes(spark):
    entries = spark.createDataFrame([("e", 1, "foil", "", False)], "entry string, quantity bigint, finish string, condition string, dropped boolean")
    log = spark.createDataFrame([("e", 1, "refinish", "etched"), ("e", 2, "refinish", "golden")], edits.EDIT)
    assert edits.fold_edits(entries, log).first().finish == "etched"


def test_index_line_of_any_length_reads_back(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"object": "list", "has_more": False, "data": [{"id": "1", "type": "k", "name": "n", "updated_at": "u", "jsonl_download_uri": "x", "compressed_size": 1}]}))
    from quire.sources.jsonl import bulk_index

    assert bulk_entry(bulk_index(spark, str(tmp_path / "i.json")), "k").count() == 1
