"""The jobs end to end on a small catalog and collection."""

import json

from pyspark.sql import functions as F

from quire import jobs
from quire.operators import interchange as ix, predicates as p, stacks
from quire.sources import catalog_files

from .test_sources import LADDER, printing

OTHER = [
    printing(id="b0", oracle_id="o2", name="Beta", set="bbb", set_name="B, too", collector_number="10", finishes=["foil"], artist="Ann"),
    printing(id="b1", oracle_id="o2", name="Beta", set="bbb", set_name="B, too", collector_number="9", lang="ph", released_at="2018-01-01"),
]


def test_ingest_and_export(spark, tmp_path):
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "f.jsonl").write_text("\n".join(map(json.dumps, LADDER + OTHER)))
    prints, cards, report = jobs.ingest_catalog(spark, str(tmp_path / "bulk"), 8)
    assert report.first().outcome == "synced" and report.first().cards == 2
    root = str(tmp_path / "out")
    arts = [r.illustration_id for r in prints.select("illustration_id").distinct().collect() if r.illustration_id]
    store = spark.createDataFrame([(a, [1, 2, 3, 4]) for a in arts[:1]], "artwork string, hashes array<bigint>")
    made = jobs.export_catalog(prints, cards, root, "v1", store, "h")
    artwork, _ = catalog_files.read_artwork(spark, f"{root}/prints", "h")
    assert artwork.count() == made["prints"]["artwork"]["fronts"] == len(arts)
    assert artwork.filter("present").count() == len(arts[:1])
    rows = catalog_files.read_catalog(spark, f"{root}/prints", made["prints"]["fields"]).orderBy("seq").collect()
    assert [r.id for r in rows] == ["b0", "b1", "a0", "a1", "a2", "a3", "a4", "a5", "a6"]
    assert rows[0].artist == "Ann" and rows[2].artist is None
    heads = {r.name: r.first_print for r in catalog_files.read_catalog(spark, f"{root}/cards", made["cards"]["fields"]).collect()}
    assert heads == {"Beta": 0, "Card": 2}


def test_find(spark):
    cards = spark.createDataFrame([(i, n, 0, float(i), 3 - i) for i, n in enumerate(["Ring", "Sol Ring", "Boring"])], "id int, name string, kind int, score double, printings int")
    prints = spark.createDataFrame([(0, "lea"), (1, "lea"), (2, "m10")], "id int, set_code string")
    ids = lambda **kw: [r.id for r in jobs.find_cards(cards, prints, **kw).collect()]
    assert ids(text="ring") == [0, 1, 2]
    assert ids(text="ring", pred=~p.in_set("lea")) == [2]
    assert ids(order="printings") == [0, 1, 2] and ids(order="printings", reverse=True) == [2, 1, 0]
    assert ids(limit=2) == [2, 0]


FILE = """Scryfall ID,Name,Set code,Collector number,Finish,Quantity,Condition,Container,Proxy,Tags,Note,Price,Price currency,Market value,Market value currency,Acquired,Added,Updated
{a},Card,AAA,1,nonfoil,2,,,,,"a, b",1.50,eur,,,2024-01-01,2024-01-01,
{a},Card,AAA,1,nonfoil,3,,,,,"a, b",2,eur,,,2023-01-01,2023-01-01,
{b},Beta,BBB,10,nonfoil,1,,,,,,,,,,,,
{b},Beta,BBB,10,foil,4,,,true,,,,,,,,,
"""


def test_import_and_export(spark, tmp_path):
    a, b = "0" * 8 + "-0000-0000-0000-" + "0" * 11 + "a", "0" * 8 + "-0000-0000-0000-" + "0" * 11 + "b"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text(FILE.format(a=a, b=b))
    known = spark.createDataFrame([(a, "aaa", "1", ["nonfoil"], 1), (b, "bbb", "10", ["foil"], 2)], "id string, set_code string, collector_number string, finishes array<string>, seq int")
    rows, skipped = jobs.read_import(spark, str(tmp_path / "in"), ix.OWN, "2026-01-01T00:00:00.000Z", known)
    assert [(r.line, r.reason) for r in skipped.collect()] == [(4, "BBB 10 is foil only, not nonfoil")]
    made = jobs.import_stacks(rows)
    got = {r.printing: r for r in made.collect()}
    assert got[a].quantity == 5 and [x.price for x in got[a].lots] == ["2", "1.50"] and got[a].created.startswith("2023")
    receipt = jobs.import_receipt(made, "file", "2026-01-01").first()
    assert (receipt.cards, receipt.stacks) == (9, 2)
    again = jobs.import_receipt(jobs.import_stacks(rows.repartition(3)), "file", "2027-01-01").first()
    assert receipt.digest == again.digest

    facts = spark.createDataFrame([(b, "Beta", "bbb", "B, too", "10", "rare", "ph")], "printing string, name string, set_code string, set_name string, collector_number string, rarity string, lang string")
    held = made.withColumn("container", F.lit(None).cast("string"))
    losses = jobs.export_collection(held, facts, str(tmp_path / "out"), ix.VENDOR, english=True).first()
    assert (losses.unnamed, losses.refused, losses.dropped) == (5, 4, "note,price,currency,acquiredAt,updatedAt".replace(",updatedAt", ""))
    text = "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert text[0].startswith("Name,Set code") and len(text) == 4
    assert text[1].split(",")[:2] == ["Beta", "BBB"] and '"B, too"' in text[1] and ",en," in text[1]
    assert [line.split(",")[6] for line in text[2:]] in (["3", "2"], ["2", "3"])

    plan = stacks.reconcile(made.withColumn("at", F.monotonically_increasing_id()), held.limit(0).select("identity", "quantity", F.lit("x").alias("held_id"), F.lit(1).alias("at")), "identity", "at")
    assert {(r.held_id, r.after) for r in plan.collect()} == {(None, 5), (None, 4)}
    assert jobs.held_apart(rows, made, 1).first().apart == 2


def test_scan_table(spark):
    import numpy as np

    r = np.random.default_rng(1)
    planes = [np.kron(r.integers(0, 256, (10, 8)), np.ones((6, 6), int)).astype(np.uint8) for _ in range(3)]
    frames = spark.createDataFrame([(f"f{i}", 48, 60, 48, bytearray(x.tobytes())) for i, x in enumerate(planes)], "id string, width int, height int, stride int, luma binary")
    from quire.sources import images

    index = images.hash_frames(frames, (0.0, 0.03, 0.06, 0.09)).select(F.substring("id", 2, 1).cast("int").alias("artwork"), "hashes")
    prints = spark.createDataFrame([(0, "p0", ["foil"], 1), (1, "p1", ["foil", "nonfoil"], 2), (1, "p2", ["foil"], 3)], "artwork int, id string, finishes array<string>, seq int")
    got = {r.query_id: r for r in jobs.scan_table(frames, index, prints).collect()}
    assert (got["f0"].chosen, got["f0"].finish, got["f0"].sure) == ("p0", "foil", True)
    assert (got["f1"].chosen, got["f1"].finish, got["f1"].sure) == ("p1", "nonfoil", False)
