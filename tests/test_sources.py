import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators import catalog, interchange as ix
from quire.sources import catalog_files, csv_lined, jsonl


def lined(text):
    """Records as a character-by-character reading gives them."""
    out, row, field, quoted, line, start, begun = [], [], "", False, 1, 1, False
    text = text.removeprefix("﻿")
    at = 0
    while at < len(text):
        ch = text[at]
        if not begun:
            start, begun = line, True
        if quoted:
            if ch != '"':
                if ch == "\n" or (ch == "\r" and text[at + 1 : at + 2] != "\n"):
                    line += 1
                field += ch
            elif text[at + 1 : at + 2] == '"':
                field += '"'
                at += 1
            else:
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == ",":
            row.append(field)
            field = ""
        elif ch in "\r\n":
            if ch == "\r" and text[at + 1 : at + 2] == "\n":
                at += 1
            out.append((start, [*row, field]))
            row, field, begun = [], "", False
            line += 1
        else:
            field += ch
        at += 1
    if field or row:
        out.append((start, [*row, field]))
    return out


TEXTS = [
    'a,b\n1,"x,y"\n"say ""hi""",2\n',
    'a,b\r\n"two\r\nlines",1\r\n\r\nlast,2',
    "a,b\r1,2\r\r3,4\r",
    '﻿Name,Foil\n"q""",ab"c,d"e\n,,\n""\n',
    'a\n"one\n\n\ntwo",x\nshort\nlong,1,2,3\n',
    '"a""b""",""""\n"" ,"x"\n',
    'a,"' + 'long ""field"", ' * 20000 + '"\n' + "plain " * 20000 + ",b\n",
    'a,"never closed\n1,2\n',
]


@pytest.mark.parametrize("at", range(len(TEXTS)))
@pytest.mark.parametrize("hot", [1, 10**6])
def test_csv_lines(spark, tmp_path, at, hot):
    (tmp_path / "f.csv").write_bytes(TEXTS[at].encode())
    got = csv_lined.scan_csv_lined(spark, str(tmp_path), hot_rows=hot).orderBy("line").collect()
    assert [(r.line, r.fields) for r in got] == lined(TEXTS[at])


def test_csv_writes_what_it_reads(spark, tmp_path):
    rows = [(2, "2", "two\nlines", ""), (1, "1", 'a "b"', "x,y"), (3, "3", " spaced ", None)]
    df = spark.createDataFrame(rows, "at int, k string, a string, b string")
    for parts in (1, 3):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1))
        out = tmp_path / f"out{parts}"
        csv_lined.write_csv(df, str(out), ["K", "A", "B"], "at")
        texts = [p.read_text() for p in sorted(out.glob("part-*")) if p.stat().st_size]
        assert all(t.startswith("K,A,B\n") for t in texts) and (len(texts) > 1) == (parts > 1)
        assert "".join(t.removeprefix("K,A,B\n") for t in texts) == '1,"a ""b""","x,y"\n2,"two\nlines",\n3, spaced ,\n'
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    csv_lined.write_csv(df.limit(0), str(tmp_path / "none"), ["K", "A", "B"], "at")
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == "K,A,B\n"


def test_rows_are_judged_in_order(spark, tmp_path):
    head = "Name,SET_CODE,Collector number,Foil,Quantity,Scryfall ID,Condition,Added,Altered,Misprint,Purchase price,Purchase price currency\n"
    uid = "0000419b-0bba-4488-8f7a-6194544ce91e"
    body = [
        f"ok,lea,1,,2,{uid.upper()},near_mint,2024-01-02,true,,1.5,eur",
        "no,lea,1,foil,2,,,,,,,",
        "bad,lea,1,foil,2,xyz,,,,,,",
        f"fin,lea,1,gilded,2,{uid},,,,,,",
        f"n0,lea,1,foil,0,{uid},,,,,,",
        f"n15,lea,1,foil,1.5,{uid},,,,,,",
        f"big,lea,1,etched,10001,{uid},,,,,,",
        "short,lea",
        f"when,lea,2,normal,1,{uid},,12,,,2,",
    ]
    (tmp_path / "f.csv").write_text(head + "\n".join(body) + "\n")
    records = csv_lined.scan_csv_lined(spark, str(tmp_path))
    heads = csv_lined.header_of(records)
    assert heads.select(ix.detect_format(heads["head"]).alias("f")).first().f == "vendor"
    judged = ix.judge_rows(ix.bind_columns(records, heads, ix.VENDOR), ix.VENDOR)
    reasons = {r.line: r.reason for r in judged.collect()}
    assert reasons == {
        2: None, 3: "no print", 4: "no such print xyz", 5: "unknown finish gilded", 6: "0 is not a count",
        7: "1.5 is not a count", 8: "10001 is not a count", 10: None,
    }
    made = {r.line: r for r in ix.stacks_of(judged.filter("reason is null"), "now").collect()}
    assert (made[2].printing, made[2].finish, made[2].condition, made[2].tags) == (uid, "nonfoil", "nearMint", ["altered"])
    assert made[2].lots[0].marketCurrency == "EUR" and made[2].created == "2024-01-02T00:00:00.000Z"
    assert made[10].lots is None and made[10].created == "now"


def test_spent_lots(spark):
    lots = "array<struct<quantity:double,at:string,price:string,currency:string,marketValue:string,marketCurrency:string>>"
    rows = [("a", 3, [(2.0, None, "1", "EUR", None, None), (0.5, None, "9", "EUR", None, None), (4.0, None, "2", "EUR", None, None), (1.0, None, "3", "EUR", None, None)]),
            ("b", 5, [(2.9, "2024-01-01", None, None, None, None)]), ("c", 2, None)]
    got = ix.spend_stack_lots(spark.createDataFrame(rows, f"k string, quantity int, lots {lots}"), ix.OWN).collect()
    assert {(r.k, r["take"], r.lot.price if r.lot else None, r.unspent) for r in got} == {
        ("a", 2, "1", 1), ("a", 1, "2", 1), ("b", 2, None, 0), ("b", 3, None, 0), ("c", 2, None, 0),
    }


def printing(**more):
    base = dict(
        id="p1", oracle_id="o1", name="Card", lang="en", released_at="2020-01-01", layout="normal", set="aaa", set_name="A", set_type="expansion",
        collector_number="1", rarity="rare", cmc=2.0, type_line="Creature", colors=["W"], color_identity=["W"], legalities={"x": "legal"}, games=["paper"],
        finishes=["nonfoil"], digital=False, promo=False, reprint=False, variation=False, oversized=False, booster=True, full_art=False, textless=False,
        reserved=False, border_color="black", frame="2015", image_status="highres_scan", illustration_id="i1",
    )
    return {**base, **more}


def scan(spark, tmp_path, lines, members=1):
    data = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines).encode()
    cut = len(data) // members
    packed = b"".join(gzip.compress(data[i * cut : (i + 1) * cut if i < members - 1 else None]) for i in range(members))
    (tmp_path / "bulk.jsonl.gz").write_bytes(packed)
    return jsonl.scan_json_lines(spark, str(tmp_path), catalog.RAW_SCHEMA, catalog.REQUIRED, catalog.color_checks())


def test_json_lines(spark, tmp_path):
    short = printing(id="p3")
    del short["rarity"]
    lines = [printing(), "", "{broken", short, printing(id="p5", collector_number="5", colors=["Z"]), printing(id="p6", cmc="two"), "   ", printing(id="p8", collector_number="8")]
    good, rejects = scan(spark, tmp_path, lines, members=2)
    assert {(r.line, r.id) for r in good.collect()} == {(1, "p1"), (8, "p8")}
    assert {r.line: r.reason for r in rejects.collect()} == {
        3: "not a record of this shape", 4: "no rarity", 5: "unknown colour in colors", 6: "not a record of this shape",
    }


def test_a_long_line_fails_the_read(spark, tmp_path):
    good, _ = scan(spark, tmp_path, [printing(), printing(name="x" * (1 << 20))])
    with pytest.raises(PySparkException):
        good.collect()


LADDER = [
    printing(id="a0"),
    printing(id="a1", collector_number="2"),
    printing(id="a2", collector_number="1", lang="ja", finishes=["foil"]),
    printing(id="a3", collector_number="3", released_at="2019-01-01"),
    printing(id="a4", collector_number="4", layout="reversible_card", released_at="2021-01-01"),
    printing(id="a5", collector_number="5", booster=False, released_at="2022-01-01"),
    printing(id="a6", collector_number="6", set_type="promo", released_at="2023-01-01"),
    printing(id="a7", collector_number="7", digital=True, released_at="2024-01-01", oracle_text="from afar"),
]


def test_ladder(spark, tmp_path):
    good, rejects = scan(spark, tmp_path, list(reversed(LADDER)))
    prints, cards, report = catalog.ingest(good, rejects, None)
    ordered = catalog.export_order(prints, cards).orderBy("seq").collect()
    assert [r.id for r in ordered] == ["a0", "a1", "a2", "a3", "a4", "a5", "a6"]
    card = cards.collect()[0]
    assert (card.default_print, card.printings, card.paper, card.text) == ("a0", 7, True, "from afar")
    assert report.first().outcome == "synced"
    catalog.claimed_runs(cards, prints)
    assert catalog.export_cards(cards).first().first_print == 0
    assert {r.id: r.artwork for r in catalog.export_prints(catalog.export_order(prints, cards)).collect()}["a0"] == 0


def test_refused_rows_free_their_other_key(spark, tmp_path):
    lines = [
        printing(id="x", collector_number="1"),
        printing(id="x", collector_number="2"),  # its id is taken
        printing(id="y", collector_number="2"),  # so this number is free
        printing(id="z", collector_number="1"),  # its number is taken
        printing(id="w", collector_number="9", oracle_id=None),
        printing(id="v", collector_number="10", oracle_id=None, layout="reversible_card", card_faces='[{"name":"f"},{"name":"g","oracle_id":"o9","illustration_id":"i9"}]'),
    ]
    prints, cards, report = catalog.ingest(*scan(spark, tmp_path, lines), None)
    assert {(r.id, r.collector_number, r.oracle_id) for r in prints.collect()} == {("x", "1", "o1"), ("y", "2", "o1"), ("v", "10", "o9")}
    got = report.first()
    assert (got.written, got.skipped, got.cards) == (3, 3, 2)


@pytest.mark.parametrize(
    "lines, before, outcome",
    [
        ([printing(oracle_id=None)], None, "empty"),
        ([printing()], 2, "shrunk"),
        ([{**printing(), "cmc": None}], 1, "shape"),
        ([printing()], 1, "synced"),
    ],
)
def test_gates(spark, tmp_path, lines, before, outcome):
    assert catalog.ingest(*scan(spark, tmp_path, lines), before)[2].first().outcome == outcome


def test_catalog_refuses_other_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, w string")
    root = str(tmp_path / "cat")
    one = catalog_files.write_catalog(df, root, "v", ["w"], [F.asc("k")])
    assert one == catalog_files.write_catalog(df.repartition(3), root, "v", ["w"], [F.asc("k")])
    assert sorted(map(tuple, catalog_files.read_catalog(spark, root, ["k", "w"]).collect())) == [(1, "a"), (2, "b"), (3, "a"), (4, None)]
    with pytest.raises(ValueError):
        catalog_files.read_catalog(spark, root, ["w", "k"])


def test_a_build_that_dies_leaves_the_catalog_before_it(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cat")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    two = spark.createDataFrame([(1, "c"), (2, "b"), (3, "c")], "k int, w string")
    read = lambda back=0: sorted(map(tuple, catalog_files.read_catalog(spark, root, ["k", "w"], back).collect()))
    catalog_files.write_catalog(one, root, "1", ["w"])
    files = {f.name for f in (tmp_path / "cat").iterdir()}
    put = catalog_files._put

    def dies(spark, staged, target):
        if "manifests" in target:
            raise OSError("gone")
        put(spark, staged, target)

    monkeypatch.setattr(catalog_files, "_put", dies)
    with pytest.raises(OSError):
        catalog_files.write_catalog(two, root, "2", ["w"])
    assert read() == [(1, "a"), (2, "b")] and catalog_files.read_manifest(spark, root)["version"] == "1"
    monkeypatch.undo()
    catalog_files.write_catalog(two, root, "2", ["w"])
    assert read() == [(1, "c"), (2, "b"), (3, "c")] and read(1) == [(1, "a"), (2, "b")]
    # The same once more publishes nothing new; a part that is there is not written over.
    stamp = {f: f.stat().st_mtime_ns for f in (tmp_path / "cat").rglob("*.parquet") if f.is_file()}
    catalog_files.write_catalog(two, root, "2", ["w"])
    assert catalog_files.manifests(spark, root) == [1, 2]
    assert all(f.stat().st_mtime_ns == at for f, at in stamp.items())
    # Two manifests keep their parts; past them, and once settled, parts go.
    left = [f"_staged/{f.name}" for f in (tmp_path / "cat" / "_staged").iterdir()]
    assert left and catalog_files.sweep(spark, root, 3600) == [] and catalog_files.sweep(spark, root, 0.0, keep=2) == left
    catalog_files.write_catalog(two.limit(1), root, "3", ["w"])
    gone = catalog_files.sweep(spark, root, 0.0)
    assert "manifests/00000001" in gone and {g for g in gone if "." in g} == {f for f in files if "." in f}
    assert read(1) == [(1, "c"), (2, "b"), (3, "c")]
    with pytest.raises(LookupError):
        catalog_files.read_manifest(spark, root, 2)


def test_arrays_in_a_catalog(spark, tmp_path):
    rows = [(1, ["b", "a"], ["x"], "p"), (2, [], ["y", "x"], "q"), (3, None, None, None), (4, ["a", None, "a"], [], "p")]
    df = spark.createDataFrame(rows, "k int, places array<string>, bits array<string>, whole string")
    root = str(tmp_path / "cat")
    made = catalog_files.write_catalog(df, root, "1", [], arrays={"places": "places", "bits": "mask"}, interned={"whole": ["k"]})
    got = sorted(map(tuple, catalog_files.read_catalog(spark, root, df.columns).collect()))
    assert got == [(1, ["b", "a"], ["x"], "p"), (2, [], ["x", "y"], "q"), (3, None, None, None), (4, ["a", "a"], [], "p")]
    held = {r.k: r for r in spark.read.parquet(f"{root}/{made['parts']['rows']['name']}").collect()}
    assert (held[1].places, held[1].bits, held[1].whole) == ([1, 0], 1, 0) and (held[2].bits, held[2].whole) == (3, 1)
    many = spark.createDataFrame([([str(i) for i in range(64)],)], "bits array<string>")
    with pytest.raises(ValueError):
        catalog_files.write_catalog(many, root, "2", [], arrays={"bits": "mask"})
    assert catalog_files.read_manifest(spark, root)["version"] == "1"


def test_artwork_numbers_backs_after_fronts(spark, tmp_path):
    prints = spark.createDataFrame(
        [(3, "f2", "z"), (1, "f1", "b"), (2, "f1", "b"), (4, "f2", "f1"), (5, None, "a"), (6, "f3", "f3"), (7, "f3", "a")], "seq bigint, front string, back string"
    )
    store = spark.createDataFrame([("f1", [1, 2]), ("a", [0, 0])], "artwork string, hashes array<bigint>")
    root = str(tmp_path / "cat")
    made = catalog_files.artwork_part(prints, store, root, width=2, hasher="h")
    assert {k: made[k] for k in ("rows", "fronts", "absent", "backs")} == {"rows": 6, "fronts": 3, "absent": 4, "backs": 4}
    catalog_files.write_catalog(prints, root, "v", ["front"], artwork=made)
    artwork, backs = catalog_files.read_artwork(spark, root, "h")
    rows = artwork.orderBy("number").collect()
    assert [(r.artwork, r.present) for r in rows] == [("f1", True), ("f2", False), ("f3", False), ("a", True), ("b", False), ("z", False)]
    assert rows[1].hashes == [0, 0] and sorted(map(tuple, backs.collect())) == [(0, 1), (3, 2), (4, 0), (5, 1)]
    with pytest.raises(ValueError):
        catalog_files.read_artwork(spark, root, "other")
