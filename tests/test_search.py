import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from quire.functions import clip, costs, text as tx
from quire.operators import find, fulltext, inverted, passages, predicates as p, similarity
from quire.sources import images


def plain(text):
    text = regex.sub(r"\p{Diacritic}", "", unicodedata.normalize("NFD", text)).lower()
    return regex.sub(r"[^\p{L}\p{N}]+", " ", re.sub("['’]", "", text)).strip()


NAMES = ["Jötun Grunt", "Urza's Tower", "Fire // Ice", "Ærathi 9-Ball", "각시 가", "آدم ؤ", "  a^b`c  ", "Ｆｕｌｌ İstanbul", "naïve—café’s", "ŁódźŒ", "শো"]


def test_normalize_is_exact(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert [r.p for r in df.select(tx.normalize_text(F.col("n")).alias("p")).collect()] == [plain(n) for n in NAMES]


def test_natural_order(spark):
    want = ["a", "9", "10", "329", "329★", "0330", "1000"]
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert [r.n for r in df.orderBy(tx.natural_key(F.col("n"))).collect()] == ["9", "10", "329", "329★", "0330", "1000", "a"]


CARDS = "id string, name string, type_line string, cmc double, colors int, color_identity int, mana_cost string, stats string, card_flags array<string>, faces array<struct<colors:int,mana_cost:string,stats:string>>"
HELD = [
    ("bolt", "Bolt", "Instant", 1.0, 8, 8, "{R}", None, ["reserved"], None),
    ("goyf", "Goyf", "Creature", 2.0, 16, 16, "{1}{G}", "*/1+*", [], None),
    ("bear", "Bear", "Creature — Bear", 2.0, 16, 16, "{1}{G}", "2/2", [], None),
    ("ufo", "Ufo", "Artifact Creature", 4.0, 0, 0, "{4}", "4/", [], None),
    ("dfc", "Dfc", "Planeswalker", 3.0, None, 3, None, None, [], [(1, "{2}{W}", "3/1"), (2, "", None)]),
    ("gold", "Gold", None, None, 3, 3, "{W}{U}{U}", "1/5", [], None),
]
PRINTS = "id string, seq int, set_code string, set_type string, rarity string, lang string, released_at string, finishes array<string>, print_flags array<string>, collector_number string"
RUNS = [
    ("bolt", 1, "lea", "core", "common", "en", "1993-08-05", ["nonfoil"], [], "1"),
    ("bolt", 2, "m10", "core", "rare", "en", "2009-07-17", ["nonfoil", "foil"], ["fullArt"], "2"),
    ("goyf", 3, "fut", "expansion", "bonus", "ja", "2007-05-04", ["foil"], [], "3"),
    ("bear", 4, "lea", "core", "uncommon", "en", "1993-08-05", ["nonfoil"], [], "4"),
]


def ask(spark, pred):
    cards, prints = spark.createDataFrame(HELD, CARDS), spark.createDataFrame(RUNS, PRINTS)
    return {r.id for r in find.match_cards(cards, prints, pred, "id").collect()}


def test_predicates(spark):
    face = lambda name: F.transform("faces", lambda f: f[name])
    every = {h[0] for h in HELD}
    cases = {
        "r": (p.color_is(":", "r"), {"bolt"}),
        "no colour known": (p.color_is("=", "c"), {"ufo"}),
        "faces": (p.color_is(":", "w", faces=face("colors")), {"dfc", "gold"}),
        "guild": (p.color_is(">=", "azorius"), {"gold"}),
        "proper subset": (p.color_is("<", "wu", faces=face("colors")), {"ufo", "dfc"}),
        "two": (p.color_is("=", 2), {"gold"}),
        "multi": (p.identity_is(":", "m"), {"dfc", "gold"}),
        "not a colour": (p.color_is(":", "xyz"), set()),
        "type": (p.type_has("créature"), {"goyf", "bear", "ufo"}),
        "not type": (~p.type_has("creature"), {"bolt", "dfc", "gold"}),
        "mv": (p.mana_value("<", 2), {"bolt"}),
        "mv unread": (~p.mana_value("=", "x"), every),
        "cost": (p.mana_cost(">", "g"), {"goyf", "bear"}),
        "cost equal": (p.mana_cost("=", "uwu"), {"gold"}),
        "cost face": (p.mana_cost(":", "{W}", faces=face("mana_cost")), {"gold", "dfc"}),
        "cost inside": (p.mana_cost("<=", "3g"), {"goyf", "bear"}),
        "pow": (p.power(">", "tou"), {"ufo"}),
        "pow face": (p.power(">=", 3, faces=face("stats")), {"ufo", "dfc"}),
        "unread power": (~p.power(">=", 0), {"bolt", "goyf", "dfc"}),
        "same print": (p.in_set("lea") & p.rarity("=", "rare"), set()),
        "not in lea": (~p.in_set("LEA"), {"bolt", "goyf"}),
        "unlisted": (p.rarity("=", "special"), {"goyf"}),
        "below": (p.rarity("<=", "common"), {"bolt", "goyf"}),
        "ever": (p.ever_printed("lea") & p.rarity("=", "rare"), {"bolt"}),
        "paper": (p.ever_printed("paper"), {"bolt", "goyf", "bear"}),
        "foil": (p.flag_is("FOIL"), {"bolt", "goyf"}),
        "flag": (p.flag_is("fullart") | p.flag_is("reserved"), {"bolt"}),
        "year": (p.year("<", 2000), {"bolt", "bear"}),
        "kind": (p.set_kind("Expansion"), {"goyf"}),
        "mixed": (p.year(">", 2000) & p.color_is(":", "g"), {"goyf"}),
    }
    for name, (pred, want) in cases.items():
        assert ask(spark, pred) == want, name


def test_answering_print(spark):
    prints = spark.createDataFrame(RUNS, PRINTS)
    got = {r.id: r.answer for r in find.answering_print(prints, p.rarity("=", "rare"), "id", ["seq"], "seq").collect()}
    assert got == {"bolt": 2, "goyf": 3, "bear": 4}


def test_rank_names(spark):
    rows = [(1, "Ring", 0, 5.0), (2, "Sol Ring", 0, 1.0), (3, "Boring", 0, 0.5), (4, "Ringleader", 1, 0.1), (5, "Ring Token", 1, 0.2), (6, "Sword", 0, 0.0)]
    df = spark.createDataFrame(rows, "id int, name string, kind int, score double")
    assert [r.id for r in find.rank_names(df, "RÏNG!", "name", "kind", "score", "id").collect()] == [1, 2, 4, 5, 3]
    assert find.rank_names(df, "  '", "name", "kind", "score", "id").count() == 0


@pytest.mark.parametrize("cost, want", [("{2}{W}{2}", {"generic": 4.0, "W": 1.0}), ("3wU", {"generic": 3.0, "W": 1.0, "U": 1.0}), ("{W/U}", {"W/U": 1.0}), ("", {})])
def test_symbols(spark, cost, want):
    got = spark.createDataFrame([(cost,)], "c string").select(costs.cost_symbols(F.col("c")).alias("m")).first().m
    assert got == want == costs.literal_symbols(cost)


def test_clip_keeps_clusters(spark):
    texts = ["é" * 10, "á" * 10, "👩‍👩‍👧" * 3, "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(clip.clip_text(F.col("t"), 7).alias("c")).collect()] == ["é" * 3, "á" * 2, "", "plain", None]
    assert [r.c for r in df.select(clip.clip_text(F.col("t"), 100, 2).alias("c")).collect()] == ["éé", "á" * 2, "👩‍👩‍👧" * 2, "pl", None]


def test_tags_are_clipped_whole_and_distinct(spark):
    from quire.functions import values as v

    listed = " signed ,," + "é" * 40 + "," + "👩‍👩‍👧" * 4 + "," + ",".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([("yes", listed)], "s string, l string")
    got = df.select(v.tags_of({"signed": F.col("s"), "altered": F.lit("no")}, F.col("l")).alias("t")).first().t
    assert got[:3] == ["signed", "é" * 32, "👩‍👩‍👧" * 3] and len(got) == 32


def test_nearest_over_many_blocks(spark, monkeypatch):
    import random

    r = random.Random(9)
    word = lambda: r.getrandbits(64) - (1 << 63)
    hot = [word(), word()]
    index = [(i, hot if i % 3 == 0 else [word(), word()]) for i in range(120)] + [(500, None)]
    queries = [(q, hot if q % 3 == 0 else [word(), word(), word()][: 2 + q % 2]) for q in range(20)]
    monkeypatch.setattr(similarity, "INDEX_BLOCK", 17)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 4)
    got = similarity.nearest(
        spark.createDataFrame(queries, "query_id int, hashes array<bigint>"), spark.createDataFrame(index, "artwork int, hashes array<bigint>")
    ).collect()
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for q, asked in queries:
        want = sorted((min(bits(a, b) for a in asked for b in held), i) for i, held in index if held)[:5]
        assert sorted((x.place, x.distance, x.artwork) for x in got if x.query_id == q) == [(k, d, i) for k, (d, i) in enumerate(want, 1)]


def test_repeats_within(spark):
    run = "one two three four five six seven eight nine"
    docs = [(1, f"start {run} end"), (2, f"other {run}, `code` more words here"), (3, "nothing the same at all in this one text"), (4, f"{run} and {run}")]
    df = spark.createDataFrame(docs, "k int, t string")
    got = sorted(map(tuple, passages.repeated_within(df, "k", "t").collect()))
    assert got == [(2, 1, 1, 10), (4, 1, 0, 9), (4, 1, 10, 19)]


def test_fulltext_phrases(spark):
    docs = [(1, "The Ur-Dragon rises"), (2, "ur dragons"), (3, "dragon ur"), (4, "urn dragon")]
    df = spark.createDataFrame(docs, "k int, t string")
    assert {r.k for r in fulltext.search_text(df, "k", "t", "Ur-Drag").collect()} == {1, 2}
    assert {r.k for r in fulltext.search_text(df, "k", "t", "ur drag").collect()} == {1, 2, 3, 4}
    assert fulltext.search_text(df, "k", "t", " ").count() == 0


def test_hashes_behave():
    import numpy as np

    # A picture with something at every frequency; a separable one has ties.
    coarse = np.random.default_rng(3).integers(0, 256, (12, 10))
    plane = np.kron(coarse, np.ones((8, 8), int)).astype(np.uint8)
    blur = ((plane.astype(int) + np.roll(plane, 1, 0) + np.roll(plane, 1, 1)) // 3).astype(np.uint8)
    apart = lambda a, b: (a ^ b).bit_count()
    one = images.perceptual_hash(plane)
    assert apart(one, images.perceptual_hash(blur)) <= 8
    assert apart(one, images.perceptual_hash(plane[::-1])) > 16
    assert one < 1 << 63 and images.gradient_hash(plane) < 1 << 64
    assert images.gradient_energy(plane) > images.gradient_energy(np.full((96, 80), 7, np.uint8)) == 0.0
    assert images.fingerprint((0.0, 0.03, 0.06, 0.09)) != images.fingerprint((0.0, 0.03, 0.06, 0.1))


def test_true_ranks_count_the_whole_index(spark, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(similarity, "INDEX_BLOCK", 16)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 8)
    words = [[draw.getrandbits(63) for _ in range(2)] for _ in range(30)]
    rows = [(i, draw.choice(words), kind) for kind in ("a", "b") for i in range(60)] + [(99, None, "a"), (98, words[0], None)]
    index = spark.createDataFrame(rows, "artwork bigint, hashes array<bigint>, kind string")
    asks = [(f"{kind}{i}", [w ^ draw.getrandbits(20) for w in draw.choice(words)], i, kind) for kind in ("a", "b") for i in range(0, 60, 3)]
    asks += [("none", words[1], 1000, "a"), ("null", None, 1, "a"), ("unheld", words[1], 99, "a")]
    queries = spark.createDataFrame(asks, "query_id string, hashes array<bigint>, truth bigint, kind string")
    got = {r.query_id: (r.distance, r.rank, r.margin) for r in similarity.true_ranks(queries, index, "truth", within="kind").collect()}
    want = {}
    for name, ask, truth, kind in asks[:-3]:
        apart = {i: min((x ^ y).bit_count() for x in ask for y in held) for i, held, k in rows if k == kind and held}
        others = [d for i, d in apart.items() if i != truth]
        want[name] = (apart[truth], 1 + sum(d < apart[truth] for d in others), min(others) - apart[truth])
    assert got == want
    alone = similarity.true_ranks(queries.filter("query_id = 'a0'"), index.filter("kind = 'a' AND artwork = 0"), "truth", within="kind").collect()
    assert [(r.rank, r.margin) for r in alone] == [(1, None)]


def test_true_ranks_of_several_kinds_at_once(spark, monkeypatch):
    draw = random.Random(10)
    monkeypatch.setattr(similarity, "INDEX_BLOCK", 4)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 1)
    words = [[draw.getrandbits(63) - (i % 2 << 63) for _ in range(1 + (i % 5 > 0))] for i in range(25)]
    rows = [(i, words[i] if i < 25 else draw.choice(words)) for i in range(50)] + [(60, None)]
    index = spark.createDataFrame(rows, "artwork bigint, hashes array<bigint>")
    asks = [(f"q{i}", [w ^ draw.getrandbits(draw.choice([1, 25, 60])) for w in held], i) for i, held in rows if held] + [("same", words[3], 3), ("none", words[1], 99), ("null", None, 1), ("unheld", words[1], 60)]
    queries = spark.createDataFrame(asks, "query_id string, hashes array<bigint>, truth bigint")
    kinds = {"plain": (1, 1), "levels": (1, 2), "asked": (2, 2)}
    found = similarity.true_ranks(queries, index, "truth", kinds=kinds)
    assert found.columns == ["query_id", "kind", "distance", "rank", "margin"]
    got = {(r.query_id, r.kind): (r.distance, r.rank, r.margin) for r in found.collect()}
    want = {}
    for name, ask, truth in asks[:-3]:
        for kind, (a, h) in kinds.items():
            apart = {i: min(((x ^ y) & (1 << 64) - 1).bit_count() for x in ask[:a] for y in held[:h]) for i, held in rows if held}
            others = [d for i, d in apart.items() if i != truth]
            want[name, kind] = (apart[truth], 1 + sum(d < apart[truth] for d in others), min(others) - apart[truth])
    assert got == want
    assert any(r > 1 for _, r, _ in want.values()) and any(m == 0 for _, _, m in want.values())
    assert similarity.true_ranks(queries, index.limit(0), "truth", kinds=kinds).count() == 0


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(9)
    words = ["Ur-Dragon", "ur", "dragons", "Élan", "elanwood", "the", "then", "a", "b2", "日本", "o'clock"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(25))), i % 3) for i in range(120)] + [(200, None, 0), (201, "", 1), (202, "—", 2)]
    df = spark.createDataFrame(docs, "k int, t string, kind int")
    root = str(tmp_path / "index")
    inverted.build_index(df, "k", "t", root, keep=["kind"])
    for query in ("ur", "Ur-Drag", "elan the", "the a b", "日", "ur-dragons the", "none", "the none", "", "o'clo", "a a"):
        want = {(r.k, r.kind, round(r.score, 9)) for r in fulltext.search_text(df, "k", "t", query, keep=["kind"]).collect()}
        found = inverted.search_index(spark, root, "k", query, keep=["kind"])
        assert {(r.k, r.kind, round(r.score, 9)) for r in found.collect()} == want
        assert found.columns == ["k", "kind", "score"]
    # A range of words is read, told by the files' bounds.
    places = spark.read.parquet(f"{root}/places").filter(inverted._range("ur", False))
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_word,ur)" in plan and "LessThan(_word,us)" in plan
    with pytest.raises(ValueError):
        inverted.build_index(df.withColumnRenamed("kind", "_d"), "k", "t", root + "2", keep=["_d"])
    inverted.build_index(df.limit(0), "k", "t", root + "3")
    assert inverted.search_index(spark, root + "3", "k", "ur").count() == 0


def test_an_index_keeps_each_text_s_places_in_one_file_in_order(spark, tmp_path):
    draw = random.Random(10)
    rows = [(i, " ".join(draw.choice(["the", "then", "ur", "élan", "b2"]) for _ in range(20))) for i in range(200)]
    root = str(tmp_path / "index")
    inverted.build_index(spark.createDataFrame(rows, "k int, t string").repartition(4), "k", "t", root)
    held = {}
    for path in sorted((tmp_path / "index" / "places").glob("*.parquet")):
        found = [(r._word, r.k, r._at) for r in spark.read.parquet(str(path)).coalesce(1).collect()]
        assert found == sorted(found)
        held[path.name] = {k for _, k, _ in found}
    assert len(held) > 1 and sum(map(len, held.values())) == 200 == len(set().union(*held.values()))


def test_tokens_at_the_ends_of_a_text(spark):
    texts = ["", " ", "—", "  a  b ", "-A-b.", "É1 ½x", None, "x\ny\t", " z　"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fulltext.tokens(fulltext.F.col("t"))).collect()
    assert [r[0] for r in got] == [[], [], [], ["a", "b"], ["a", "b"], ["e1", "½x"], None, ["x", "y"], ["z"]]
