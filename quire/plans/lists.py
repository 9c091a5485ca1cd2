"""Lists of sets, places, entries and cards on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import jobs
from ..operators import entries as en, find, ranking
from ..session import fresh_path
from .tables import table


def narrow_sets(spark: SparkSession, root: str) -> DataFrame:
    """Brands as sets, newest first by the year their lines first shipped,
    narrowed by what they are."""
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    line = table(spark, root, "lineitem").select("l_partkey", "l_shipdate")
    sets = line.join(part, "l_partkey").groupBy(F.lower("p_brand").alias("set_code"), F.concat("p_brand", F.lit(" "), "p_type").alias("set_name"),
        F.when(F.col("p_type") == "PROMO", "duel_deck").when(F.col("p_type") == "SMALL", "draft_innovation").otherwise("core").alias("set_type")
    ).agg(F.min("l_shipdate").alias("released"), F.count(F.lit(1)).alias("printings"))
    found = find.narrow_sets(sets, " Duel deck ").unionByName(find.narrow_sets(sets, "nd#1 ec")).unionByName(find.narrow_sets(sets, "draft-innovation"))
    placed = ranking.number_dictionary(found, [F.desc("released"), F.asc("set_name")], "place")
    return placed.select("place", "set_code", "set_name", "printings")


NARROW_SETS = """
WITH s AS (SELECT lower(p_brand) AS set_code, p_brand || ' ' || p_type AS set_name, min(l_shipdate) AS released, count(*) AS printings,
  p_type IN ('PROMO', 'SMALL') OR (p_type LIKE 'EC%' AND p_brand = 'Brand#1') AS kept FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT row_number() OVER (ORDER BY released DESC, set_name) AS place, set_code, set_name, printings FROM s WHERE kept
"""


def place_contents(spark: SparkSession, root: str) -> DataFrame:
    """Lines filed under one place, by the shown name of their part; parts the
    catalog does not know show their id."""
    line = table(spark, root, "lineitem").select(
        F.col("l_partkey").cast("string").alias("printing"), "l_orderkey", "l_linenumber", "l_extendedprice",
        F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("container"),
    )
    prints = table(spark, root, "part").filter(F.col("p_type") != "PROMO").select(F.col("p_partkey").cast("string").alias("printing"), F.col("p_name").alias("name"))
    rows = find.place_contents(line, prints, "RF", "ring").unionByName(find.place_contents(line, prints, None, "7"))
    order = [F.asc("shown"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice")]
    return ranking.number_rows(rows, order, "place").select("place", "shown", "l_orderkey", "l_linenumber")


PLACE_CONTENTS = """
WITH r AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS container, coalesce(p_name, l_partkey::VARCHAR) AS shown,
  l_orderkey, l_linenumber, l_extendedprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON p_partkey = l_partkey)
SELECT row_number() OVER (ORDER BY shown, l_orderkey, l_linenumber, l_extendedprice) AS place, shown, l_orderkey, l_linenumber
FROM r WHERE (container = 'RF' AND lower(shown) LIKE '%ring%') OR (container IS NULL AND shown LIKE '%7%')
"""


def merge_entries(spark: SparkSession, root: str) -> DataFrame:
    """Orders as review lists of one customer's parts: entries of one priority
    and status join the first of them up to 300,000; cancelled ones stay out."""
    orders = table(spark, root, "orders").select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("identity"),
        F.floor("o_totalprice").cast("long").alias("quantity"), F.col("o_orderkey").alias("at"), (F.col("o_orderstatus") == "P").alias("dropped"),
    )
    return en.merge_entries(orders, "identity", "at", copies=300_000)


MERGE_ENTRIES = """
WITH RECURSIVE o AS (SELECT o_custkey || '/' || o_orderpriority AS identity, floor(o_totalprice)::BIGINT AS q, o_orderkey, o_orderstatus = 'P' AS dropped FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY o_orderkey) AS n FROM o WHERE NOT dropped),
f AS (SELECT identity, n, q, o_orderkey, q AS held, true AS took FROM l WHERE n = 1
  UNION ALL SELECT l.identity, l.n, l.q, l.o_orderkey, CASE WHEN held + l.q <= 300000 THEN held + l.q ELSE held END, held + l.q <= 300000
  FROM f JOIN l ON l.identity = f.identity AND l.n = f.n + 1)
SELECT identity, max(held)::BIGINT AS quantity, count(*) FILTER (WHERE took) AS merged, min(o_orderkey) AS "at", false AS dropped FROM f GROUP BY 1
UNION ALL SELECT identity, q, 1, o_orderkey, false FROM f WHERE NOT took
UNION ALL SELECT identity, q, 1, o_orderkey, true FROM o WHERE dropped
"""


def _catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, root, "documents")
    prints = table(spark, root, "labels").select(
        F.col("doc_id").alias("oracle_id"), F.concat(F.lit("p"), "doc_id").alias("id"), (F.col("toxic") == 1).alias("digital"), F.col("doc_id").alias("seq")
    )
    prints = prints.unionByName(prints.select("oracle_id", F.concat("id", F.lit("b")).alias("id"), F.lit(False).alias("digital"), (F.col("seq") + 1000000).alias("seq")))
    cards = docs.select(
        F.col("doc_id").alias("oracle_id"), "source", F.concat(F.lit("The "), F.col("source")).alias("name"), F.col("text").alias("names"),
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 2).otherwise(1).alias("kind"), (F.col("n_chars") > 200).alias("paper"),
        F.concat(F.lit("p"), "doc_id", F.lit("b")).alias("default_print"),
    )
    return cards, prints


def search_grouped(spark: SparkSession, root: str) -> DataFrame:
    """Documents found by two prefixes, one row each with its printing, an
    exact name first, then by kind and score; from an index of the names."""
    cards, prints = _catalog(spark, root)
    path = fresh_path(spark, "names")
    find.index_cards(cards, path)
    return find.search_cards(cards, prints, "the on", limit=40, index=path).select("oracle_id", "id", "kind", F.round("score", 6).alias("score"))


def search_ungrouped(spark: SparkSession, root: str) -> DataFrame:
    """The same with every paper printing, two kinds left out."""
    cards, prints = _catalog(spark, root)
    path = fresh_path(spark, "names")
    find.index_cards(cards, path)
    found = find.search_cards(cards, prints, "the on", grouped=False, art_series=False, limit=60, index=path)
    return found.select("oracle_id", "id", "kind", F.round("score", 6).alias("score"))


_HITS = """
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 2 ELSE 1 END AS kind, n_chars > 200 AS paper,
  list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, kind, paper, len(t) AS d, len(list_filter(t, lambda x: starts_with(x, 'the'))) AS f1,
  len(list_filter(t, lambda x: starts_with(x, 'on'))) AS f2 FROM t),
s AS (SELECT count(*) AS n, avg(d) AS a, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM c),
i AS (SELECT *, CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1,
  CASE WHEN ln((n - n2 + 0.5) / (n2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n2 + 0.5) / (n2 + 0.5)) END AS i2 FROM s),
r AS (SELECT doc_id, kind, round(0.0::DOUBLE - i1 * (f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / a)))
  - i2 * (f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / a))), 9) AS score FROM c, i WHERE f1 > 0 AND f2 > 0 AND paper)
""".replace("\\\\", "\\")

SEARCH_GROUPED = _HITS + """
SELECT r.doc_id AS oracle_id, 'p' || r.doc_id || 'b' AS id, kind, round(score, 6) AS score FROM r JOIN labels USING (doc_id)
ORDER BY kind, r.score, r.doc_id LIMIT 40
"""

SEARCH_UNGROUPED = _HITS + """,
p AS (SELECT doc_id, 'p' || doc_id AS id, doc_id AS seq FROM labels WHERE toxic <> 1 UNION ALL SELECT doc_id, 'p' || doc_id || 'b', doc_id + 1000000 FROM labels)
SELECT r.doc_id AS oracle_id, id, kind, round(score, 6) AS score FROM r JOIN p USING (doc_id) WHERE kind <> 2
ORDER BY kind, r.score, seq, r.doc_id, id LIMIT 60
"""


def review_list(spark: SparkSession, root: str) -> DataFrame:
    """Lines of files as entries of a review list, some struck off, kept as
    stacks: filed where the file says and, once more, all in one box; with the
    count of kept entries a holder of the returned ones owns already."""
    line = table(spark, root, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    finish = F.when(F.col("l_linestatus") == "F", "foil").otherwise("nonfoil")
    rows = line.withColumn("line", F.row_number().over(w)).select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("line").cast("string")).alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created"),
        F.col("l_partkey").cast("string").alias("printing"), finish.alias("finish"), F.col("l_quantity").cast("long").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "good").alias("condition"), F.when(F.col("l_discount") > 0.05, F.array(F.lit("cheap"))).alias("tags"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit("noted")).alias("note"), (F.col("l_suppkey") % 5 == 0).alias("proxy"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("shelf")).alias("container"),
    )
    entries = en.review_rows(rows).withColumn("dropped", F.col("quantity") > 45)
    own = en.entry_stacks(entries).withColumn("how", F.lit("own"))
    boxed = en.entry_stacks(entries.filter("quantity < 3"), "box").withColumn("how", F.lit("boxed"))
    held = line.filter("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("printing"), finish.alias("finish"))
    apart = jobs.held_apart(own, held, 100)
    out = own.unionByName(boxed).select(
        "how", "id", "printing", "finish", "quantity", "created", "condition", "container", F.array_join("tags", ",").alias("tags"), "note", "proxy"
    )
    none = {c: F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns}
    return out.unionByName(apart.select(*[F.lit("apart").alias("how") if c == "how" else F.col("apart").alias(c) if c == "quantity" else none[c] for c in out.columns]))


REVIEW_LIST = """
WITH l AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'foil' ELSE 'nonfoil' END AS finish,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
e AS (SELECT l_orderkey || ':' || n AS id, l_partkey::VARCHAR AS printing, finish, l_quantity::BIGINT AS quantity, strftime(l_shipdate, '%Y-%m-%d') AS created,
  CASE WHEN l_returnflag = 'R' THEN 'good' END AS condition, CASE WHEN l_suppkey % 3 = 0 THEN 'shelf' END AS container, CASE WHEN l_discount > 0.05 THEN 'cheap' END AS tags,
  CASE WHEN l_suppkey % 4 = 0 THEN 'noted' END AS note, l_suppkey % 5 = 0 AS proxy FROM l),
k AS (SELECT * FROM e WHERE quantity <= 45),
h AS (SELECT DISTINCT l_partkey::VARCHAR AS printing, finish FROM l WHERE l_returnflag = 'R')
SELECT 'own' AS how, id, printing, finish, quantity, created, condition, container, tags, note, proxy FROM k
UNION ALL SELECT 'boxed', id, printing, finish, quantity, created, condition, 'box', tags, note, proxy FROM k WHERE quantity < 3
UNION ALL SELECT 'apart', NULL, NULL, NULL, greatest(0, count(*) - 100), NULL, NULL, NULL, NULL, NULL, NULL FROM k SEMI JOIN h USING (printing, finish)
"""


QUERIES = {
    "review_list": (review_list, REVIEW_LIST),
    "narrow_sets": (narrow_sets, NARROW_SETS),
    "place_contents": (place_contents, PLACE_CONTENTS),
    "merge_entries": (merge_entries, MERGE_ENTRIES),
    "search_grouped": (search_grouped, SEARCH_GROUPED),
    "search_ungrouped": (search_ungrouped, SEARCH_UNGROUPED),
}
