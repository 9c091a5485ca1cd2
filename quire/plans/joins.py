"""Lookups, set operations and record shapes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import masks, shapes, text as tx
from ..operators import lookups, ranking, stacks
from ..operators.sizes import maybe_broadcast
from .tables import table


def anti_missing(spark: SparkSession, root: str) -> DataFrame:
    """Customers with no urgent finished order."""
    cust = table(spark, root, "customer").select("c_custkey", "c_name")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    orders = table(spark, root, "orders").filter(urgent).select(F.col("o_custkey").alias("c_custkey"))
    return lookups.missing(cust, orders, "c_custkey")


ANTI_MISSING = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


def semi_known(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose content digest some earlier document already had."""
    docs = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "digest").filter(F.col("doc_id") > F.col("first")).select("doc_id", "first")


SEMI_KNOWN = """
WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents),
f AS (SELECT digest, min(doc_id) AS first FROM d GROUP BY 1)
SELECT doc_id, first FROM d JOIN f USING (digest) WHERE doc_id > first
"""


def result_diff(spark: SparkSession, root: str) -> DataFrame:
    """Part names only one of two searches finds."""
    part = table(spark, root, "part").select("p_name", "p_size", "p_type")
    ours = part.filter(F.col("p_size") > 48).select("p_name")
    theirs = part.filter((F.col("p_type") == "LARGE") & (F.col("p_size") > 40)).select("p_name")
    return lookups.result_diff(ours, theirs)


RESULT_DIFF = """
SELECT p_name, 'theirs' AS only FROM (SELECT p_name FROM part WHERE p_type = 'LARGE' AND p_size > 40
  EXCEPT SELECT p_name FROM part WHERE p_size > 48)
UNION ALL SELECT p_name, 'ours' FROM (SELECT p_name FROM part WHERE p_size > 48
  EXCEPT SELECT p_name FROM part WHERE p_type = 'LARGE' AND p_size > 40)
"""


def catalog_joins(spark: SparkSession, root: str) -> DataFrame:
    """Lines described by their part and ordered for an export: brand, natural
    size, flag, status, whatever the catalog cannot name last."""
    line = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_suppkey"
    )
    part = table(spark, root, "part").filter(F.col("p_type") != "PROMO").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("set_code"), tx.natural_key(F.col("p_size").cast("string")).alias("number_key")
    )
    held = line.join(part, "l_partkey", "left")
    order = [
        F.col("set_code").isNull().asc(),
        F.asc("set_code"),
        F.asc("number_key"),
        F.when(F.col("set_code").isNotNull(), F.col("l_returnflag")).asc(),
        F.when(F.col("set_code").isNotNull(), F.col("l_linestatus")).asc(),
        F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice"), F.asc("l_suppkey"),
    ]
    return ranking.number_rows(held, order, "place").select("place", "l_orderkey", "l_linenumber", "l_extendedprice", "set_code")


CATALOG_JOINS = """
WITH h AS (SELECT l.*, p_brand AS set_code, p_size AS number FROM lineitem l
  LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') p ON p_partkey = l_partkey)
SELECT row_number() OVER (ORDER BY set_code IS NULL, set_code, number, CASE WHEN set_code IS NOT NULL THEN l_returnflag END,
  CASE WHEN set_code IS NOT NULL THEN l_linestatus END, l_orderkey, l_linenumber, l_extendedprice, l_suppkey) AS place,
  l_orderkey, l_linenumber, l_extendedprice, set_code FROM h
"""


def stack_index(spark: SparkSession, root: str) -> DataFrame:
    """One order an identity: the first held, or the last of the later ones."""
    orders = table(spark, root, "orders").select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("identity"), "o_orderkey", "o_totalprice", "o_orderstatus"
    )
    held = orders.filter(F.col("o_orderstatus") != "P").drop("o_orderstatus")
    later = orders.filter(F.col("o_orderstatus") == "P").drop("o_orderstatus")
    return stacks.stack_index(held, later, "identity", "o_orderkey")


STACK_INDEX = """
WITH o AS (SELECT o_custkey || '/' || o_orderpriority AS identity, o_orderkey, o_totalprice, o_orderstatus = 'P' AS later FROM orders)
SELECT identity, o_orderkey, o_totalprice FROM o QUALIFY row_number() OVER (PARTITION BY identity
  ORDER BY later DESC, CASE WHEN later THEN -o_orderkey ELSE o_orderkey END) = 1
"""


def checked_rows(spark: SparkSession, root: str) -> DataFrame:
    """Lines checked against the catalog by part id and by a composed key, the
    disagreements named; and against which suppliers may ship a flag."""
    line = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("qty")
    )
    part = table(spark, root, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    keys = line.select(lookups.print_key(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")), F.col("qty").cast("string")).alias("key"))
    found = lookups.locate(keys, part, "key", "p_brand", "p_size", "p_partkey", "p_partkey")
    made = table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.when(F.col("s_nationkey") % 6 != 0, F.when(F.col("s_acctbal") > 3000, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("R")))).alias("finishes"),
    )
    rows = (
        line.withColumn("key", lookups.print_key(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")), F.col("qty").cast("string")))
        .join(part.filter(F.col("p_size").cast("int") < 45).select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
        .join(found.withColumnRenamed("p_partkey", "by_key"), "key", "left")
        .join(made, "l_suppkey", "left")
    )
    fault = (
        F.when(F.col("p_brand").isNull(), F.lit("no such id"))
        .when(F.col("by_key").isNull(), F.lit("no such key"))
        .when(F.col("by_key") != F.col("l_partkey"), F.concat(F.lit("key names "), F.col("by_key").cast("string")))
    )
    finish = F.when(
        F.col("finishes").isNotNull() & ~F.array_contains("finishes", F.col("l_returnflag")),
        F.concat(F.array_join("finishes", " and "), F.lit(" only, not "), F.col("l_returnflag")),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", fault.alias("fault"), finish.alias("finish_fault"))


CHECKED_ROWS = """
WITH k AS (SELECT lower(p_brand || '/' || p_size) AS key, max(p_partkey) AS by_key FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN p.p_brand IS NULL THEN 'no such id' WHEN by_key IS NULL THEN 'no such key'
    WHEN by_key <> l_partkey THEN 'key names ' || by_key END AS fault,
  CASE WHEN s_nationkey % 6 <> 0 THEN CASE WHEN s_acctbal > 3000 AND l_returnflag = 'R' THEN 'A and N only, not R'
    WHEN s_acctbal <= 3000 AND l_returnflag <> 'R' THEN 'R only, not ' || l_returnflag END END AS finish_fault
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) p ON p.p_partkey = l_partkey
LEFT JOIN k ON key = 'brand#' || (l_suppkey % 25 + 1) || '/' || l_quantity::INT LEFT JOIN supplier ON s_suppkey = l_suppkey
"""


def artwork_groups(spark: SparkSession, root: str) -> DataFrame:
    """Parts as fronts and suppliers as backs: for each artwork, the fronts to
    look under and how many lines carry them."""
    line = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("front"), F.when(F.col("l_suppkey") != F.col("l_partkey"), F.col("l_suppkey")).alias("back")
    )
    fronts = table(spark, root, "part").filter(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("front"))
    pairs = lookups.distinct_pairs(line.filter(F.col("back").isNotNull()).select("back", "front"), fronts)
    faces = line.select(F.col("front").alias("artwork")).union(line.filter(F.col("back").isNotNull()).select("back")).distinct()
    found = lookups.faces_of_match(faces, pairs, fronts)
    uses = lookups.carrying(line, "id", "front", "back").groupBy("artwork").agg(F.count(F.lit(1)).alias("uses"))
    per = found.groupBy("artwork").agg(F.count(F.lit(1)).alias("fronts"), F.min("front").alias("least"))
    return per.join(uses, "artwork")


ARTWORK_GROUPS = """
WITH l AS (SELECT l_partkey AS front, nullif(l_suppkey, l_partkey) AS back FROM lineitem),
f AS (SELECT p_partkey AS front FROM part WHERE p_type <> 'PROMO'),
p AS (SELECT DISTINCT back, front FROM l WHERE back IS NOT NULL AND front IN (SELECT front FROM f)),
a AS (SELECT front AS artwork FROM l UNION SELECT back FROM l WHERE back IS NOT NULL),
m AS (SELECT artwork, artwork AS front FROM a WHERE artwork IN (SELECT front FROM f)
      UNION SELECT artwork, p.front FROM a JOIN p ON p.back = artwork),
u AS (SELECT artwork, count(*) AS uses FROM (SELECT front AS artwork FROM l UNION ALL SELECT back FROM l WHERE back IS NOT NULL) GROUP BY 1)
SELECT artwork, count(*) AS fronts, min(front) AS least, any_value(uses) AS uses FROM m JOIN u USING (artwork) GROUP BY 1
"""


def referenced_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every part an order names or its customer's segment points at, once."""
    line = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("matched"), F.min("l_suppkey").alias("chosen"))
    ids = line.select(F.explode(F.array_union(F.array("chosen"), "matched")).alias("id"))
    offered = line.agg(F.count_if(F.exists("matched", lambda m: m == F.col("chosen"))).alias("offered"))
    return ids.distinct().join(F.broadcast(offered))


REFERENCED_IDS = """
WITH o AS (SELECT l_orderkey, min(l_suppkey) AS chosen, list(l_partkey) AS m FROM lineitem GROUP BY 1)
SELECT id, (SELECT count(*) FROM o WHERE list_contains(m, chosen)) AS offered
FROM (SELECT chosen AS id FROM o UNION SELECT l_partkey FROM lineitem)
"""


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Each order's lines as writes and their answers by position, deletes
    passed over, with what the order's part still owes."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_suppkey", "l_linestatus")
    order = [F.asc("l_linenumber"), F.asc("l_extendedprice"), F.asc("l_suppkey")]
    rows = ranking.ranked(line, ["l_orderkey"], order, "position")
    writes = rows.select(
        "l_orderkey", "position", F.when(F.col("l_returnflag") == "R", "delete").otherwise("create").alias("action"), F.col("l_quantity").alias("quantity")
    )
    results = rows.select(
        "l_orderkey", "position", F.when(F.col("l_linestatus") == "O", F.concat_ws("/", F.lit("at"), "l_orderkey", "position")).alias("uri")
    )
    done = lookups.landed_rows(writes, results, ["l_orderkey", "position"])
    owed = writes.groupBy("l_orderkey").agg(F.count_if(F.col("action") != "delete").alias("owed"))
    return done.join(owed, "l_orderkey").select("l_orderkey", "position", "uri", "quantity", "owed")


LANDED = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_suppkey) AS position FROM lineitem)
SELECT l_orderkey, position, 'at/' || l_orderkey || '/' || position AS uri, l_quantity AS quantity,
  (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = r.l_orderkey AND x.l_returnflag <> 'R') AS owed
FROM r WHERE l_returnflag <> 'R' AND l_linestatus = 'O'
"""


def labels_from_names(spark: SparkSession, root: str) -> DataFrame:
    """File names parsed into keys and tags, and the document each one names."""
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")
    how = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    name = F.concat(
        F.col("source"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("-"), F.col("doc_id").cast("string"),
        F.when(F.col("lang") != "en", F.concat(F.lit("-"), "lang")).otherwise(""), F.lit("__"), how, F.lit("-bare.jpg"),
    )
    read = docs.select(F.col("doc_id").alias("shot"), shapes.read_label(name).alias("label"))
    keyed = read.select("shot", "label.set_code", "label.number", "label.lang", F.array_join("label.tags", "+").alias("tags"))
    held = docs.select(F.col("source").alias("set_code"), F.col("doc_id").cast("string").alias("number"), "lang", "doc_id")
    stratum = shapes.stratum(
        F.when(F.col("doc_id") % 10 == 0, "token").otherwise("normal"), F.when(F.col("doc_id") % 7 == 0, "legendary PLANESWALKER").otherwise("x"),
        F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 3 == 0, "borderless").otherwise("black"), F.when(F.col("doc_id") % 2 == 0, "2015").otherwise("1997"),
    )
    return keyed.join(held, ["set_code", "number", "lang"], "left").select("shot", "set_code", "number", "lang", "tags", "doc_id", F.when(F.col("doc_id").isNotNull(), stratum).alias("stratum"))


LABELS_FROM_NAMES = """
SELECT doc_id AS shot, CASE WHEN ok THEN source END AS set_code, CASE WHEN ok THEN doc_id::VARCHAR END AS number,
  CASE WHEN ok THEN lang END AS lang, CASE WHEN ok THEN CASE WHEN n_chars > 2000 THEN 'long+bare' ELSE 'short+bare' END END AS tags,
  CASE WHEN ok THEN doc_id END AS doc_id, CASE WHEN ok THEN CASE WHEN doc_id % 10 = 0 THEN 'token' WHEN doc_id % 7 = 0 THEN 'walker' WHEN doc_id % 5 = 0 THEN 'full-art'
    WHEN doc_id % 3 = 0 THEN 'borderless' WHEN doc_id % 2 = 0 THEN 'modern' ELSE 'older' END END AS stratum
FROM (SELECT *, doc_id % 11 <> 0 AS ok FROM documents)
WHERE doc_id % 11 <> 0 OR lang = 'en'
UNION ALL
SELECT doc_id, source || doc_id, lang, 'en', CASE WHEN n_chars > 2000 THEN 'long+bare' ELSE 'short+bare' END, NULL, NULL
FROM documents WHERE doc_id % 11 = 0 AND lang <> 'en'
"""


def shred_json(spark: SparkSession, root: str) -> DataFrame:
    """Conversations as records with faces: ids and artworks lifted, backs,
    stats and joined face text."""
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    face = F.to_json(
        F.struct(
            F.concat(F.col("role"), F.lit(" "), F.col("n").cast("string")).alias("name"),
            F.when(F.col("n") % 2 == 0, F.concat(F.lit("{"), F.col("n").cast("string"), F.lit("}{W}"))).otherwise(F.lit("")).alias("mana_cost"),
            F.when(F.col("n") % 3 != 0, F.concat(F.lit("o"), F.col("conv_id").cast("string"))).alias("oracle_id"),
            F.when(F.col("n") % 5 != 0, F.concat(F.lit("i"), (F.col("n") % 4).cast("string"))).alias("illustration_id"),
            F.when(F.col("n") % 7 != 0, F.col("n").cast("string")).alias("power"),
            F.when(F.col("n") % 4 != 0, F.lit("1")).alias("toughness"),
            F.lit("9").alias("loyalty"),
        )
    )
    records = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", face.alias("f")))), lambda x: x["f"]), ","), F.lit("]")).alias("faces"))
    parsed = records.withColumn("f", shapes.parse_faces(F.col("faces")))
    front = shapes.lift_illustration(F.lit(None).cast("string"), F.col("f"))
    shown = shapes.project_faces(F.col("f"), F.lit(2))
    return parsed.select(
        "conv_id",
        shapes.lift_oracle_id(F.lit(None).cast("string"), F.col("f")).alias("oracle_id"),
        front.alias("art"),
        shapes.back_illustration(front, F.col("f")).alias("back"),
        shapes.across_faces(F.lit(None).cast("string"), F.transform("f", lambda x: x["mana_cost"])).alias("cost"),
        F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["name"], x["colors"].cast("string"), F.coalesce(x["stats"], F.lit("none")))), "|").alias("shown"),
    )


SHRED_JSON = """
WITH t AS (SELECT conv_id, turn, role || ' ' || length(text) AS name, CASE WHEN length(text) % 2 = 0 THEN '{' || length(text) || '}{W}' ELSE '' END AS cost,
  CASE WHEN length(text) % 3 <> 0 THEN 'o' || conv_id END AS oid, CASE WHEN length(text) % 5 <> 0 THEN 'i' || length(text) % 4 END AS iid,
  CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 2 END AS mask,
  CASE WHEN length(text) % 7 <> 0 THEN length(text) || '/' || CASE WHEN length(text) % 4 <> 0 THEN '1' ELSE '' END ELSE '9' END AS stats
  FROM conversations),
g AS (SELECT conv_id, list(oid ORDER BY turn) AS o, list(iid ORDER BY turn) AS i, list(cost ORDER BY turn) AS c,
  string_agg(name || ':' || mask || ':' || stats, '|' ORDER BY turn) AS shown FROM t GROUP BY 1)
SELECT conv_id, list_filter(o, lambda x: x IS NOT NULL)[1] AS oracle_id, i[1] AS art, CASE WHEN i[1] IS NOT NULL AND i[2] <> i[1] THEN i[2] END AS back,
  nullif(array_to_string(list_filter(c, lambda x: x <> ''), ' // '), '') AS cost, shown FROM g
"""


def pack_flags(spark: SparkSession, root: str) -> DataFrame:
    """Each order's flags packed as bits, canonical letters and commander text."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    letters = {"A": "G", "N": "W", "R": "U"}
    color = F.create_map(*[F.lit(x) for p in letters.items() for x in p])
    held = line.groupBy("l_orderkey").agg(
        F.collect_set(color[F.col("l_returnflag")]).alias("colors"),
        F.bool_or(F.col("l_linestatus") == "F").alias("reserved"),
        F.max(F.when(F.col("l_quantity") > 49, F.lit(True))).alias("changer"),
        F.max("l_discount").alias("most"),
    )
    type_line = F.when(F.col("most") >= 0.1, "legendary snow CREATURE").otherwise("Legendary Artifact")
    text = F.when(F.col("most") < 0.02, "This CAN BE YOUR COMMANDER.")
    return held.select(
        "l_orderkey",
        masks.canonical_colors(F.col("colors")).alias("letters"),
        masks.color_mask(F.array_join("colors", "")).cast("long").alias("mask"),
        masks.flags_mask(F.col("reserved"), F.col("changer"), shapes.is_commander(F.lit(0), type_line, text)).cast("long").alias("flags"),
        shapes.stats_text(F.when(F.col("most") > 0.05, F.lit("3")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("7")).alias("stats"),
    )


PACK_FLAGS = """
WITH h AS (SELECT l_orderkey, bool_or(l_returnflag = 'N') AS w, bool_or(l_returnflag = 'R') AS u, bool_or(l_returnflag = 'A') AS g,
  bool_or(l_linestatus = 'F') AS r, bool_or(l_quantity > 49) AS c, max(l_discount) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN w THEN 'W' ELSE '' END || CASE WHEN u THEN 'U' ELSE '' END || CASE WHEN g THEN 'G' ELSE '' END AS letters,
  (w::INT + 2 * u::INT + 16 * g::INT)::BIGINT AS mask, (r::INT + 2 * c::INT + 4 * (m >= 0.1 OR m < 0.02)::INT)::BIGINT AS flags,
  CASE WHEN m > 0.05 THEN '3/' ELSE '7' END AS stats FROM h
"""

QUERIES = {
    "anti_missing": (anti_missing, ANTI_MISSING),
    "semi_known": (semi_known, SEMI_KNOWN),
    "result_diff": (result_diff, RESULT_DIFF),
    "catalog_joins": (catalog_joins, CATALOG_JOINS),
    "stack_index": (stack_index, STACK_INDEX),
    "checked_rows": (checked_rows, CHECKED_ROWS),
    "artwork_groups": (artwork_groups, ARTWORK_GROUPS),
    "referenced_ids": (referenced_ids, REFERENCED_IDS),
    "landed": (landed, LANDED),
    "labels_from_names": (labels_from_names, LABELS_FROM_NAMES),
    "shred_json": (shred_json, SHRED_JSON),
    "pack_flags": (pack_flags, PACK_FLAGS),
}
