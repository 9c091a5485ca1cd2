"""Search, predicates and orders on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import costs, masks, text as tx
from ..operators import find, predicates as p, ranking
from .tables import spread_table, table

TYPES = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# Names as the SQL side normalises them; the tables hold Latin text.
NORMAL = "trim(regexp_replace(replace(lower(strip_accents({})), '''', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _n(expr: str) -> str:
    return NORMAL.format(expr)


def find_top_k(spark: SparkSession, root: str) -> DataFrame:
    """Parts named for a ring, with some one returned line over 30 copies,
    by name tier, then type, then popularity."""
    part = table(spark, root, "part").select("p_partkey", "p_name", "p_type", "p_size")
    line = table(spark, root, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    prints = line.withColumnRenamed("l_partkey", "p_partkey")
    pred = p.holds(F.col("l_returnflag") == "R", child=True) & p.holds(F.col("l_quantity") > 30, child=True)
    counts = prints.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("printings"))
    cards = part.join(counts, "p_partkey").withColumns(
        {
            "rank": F.when(F.col("p_size") > 10, F.col("p_size")),
            "kind": F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")), F.lit(0)),
        }
    )
    scored = find.with_popularity(cards, "rank", "printings")
    kept = find.match_cards(scored, prints, pred, "p_partkey")
    return find.rank_names(kept, "Ring", "p_name", "kind", "score", "p_partkey", 50).select(
        "p_partkey", "p_name", F.col("tier").cast("long").alias("tier"), "kind", F.round("score", 6).alias("score")
    )


FIND_TOP_K = f"""
WITH c AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_size > 10 THEN p_size END AS rank, n AS printings
           FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
s AS (SELECT p_partkey, p_name,
        coalesce(list_position(['STANDARD','SMALL','MEDIUM','LARGE','ECONOMY','PROMO'], p_type), 0)::BIGINT AS kind,
        coalesce(rank::DOUBLE, (SELECT max(rank) FROM c) / printings) AS score, {_n('p_name')} AS plain FROM c),
t AS (SELECT *, CASE WHEN plain = 'ring' THEN 0 WHEN plain LIKE 'ring%' OR plain LIKE '% ring%' THEN 1
                     WHEN plain LIKE '%ring%' THEN 2 END AS tier FROM s)
SELECT p_partkey, p_name, tier::BIGINT AS tier, kind, round(score, 6) AS score FROM t
WHERE tier IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
      AND l_returnflag = 'R' AND l_quantity > 30)
ORDER BY tier, t.kind, t.score, p_name, p_partkey LIMIT 50
"""


def answering_row(spark: SparkSession, root: str) -> DataFrame:
    """Per order, the first line that was returned and shipped late, else the
    first line."""
    line = table(spark, root, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity"
    )
    pred = p.holds(F.col("l_returnflag") == "R", child=True) & ~p.holds(F.col("l_quantity") <= 25, child=True)
    out = find.answering_print(
        line, pred, "l_orderkey", ["l_shipdate", "l_linenumber", "l_extendedprice"], "l_extendedprice", "price"
    )
    return out


ANSWERING_ROW = """
SELECT l_orderkey,
  coalesce(arg_min(l_extendedprice, (l_shipdate, l_linenumber, l_extendedprice))
             FILTER (WHERE l_returnflag = 'R' AND NOT l_quantity <= 25),
           arg_min(l_extendedprice, (l_shipdate, l_linenumber, l_extendedprice))) AS price,
  count(*) FILTER (WHERE l_returnflag = 'R' AND NOT l_quantity <= 25) > 0 AS answered
FROM lineitem GROUP BY 1
"""


def ever_vs_same(spark: SparkSession, root: str) -> DataFrame:
    """Orders with an F line that is also large, where some line, any of them,
    was returned."""
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line = table(spark, root, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_quantity")
    pred = (
        p.holds(F.col("l_linestatus") == "F", child=True)
        & p.holds(F.col("l_quantity") >= 45, child=True)
        & p.any_child(F.col("l_returnflag") == "R", "_ever_r")
        & ~p.holds(F.col("l_returnflag") == "R", child=True)
    )
    return find.match_cards(orders, line, pred, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "o_custkey")


EVER_VS_SAME = """
SELECT o_orderkey, o_custkey FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F'
              AND l_quantity >= 45 AND l_returnflag <> 'R')
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
"""


def _event_mask(column: str = "event_type") -> Column:
    masked = F.lit(0)
    for i, name in enumerate(EVENT_TYPES):
        masked = F.when(F.col(column) == name, F.lit(1 << i)).otherwise(masked)
    return masked


def mask_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Per user and hour, the set of event types as a mask, compared with sets."""
    seen = (
        table(spark, root, "events")
        .select("user_id", F.date_trunc("hour", "ts").alias("hour"), _event_mask().alias("bit"))
        .groupBy("user_id", "hour")
        .agg(F.bit_or("bit").alias("mask"))
    )

    def is_(op: str, value) -> Column:
        return p.color_is(op, value, colors="mask").column

    return seen.select(
        "user_id",
        F.date_format("hour", "yyyy-MM-dd HH").alias("hour"),
        F.col("mask").cast("long").alias("mask"),
        masks.popcount(F.col("mask")).cast("long").alias("held"),
        is_(":", "wu").alias("covers"),
        is_("=", "azorius").alias("equal"),
        is_(">", "WU").alias("proper_over"),
        is_("<=", "esper").alias("inside"),
        is_("<", "esper").alias("proper_in"),
        is_("!=", "W").alias("differs"),
        is_(">=", "2").alias("two_up"),
        is_(":", "m").alias("several"),
        is_(">", "colorless").alias("some"),
    )


MASK_PREDICATES = """
WITH m AS (SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour,
  bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4
              WHEN 'signup' THEN 8 WHEN 'view' THEN 16 ELSE 0 END)::BIGINT AS mask
  FROM events GROUP BY 1, 2)
SELECT user_id, hour, mask, bit_count(mask)::BIGINT AS held,
  mask & 3 = 3 AS covers, mask = 3 AS equal, mask & 3 = 3 AND bit_count(mask) > 2 AS proper_over,
  mask & 24 = 0 AS inside, mask & 24 = 0 AND bit_count(mask) < 3 AS proper_in, mask <> 1 AS differs,
  bit_count(mask) >= 2 AS two_up, bit_count(mask) > 1 AS several, mask <> 0 AS some
FROM m
"""


def symbol_multiset(spark: SparkSession, root: str) -> DataFrame:
    """Documents by how their word counts compare with a small multiset."""
    docs = spread_table(spark, root, "documents", "doc_id", "text", "lang")
    held = docs.withColumn("counts", costs.symbol_counts(F.filter(tx.words(F.col("text")), lambda w: w.isin("the", "of", "le", "la", "und", "que"))))

    def vs(op: str, wanted: dict[str, float]) -> Column:
        return F.coalesce(costs.compare_counts(F.col("counts"), op, wanted), F.lit(False))

    return held.select(
        "doc_id",
        F.aggregate(F.map_values("counts"), F.lit(0.0), lambda a, n: a + n).alias("size"),
        vs(":", {"THE": 2.0, "OF": 1.0}).alias("covers"),
        vs("<=", {"THE": 5.0, "OF": 5.0, "LE": 5.0}).alias("inside"),
        vs("<", {"LE": 3.0, "LA": 3.0}).alias("less"),
        vs(">", {"QUE": 1.0}).alias("more"),
        vs("!=", {"UND": 1.0}).alias("differs"),
    )


SYMBOL_MULTISET = r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(regexp_replace(regexp_replace(text,
        '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents),
c AS (SELECT doc_id, count(*) FILTER (WHERE word = 'the') AS t, count(*) FILTER (WHERE word = 'of') AS o,
  count(*) FILTER (WHERE word = 'le') AS le, count(*) FILTER (WHERE word = 'la') AS la,
  count(*) FILTER (WHERE word = 'und') AS u, count(*) FILTER (WHERE word = 'que') AS q FROM w GROUP BY 1),
d AS (SELECT doc_id, coalesce(t, 0) AS t, coalesce(o, 0) AS o, coalesce(le, 0) AS le, coalesce(la, 0) AS la,
  coalesce(u, 0) AS u, coalesce(q, 0) AS q FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, (t + o + le + la + u + q)::DOUBLE AS size, t >= 2 AND o >= 1 AS covers,
  t <= 5 AND o <= 5 AND le <= 5 AND la + u + q = 0 AS inside,
  le <= 3 AND la <= 3 AND t + o + u + q = 0 AND le + la < 6 AS less,
  q >= 1 AND t + o + le + la + u + q > 1 AS more,
  NOT (u = 1 AND t + o + le + la + q = 0) AS differs
FROM d
"""


def ordinal_compare(spark: SparkSession, root: str) -> DataFrame:
    """Order priorities by place in a list that leaves one of them out."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    at = lambda op, v: p.ordinal(op, v, "o_orderpriority", PRIORITIES).column
    return orders.select(
        "o_orderkey",
        at(">=", "3-MEDIUM").alias("medium_up"),
        at("<", "4-NOT SPECIFIED").alias("under"),
        at("=", "none").alias("unlisted"),
        at("!=", "2-HIGH").alias("not_high"),
    )


ORDINAL_COMPARE = """
WITH r AS (SELECT o_orderkey, coalesce(list_position(['5-LOW','4-NOT SPECIFIED','3-MEDIUM','2-HIGH'],
             o_orderpriority), 0) - 1 AS lvl FROM orders)
SELECT o_orderkey, lvl >= 2 AS medium_up, lvl < 1 AS under, lvl = -1 AS unlisted, lvl <> 3 AS not_high FROM r
"""


def text_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Text and scope predicates: parts by words, suppliers by a nullable place."""
    part = table(spark, root, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    tree = (p.type_has("Ecóno", "p_type") | p.text_has("RING", "p_name")) & ~p.text_has("red", "p_name")
    by_part = part.filter(tree.column).select(
        F.lit("part").alias("what"), F.col("p_partkey").alias("id"), F.upper("p_brand").alias("word")
    )
    supplier = table(spark, root, "supplier").withColumn(
        "container", F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("n"), "s_nationkey"))
    )
    loose = supplier.filter(p.within_scope(None).column | p.within_scope("n7").column)
    by_place = loose.select(F.lit("supplier"), F.col("s_suppkey"), F.coalesce("container", F.lit("loose")))
    brands = part.select("p_brand").distinct().filter(
        p.holds(F.contains(F.lower("p_brand"), F.lit("d#1"))).column | p.in_set("BRAND#2", "p_brand").column
    )
    by_brand = brands.select(F.lit("brand"), F.lit(None).cast("long"), F.col("p_brand"))
    return by_part.union(by_place).union(by_brand)


TEXT_PREDICATES = f"""
SELECT 'part' AS what, p_partkey AS id, upper(p_brand) AS word FROM part
WHERE ({_n('p_type')} LIKE '%econo%' OR {_n('p_name')} LIKE '%ring%') AND NOT {_n('p_name')} LIKE '%red%'
UNION ALL
SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN 'n' || s_nationkey ELSE 'loose' END
FROM supplier WHERE s_nationkey % 5 = 0 OR s_nationkey = 7
UNION ALL
SELECT 'brand', NULL, p_brand FROM (SELECT DISTINCT p_brand FROM part)
WHERE lower(p_brand) LIKE '%d#1%' OR p_brand = 'brand#2'
"""


def number_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Stats written ``a/b``, some unreadable or half empty, and years."""
    part = table(spark, root, "part").select("p_partkey", "p_size", "p_retailprice")
    left = F.when(F.col("p_size") % 7 == 0, F.lit("*")).otherwise(F.col("p_size").cast("string"))
    right = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise((50 - F.col("p_size")).cast("string"))
    cards = part.withColumn("stats", F.concat(left, F.lit("/"), right)).withColumn(
        "cmc", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    )
    return cards.select(
        "p_partkey",
        p.power(">", "tou").column.alias("pow_over_tou"),
        p.power("<=", 20).column.alias("pow_low"),
        p.toughness("=", "").column.alias("tou_zero"),
        (~p.toughness(">=", "10")).column.alias("not_tou_ten"),
        p.mana_value(">=", 25).column.alias("mv_high"),
        p.mana_value("!=", "x").column.alias("mv_unread"),
    )


NUMBER_PREDICATES = """
WITH s AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS l,
             CASE WHEN p_size % 5 = 0 THEN 0 ELSE 50 - p_size END AS r,
             CASE WHEN p_size % 3 <> 0 THEN p_size END AS mv FROM part)
SELECT p_partkey, coalesce(l > r, false) AS pow_over_tou, coalesce(l <= 20, false) AS pow_low, r = 0 AS tou_zero,
  NOT r >= 10 AS not_tou_ten, coalesce(mv >= 25, false) AS mv_high, false AS mv_unread FROM s
"""


def children_of_group(spark: SparkSession, root: str) -> DataFrame:
    """Orders of the customers of one segment, newest customer's first order
    date first, natural order of a text number inside; and orders by year."""
    cust = table(spark, root, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")
    orders = table(spark, root, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate"
    )
    pred = p.holds(F.col("o_orderstatus").isin("O", "F"), child=True) & p.year(">=", 1996, "o_orderdate")
    rows = find.match_prints(cust, orders, pred, "c_custkey", "c_name", "customer")
    number = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string"), F.lit("b"))
    released = rows.groupBy("c_custkey").agg(F.min("o_orderdate").alias("released"))
    placed = rows.join(released, "c_custkey").withColumn("number", number)
    ranked = ranking.number_rows(
        placed, [F.desc("released"), F.asc("c_custkey"), tx.natural_key(F.col("number")).asc()], "place"
    )
    return ranked.select("place", "c_custkey", "number")


CHILDREN_OF_GROUP = """
WITH r AS (SELECT c_custkey, o_orderkey, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'F') AND year(o_orderdate) >= 1996),
g AS (SELECT *, min(o_orderdate) OVER (PARTITION BY c_custkey) AS released FROM r)
SELECT row_number() OVER (ORDER BY released DESC, c_custkey, o_orderkey) AS place, c_custkey,
  'o-' || o_orderkey || 'b' AS number FROM g
"""


def natural_sort(spark: SparkSession, root: str) -> DataFrame:
    """Page addresses under the natural order: numbers by value, not by digit."""
    pages = table(spark, root, "pages").select("page_id", "url")
    ranked = ranking.number_rows(pages, [tx.natural_key(F.col("url")).asc(), F.asc("page_id")], "place")
    return ranked.select("place", "page_id", "url")


NATURAL_SORT = """
WITH k AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(url, '([0-9]+|[^0-9]+)'),
  lambda x: CASE WHEN x[1] BETWEEN '0' AND '9'
    THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1')
    ELSE lower(x) END), '') AS key FROM pages)
SELECT row_number() OVER (ORDER BY key, page_id) AS place, page_id, url FROM k
""".replace("\\\\", "\\")


def orders_of_rows(spark: SparkSession, root: str) -> DataFrame:
    """The first fifty parts under every named order, both ways round."""
    part = table(spark, root, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 6 != 0, F.col("p_size").cast("double")).alias("cmc"),
        F.concat(
            F.when(F.col("p_size") % 7 == 0, F.lit("*")).otherwise(F.col("p_size").cast("string")),
            F.lit("/"),
            (F.col("p_size") % 9).cast("string"),
        ).alias("stats"),
        (F.col("p_size") % 13).alias("printings"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("edhrec_rank"),
        F.concat(F.lit("20"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0")).alias("released_at"),
        F.col("p_brand").alias("set_code"),
        F.element_at(
            F.array(*[F.lit(r) for r in ("common", "uncommon", "rare", "mythic", "bonus")]),
            F.col("p_size") % 5 + 1,
        ).alias("rarity"),
        F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("collector_number"),
    )
    out = None
    for order in ("name", "mv", "cmc", "pow", "tou", "rarity", "released", "set", "cn", "edhrec", "printings"):
        for reverse in (False, True):
            top = part.orderBy(*find.order_keys(order, reverse=reverse)).limit(50)
            one = top.select(F.lit(order).alias("by"), F.lit(reverse).alias("reversed"), "id")
            out = one if out is None else out.union(one)
    return out


def _orders_sql() -> str:
    keys = {
        "name": "",
        "mv": "coalesce(cmc, 0) ASC,",
        "cmc": "coalesce(cmc, 0) ASC,",
        "pow": "coalesce(pow, 'Infinity') ASC,",
        "tou": "tou ASC,",
        "rarity": "rar ASC,",
        "released": "released DESC,",
        "set": "p_brand ASC,",
        "cn": "size ASC,",
        "edhrec": "coalesce(edh, 9223372036854775807) ASC,",
        "printings": "printings DESC,",
    }
    parts = []
    for order, key in keys.items():
        for reverse in (False, True):
            full = key + "name ASC, id ASC"
            if reverse:
                full = full.replace(" ASC", " \0").replace(" DESC", " ASC").replace(" \0", " DESC")
            parts.append(
                f"SELECT * FROM (SELECT '{order}' AS \"by\", {str(reverse).lower()} AS reversed, id "
                f"FROM b ORDER BY {full} LIMIT 50)"
            )
    return (
        "WITH b AS (SELECT p_partkey AS id, p_name AS name, p_brand, p_size AS size, "
        "CASE WHEN p_size % 6 <> 0 THEN p_size::DOUBLE END AS cmc, "
        "CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS pow, p_size % 9 AS tou, "
        "p_size % 13 AS printings, CASE WHEN p_size % 4 <> 0 THEN p_size::BIGINT END AS edh, "
        "'20' || lpad((p_size % 25)::VARCHAR, 2, '0') AS released, "
        "CASE WHEN p_size % 5 = 4 THEN 0 ELSE p_size % 5 + 1 END AS rar FROM part) "
    ) + " UNION ALL ".join(parts)


def normalize_names(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents normalised, as a length and a digest of the result."""
    docs = spread_table(spark, root, "documents", "doc_id", "text")
    plain = tx.normalize_text(F.col("text"))
    return docs.select("doc_id", F.length(plain).cast("long").alias("chars"), F.md5(plain.cast("binary")).alias("digest"))


NORMALIZE_NAMES = f"SELECT doc_id, length(p)::BIGINT AS chars, md5(p) AS digest FROM (SELECT doc_id, {_n('text')} AS p FROM documents)"


def printed_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Parts as cards and their lines as printings: the cards that each of
    several conditions answers, those of one printing holding on one line."""
    cards = table(spark, root, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 32).cast("int").alias("color_identity"),
        F.format_string("{%d}{%s}", F.col("p_size") % 5, F.substring(F.lit("WUBRG"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1))).alias("mana_cost"),
        F.when(F.col("p_partkey") % 10 == 3, F.array(F.lit("{W}{2}"), F.lit("{9}"))).alias("other_costs"),
        F.when(F.col("p_size") % 6 == 0, F.array(F.lit("Reserved"))).alias("card_flags"),
    )
    finishes = F.when(F.col("l_returnflag") == "R", F.array(F.lit("foil"))).when(F.col("l_returnflag") == "A", F.array(F.lit("nonfoil"), F.lit("foil"))).otherwise(F.array(F.lit("nonfoil")))
    prints = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("id"), finishes.alias("finishes"), F.when(F.col("l_linenumber") == 5, F.array(F.lit("Promo"))).alias("print_flags"),
        F.col("l_linenumber").cast("string").alias("collector_number"), F.lower("l_linestatus").alias("lang"),
        F.when(F.col("l_suppkey") % 50 == 0, "transform").otherwise("normal").alias("layout"),
        F.concat(F.lit("O\u2019"), F.col("l_returnflag"), F.lit(" Bri\u00e9n")).alias("artist"), F.when(F.col("l_quantity") < 5, "missing").otherwise("highres_scan").alias("image_status"),
    )
    asked = {
        "identity": p.identity_is("<=", "wu"),
        "cost": p.mana_cost("=", "2W", faces=F.col("other_costs")),
        "reserved foil": p.flag_is("reserved") & p.flag_is("Foil"),
        "promo": p.flag_is("PROMO"),
        "number": p.collector_is("7") & p.lang_is("F"),
        "layout": p.layout_is("transform") & p.has_art(),
        "two sides": p.two_sided() & ~p.has_art(),
        "artist": p.artist_has("O'A brie") & p.lang_is("o"),
    }
    return find.match_each(cards, prints, asked, "id")


PRINTED_PREDICATES = """
WITH l AS (SELECT l_partkey AS id, bool_or(l_returnflag IN ('R', 'A')) AS foil, bool_or(l_linenumber = 5) AS promo, bool_or(l_linenumber = 7 AND l_linestatus = 'F') AS number,
  bool_or(l_suppkey % 50 = 0 AND l_quantity >= 5) AS layout, bool_or(l_suppkey % 50 = 0 AND l_quantity < 5) AS sides, bool_or(l_returnflag = 'A' AND l_linestatus = 'O') AS artist
  FROM lineitem GROUP BY 1),
j AS (SELECT * FROM part JOIN l ON id = p_partkey)
SELECT 'identity' AS asked, id FROM j WHERE p_partkey % 32 & 28 = 0
UNION ALL SELECT 'cost', id FROM j WHERE (p_size % 5 = 2 AND p_partkey % 5 = 0) OR p_partkey % 10 = 3
UNION ALL SELECT 'reserved foil', id FROM j WHERE p_size % 6 = 0 AND foil
UNION ALL SELECT 'promo', id FROM j WHERE promo
UNION ALL SELECT 'number', id FROM j WHERE number
UNION ALL SELECT 'layout', id FROM j WHERE layout
UNION ALL SELECT 'two sides', id FROM j WHERE sides
UNION ALL SELECT 'artist', id FROM j WHERE artist
"""


QUERIES = {
    "printed_predicates": (printed_predicates, PRINTED_PREDICATES),
    "find_top_k": (find_top_k, FIND_TOP_K),
    "answering_row": (answering_row, ANSWERING_ROW),
    "ever_vs_same": (ever_vs_same, EVER_VS_SAME),
    "mask_predicates": (mask_predicates, MASK_PREDICATES),
    "symbol_multiset": (symbol_multiset, SYMBOL_MULTISET),
    "ordinal_compare": (ordinal_compare, ORDINAL_COMPARE),
    "text_predicates": (text_predicates, TEXT_PREDICATES),
    "number_predicates": (number_predicates, NUMBER_PREDICATES),
    "children_of_group": (children_of_group, CHILDREN_OF_GROUP),
    "natural_sort": (natural_sort, NATURAL_SORT),
    "orders_of_rows": (orders_of_rows, _orders_sql()),
    "normalize_text": (normalize_names, NORMALIZE_NAMES),
}
