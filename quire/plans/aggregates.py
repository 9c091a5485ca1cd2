"""Aggregates, dictionaries and numbering on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import masks, text as tx
from ..operators import folding, measures, ranking
from ..operators.sizes import maybe_broadcast
from .tables import spread_table, table


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def decode_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """Event types as places in a commonest-first dictionary, and back."""
    events = table(spark, root, "events").select("event_id", "event_type")
    words = ranking.common_first(events, "event_type")
    coded = events.join(maybe_broadcast(words), F.col("event_type") == F.col("value")).select("event_id", "position")
    return coded.join(maybe_broadcast(words), "position").select("event_id", "position", F.col("value").alias("event_type"))


DECODE_DICTIONARY = """
WITH d AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS position
           FROM events GROUP BY 1)
SELECT event_id, position, event_type FROM events JOIN d USING (event_type)
"""


def array_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """Every word of every document in a commonest-first dictionary."""
    docs = spread_table(spark, root, "documents", "text").select(tx.words(F.col("text")).alias("words"))
    return ranking.common_first_array(docs, "words").select("position", F.col("value").alias("word"), "uses")


WORDS_SQL = r"""regexp_split_to_array(trim(regexp_replace(lower(regexp_replace(regexp_replace(text,
        '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')"""

ARRAY_DICTIONARY = f"""
WITH w AS (SELECT unnest({WORDS_SQL}) AS word FROM documents)
SELECT row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS position, word, count(*) AS uses
FROM w WHERE word <> '' GROUP BY word
"""


def mask_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Line flags of an order as a mask over the dictionary, and decoded."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_returnflag")
    names = ["A", "N", "R"]
    held = line.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    mask = masks.words_mask(F.col("flags"), names)
    return held.select(
        "l_orderkey", mask.cast("long").alias("mask"), F.array_join(masks.mask_words(mask, names), ",").alias("words")
    )


MASK_ROUND_TRIP = """
SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)::BIGINT AS mask,
  string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS words FROM lineitem GROUP BY 1
"""


def fold_best(spark: SparkSession, root: str) -> DataFrame:
    """Events folded into one record a user: the best event's fields, two
    fields filled by rank, a minimum, an OR, a sum and a set."""
    events = table(spark, root, "events").select(
        "user_id",
        "event_id",
        "ts",
        "event_type",
        F.when(F.col("value") > 150, F.col("value")).alias("high"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("failed"),
        (F.col("event_type") == "purchase").alias("bought"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    rank = F.struct((F.col("event_type") != "signup"), -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))
    folded = folding.fold_best(
        events.withColumns({"kinds": F.col("event_type"), "least": F.col("event_id"), "n": F.lit(1).cast("long")}),
        "user_id",
        rank,
        best=["event_id", "event_type"],
        fill=["high", "failed"],
        least=["least"],
        either=["bought"],
        total=["n", "k"],
        union=["kinds"],
    )
    return folded.withColumn("kinds", F.array_join("kinds", ","))


FOLD_BEST = """
WITH e AS (SELECT user_id, event_id, event_type, props, value,
  (event_type <> 'signup', -epoch_us(ts), event_id) AS rank FROM events)
SELECT user_id, arg_min(event_id, rank) AS event_id, arg_min(event_type, rank) AS event_type,
  arg_min(value, rank) FILTER (WHERE value > 150) AS high,
  arg_min(props, rank) FILTER (WHERE event_type = 'error') AS failed,
  min(event_id) AS least, bool_or(event_type = 'purchase') AS bought, count(*) AS n,
  sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
FROM e GROUP BY 1
"""


def first_release(spark: SparkSession, root: str) -> DataFrame:
    """Per customer, the earliest order and the fields of that very order."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    out = folding.at_first(orders, "o_custkey", "o_orderdate", ["o_orderkey", "o_orderstatus"])
    return out.withColumn("o_orderdate", _day("o_orderdate"))


FIRST_RELEASE = """
SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS o_orderdate,
  arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1
"""


def run_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Where each order's run of lines starts, runs laid end to end; the last
    run's end equals the lines there are."""
    line = table(spark, root, "lineitem").select("l_orderkey")
    runs = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    placed = ranking.run_offsets(runs, [F.asc("l_orderkey")], "lines")
    written = line.agg(F.count(F.lit(1)).alias("_all"))
    claimed = runs.agg(F.sum("lines").alias("_claimed"))
    whole = F.broadcast(written.join(F.broadcast(claimed)).select((F.col("_all") == F.col("_claimed")).alias("whole")))
    return placed.join(whole)


RUN_OFFSETS = """
WITH r AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT l_orderkey, lines, coalesce(sum(lines) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)::BIGINT AS start, (SELECT count(*) FROM lineitem) = (SELECT sum(lines) FROM r) AS whole FROM r
"""


def owner_of_position(spark: SparkSession, root: str) -> DataFrame:
    """Which order holds each position of the laid-out runs: the runs are
    expanded, not range-joined."""
    line = table(spark, root, "lineitem").select("l_orderkey")
    runs = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    placed = ranking.run_offsets(runs, [F.asc("l_orderkey")], "lines")
    return placed.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("position"), "l_orderkey")


OWNER_OF_POSITION = "SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS position, l_orderkey FROM lineitem"


def global_order(spark: SparkSession, root: str) -> DataFrame:
    """Every line's place in one total order over five keys."""
    line = table(spark, root, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    order = [
        F.asc("l_returnflag"), F.desc("l_shipdate"), F.desc("l_quantity"), F.asc("l_orderkey"),
        F.asc("l_linenumber"), F.asc("l_extendedprice"),
    ]
    return ranking.number_rows(line, order).select("seq", "l_orderkey", "l_linenumber", "l_extendedprice")


GLOBAL_ORDER = """
SELECT row_number() OVER (ORDER BY l_returnflag, l_shipdate DESC, l_quantity DESC, l_orderkey, l_linenumber,
  l_extendedprice) AS seq, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
"""


def first_seen_number(spark: SparkSession, root: str) -> DataFrame:
    """Document sources numbered by first appearance; languages follow on."""
    docs = table(spark, root, "documents").select("doc_id", "source", "lang")
    fronts = ranking.number_by_first_seen(docs, "source", ["doc_id"])
    start = docs.agg(F.count_distinct("source").alias("fronts"))
    backs = ranking.number_by_first_seen(docs.join(fronts, docs.lang == fronts.source, "left_anti"), "lang", ["doc_id"])
    after = backs.join(F.broadcast(start)).select(F.col("lang").alias("value"), (F.col("number") + F.col("fronts")).alias("number"))
    return fronts.select(F.col("source").alias("value"), "number").union(after)


FIRST_SEEN_NUMBER = """
WITH s AS (SELECT source AS value, row_number() OVER (ORDER BY min(doc_id)) - 1 AS number FROM documents GROUP BY 1),
l AS (SELECT lang AS value, row_number() OVER (ORDER BY min(doc_id)) - 1 + (SELECT count(*) FROM s) AS number
      FROM documents WHERE lang NOT IN (SELECT value FROM s) GROUP BY 1)
SELECT * FROM s UNION ALL SELECT * FROM l
"""


def best_per_group(spark: SparkSession, root: str) -> DataFrame:
    """The representative part of each brand: large before small, cheap first."""
    part = table(spark, root, "part").select("p_brand", "p_partkey", "p_type", "p_retailprice")
    order = [(F.col("p_type") != "LARGE").asc(), F.asc("p_retailprice"), F.asc("p_partkey")]
    return ranking.best_per_group(part, ["p_brand"], order)


BEST_PER_GROUP = """
SELECT p_brand, p_partkey, p_type, p_retailprice FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'LARGE', p_retailprice, p_partkey) = 1
"""


def stratified(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty documents of each language."""
    docs = table(spark, root, "documents").select("lang", "doc_id", "source")
    return ranking.best_per_group(docs, ["lang"], [F.asc("doc_id")], 20)


STRATIFIED = """
SELECT lang, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20
"""


def spread(spark: SparkSession, root: str) -> DataFrame:
    """Three documents for every value of every axis, seeded, no document twice."""
    axes = {"lang": F.col("lang"), "source": F.col("source"), "long": F.col("n_chars") > 5000}
    return measures.spread_sample(table(spark, root, "documents"), "doc_id", axes, 3, "7")


SPREAD = """
WITH m AS (SELECT doc_id, unnest(['lang', 'source', 'long']) AS axis,
                  unnest([lang, source, (n_chars > 5000)::VARCHAR]) AS value FROM documents),
k AS (SELECT doc_id FROM m QUALIFY row_number() OVER (PARTITION BY axis, value
        ORDER BY md5('7|' || axis || '|' || value || '|' || doc_id), doc_id) <= 3)
SELECT DISTINCT doc_id FROM k
"""


def grouped_totals(spark: SparkSession, root: str) -> DataFrame:
    """Copies by part, by (part, flag), by place (none is a place) and overall."""
    line = table(spark, root, "lineitem").select(
        "l_partkey",
        "l_returnflag",
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 20).alias("place"),
        F.col("l_quantity").cast("long").alias("copies"),
    )
    return measures.totals_by(line, [["l_partkey"], ["l_partkey", "l_returnflag"], ["place"], []], "copies")


GROUPED_TOTALS = """
WITH l AS (SELECT l_partkey, l_returnflag, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 20 END AS place,
             l_quantity::BIGINT AS copies FROM lineitem)
SELECT grouping_id(l_partkey, l_returnflag, place)::BIGINT AS level, l_partkey, l_returnflag, place,
  sum(copies)::BIGINT AS copies FROM l
GROUP BY GROUPING SETS ((l_partkey), (l_partkey, l_returnflag), (place), ())
"""


def worth_distinct(spark: SparkSession, root: str) -> DataFrame:
    """How complete the shelf of all lines is, by brand: parts held once
    each, flags held of them, against what exists."""
    line = table(spark, root, "lineitem").select("l_partkey", "l_returnflag")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return measures.completeness(line, part, "l_partkey", "p_brand", "l_returnflag")


WORTH_DISTINCT = """
WITH w AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT p_brand, count(*) AS exists, count(f) AS owned, coalesce(sum(f), 0)::BIGINT AS treatments
FROM part LEFT JOIN w ON l_partkey = p_partkey GROUP BY 1
"""


def gates(spark: SparkSession, root: str) -> DataFrame:
    """Ingest gates asked of each user's events as if each were a file."""
    events = table(spark, root, "events").select("user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    bad = F.col("value") < 1
    seen = {
        "view": F.count_if((F.col("event_type") == "view") & (F.col("k") < 40)),
        "high": F.count_if(F.col("value") > 200),
        "k": F.count_if(F.col("k").isNotNull()),
    }
    counted = events.groupBy("user_id").agg(
        F.count_if(~bad).alias("written"), F.count_if(bad).alias("skipped"), *[c.alias(f"s_{f}") for f, c in seen.items()]
    )
    cols = {f: F.col(f"s_{f}") for f in seen}
    before = F.when(F.col("user_id") % 2 == 0, F.lit(68))
    return counted.select(
        "user_id", "written", "skipped",
        folding.gate_outcome(F.col("written"), F.col("skipped"), before, cols).alias("outcome"),
        folding.missing_fields(cols).alias("missing"),
    )


GATES = """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE NOT value < 1) AS written, count(*) FILTER (WHERE value < 1) AS skipped,
  count(*) FILTER (WHERE event_type = 'view' AND json_extract_string(props, '$.k')::INT < 40) AS v,
  count(*) FILTER (WHERE value > 200) AS h, count(json_extract_string(props, '$.k')) AS k FROM events GROUP BY 1)
SELECT user_id, written, skipped, CASE WHEN written = 0 THEN 'empty'
  WHEN written + skipped >= 1000 AND skipped > (written + skipped) * 0.01 THEN 'skipped'
  WHEN user_id % 2 = 0 AND written < 68 * 0.95 THEN 'shrunk' WHEN v = 0 OR h = 0 OR k = 0 THEN 'shape' ELSE 'synced' END AS outcome,
  array_to_string(list_filter([CASE WHEN v = 0 THEN 'view' END, CASE WHEN h = 0 THEN 'high' END,
    CASE WHEN k = 0 THEN 'k' END], lambda x: x IS NOT NULL), ', ') AS missing FROM c
"""


def nearest_rank(spark: SparkSession, root: str) -> DataFrame:
    """Count, p50, p90, worst and rate of line prices by flag and in all, and p50 by status apart."""
    line = table(spark, root, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    cuts = line.withColumn("l_returnflag", F.explode(F.array("l_returnflag", F.lit(measures.ALL))))
    return measures.timing_summary(cuts, ["l_returnflag"], "l_extendedprice", F.col("l_linestatus") == "F")


NEAREST_RANK = """
WITH l AS (SELECT unnest([l_returnflag, '(all)']) AS l_returnflag, l_linestatus, l_extendedprice FROM lineitem)
SELECT l_returnflag, count(*) AS frames, max(l_extendedprice) AS worst, count(*) FILTER (WHERE l_linestatus = 'F') AS detected,
  round(1000.0 * count(*) / sum(l_extendedprice), 9) AS rate,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90,
  quantile_disc(l_extendedprice, 0.5) FILTER (WHERE l_linestatus = 'F') AS found
FROM l GROUP BY 1
"""


def upper_median(spark: SparkSession, root: str) -> DataFrame:
    """Per brand, the upper median and the range of price and size."""
    part = table(spark, root, "part").select("p_brand", "p_retailprice", "p_size")
    return measures.middles_and_ranges(part, "p_brand", {"price": "p_retailprice", "size": "p_size"})


UPPER_MEDIAN = """
WITH l AS (SELECT p_brand, list_sort(list(p_retailprice)) AS p, list_sort(list(p_size)) AS s FROM part GROUP BY 1)
SELECT p_brand, p[len(p) // 2 + 1] AS price, s[len(s) // 2 + 1] AS size,
  round(p[-1] - p[1], 4) AS price_range, (s[-1] - s[1])::DOUBLE AS size_range FROM l
"""


def digest(spark: SparkSession, root: str) -> DataFrame:
    """Order-free digests of a conversation's turns by role, each role a part of
    it, with a key of both hashes and a receipt that covers its moment."""
    turns = table(spark, root, "conversations").select(
        "conv_id", "role", F.concat(F.length("text").cast("string"), F.lit("\t"), F.col("role"), F.lit("\t"), F.col("text")).alias("line")
    )
    return measures.part_keys(turns, "conv_id", "role", "line").withColumn("stamped", measures.stamped(F.col("digest"), "2026-01-01T00:00:00.000Z"))


DIGEST = r"""
WITH l AS (SELECT conv_id, role, length(text) || chr(9) || role || chr(9) || text AS line FROM conversations),
p AS (SELECT conv_id, role, 'sha256-' || sha256(string_agg(line, chr(10) ORDER BY encode(line))) AS digest FROM l GROUP BY 1, 2),
w AS (SELECT conv_id, 'sha256-' || sha256(string_agg(line, chr(10) ORDER BY encode(line))) AS whole FROM l GROUP BY 1)
SELECT conv_id, role, digest, substr(whole, 8, 16) || '-' || substr(digest, 8, 16) AS part_key,
  'sha256-' || sha256('2026-01-01T00:00:00.000Z' || digest) AS stamped FROM p JOIN w USING (conv_id)
"""


def child_masks(spark: SparkSession, root: str) -> DataFrame:
    """Per customer, its orders' statuses and priorities as masks, with sizes."""
    bits = {
        "statuses": F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4),
        "levels": F.call_function("shiftleft", F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int")),
    }
    return measures.masks_of_children(table(spark, root, "orders"), "o_custkey", bits, "orders")


CHILD_MASKS = """
WITH m AS (SELECT o_custkey, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::BIGINT AS statuses,
  bit_or(1 << substr(o_orderpriority, 1, 1)::INT)::BIGINT AS levels, count(*) AS orders FROM orders GROUP BY 1)
SELECT *, bit_count(levels)::BIGINT AS levels_held, bit_count(statuses)::BIGINT AS statuses_held FROM m
"""


def subtypes(spark: SparkSession, root: str) -> DataFrame:
    """Distinct words after the dash of a type line, either side of it, counted."""
    line = F.concat(F.col("p_type"), F.lit(" — "), F.col("p_name"), F.lit(" // Back — "), F.col("p_brand"))
    return measures.words_after(table(spark, root, "part"), line)


SUBTYPES = """
WITH w AS (SELECT unnest(string_split(p_name || ' ' || p_brand, ' ')) AS word FROM part)
SELECT word, count(*) AS uses FROM w GROUP BY 1
"""


def tag_tally(spark: SparkSession, root: str) -> DataFrame:
    """Events tallied under each of their tags and under all of them."""
    events = table(spark, root, "events").select(
        "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id"
    )
    tags = F.array("event_type", F.concat(F.lit("h"), F.hour("ts").cast("string")))
    return measures.tally(events, tags, F.col("k") < 20, {"median": "value", "candidates": "user_id", "distance": "k"})


TAG_TALLY = """
WITH t AS (SELECT unnest(['(all)', event_type, 'h' || hour(ts)]) AS tag, value, user_id, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT tag, count(*) AS shots, round(count(*) FILTER (WHERE k < 20) / count(*), 9) AS hit_rate,
  list_sort(list(value) FILTER (WHERE value IS NOT NULL))[count(value) // 2 + 1] AS median, list_sort(list(user_id) FILTER (WHERE user_id IS NOT NULL))[count(user_id) // 2 + 1] AS candidates,
  list_sort(list(k) FILTER (WHERE k IS NOT NULL))[count(k) // 2 + 1] AS distance FROM t GROUP BY 1
"""


def threshold_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Why suppliers and customers are refused under each swept threshold.

    The thresholds are a handful of literals laid on each row and counted in
    the same stage, so nothing is joined.
    """
    held = (
        table(spark, root, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
        .unionByName(table(spark, root, "customer").select(F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation")))
    )

    def reason(low: float, nation: int) -> Column:
        return F.when(F.col("bal").isNull(), "unread").when(F.col("bal") < low, "balance").when(F.col("nation") >= nation, "nation").otherwise("kept")

    swept = [("balance", float(v), reason(v, 20)) for v in (0, 500, 1000, 2000, 5000)]
    swept += [("nation", float(v), reason(1000, v)) for v in (5, 10, 15, 20, 25)]
    return measures.sweep(held, swept)


THRESHOLD_SWEEP = """
WITH h AS (SELECT s_acctbal AS bal, s_nationkey AS nation FROM supplier UNION ALL SELECT c_acctbal, c_nationkey FROM customer),
s AS (SELECT 'balance' AS name, v::DOUBLE AS value, v AS low, 20 AS nat FROM (SELECT unnest([0, 500, 1000, 2000, 5000]) AS v)
      UNION ALL SELECT 'nation', v, 1000, v FROM (SELECT unnest([5, 10, 15, 20, 25]) AS v))
SELECT name, value, CASE WHEN bal IS NULL THEN 'unread' WHEN bal < low THEN 'balance' WHEN nation >= nat THEN 'nation'
  ELSE 'kept' END AS reason, count(*) AS n FROM h CROSS JOIN s GROUP BY 1, 2, 3
"""


def content_name(spark: SparkSession, root: str) -> DataFrame:
    """Two partitionings of the parts come to one content name, and other parts to another."""
    part = table(spark, root, "part")
    ways = {"as read": part, "by brand": part.repartition(7, "p_brand"), "dearer": part.withColumn("p_retailprice", F.col("p_retailprice") + 1)}
    named = [folding.table_fingerprint(df).withColumn("way", F.lit(way)) for way, df in ways.items()]
    first = named[0].select(F.col("hash").alias("_first"))
    both = named[0].unionByName(named[1]).unionByName(named[2])
    return both.join(F.broadcast(first)).select("way", "rows", (F.col("hash") == F.col("_first")).alias("equal"))


CONTENT_NAME = """
SELECT unnest(['as read', 'by brand', 'dearer']) AS way, (SELECT count(*) FROM part) AS rows, unnest([true, true, false]) AS equal
"""


QUERIES = {
    "decode_dictionary": (decode_dictionary, DECODE_DICTIONARY),
    "array_dictionary": (array_dictionary, ARRAY_DICTIONARY),
    "mask_round_trip": (mask_round_trip, MASK_ROUND_TRIP),
    "fold_best": (fold_best, FOLD_BEST),
    "first_release": (first_release, FIRST_RELEASE),
    "run_offsets": (run_offsets, RUN_OFFSETS),
    "owner_of_position": (owner_of_position, OWNER_OF_POSITION),
    "global_order": (global_order, GLOBAL_ORDER),
    "first_seen_number": (first_seen_number, FIRST_SEEN_NUMBER),
    "best_per_group": (best_per_group, BEST_PER_GROUP),
    "stratified": (stratified, STRATIFIED),
    "spread": (spread, SPREAD),
    "grouped_totals": (grouped_totals, GROUPED_TOTALS),
    "worth_distinct": (worth_distinct, WORTH_DISTINCT),
    "gates": (gates, GATES),
    "nearest_rank": (nearest_rank, NEAREST_RANK),
    "upper_median": (upper_median, UPPER_MEDIAN),
    "digest": (digest, DIGEST),
    "child_masks": (child_masks, CHILD_MASKS),
    "subtypes": (subtypes, SUBTYPES),
    "tag_tally": (tag_tally, TAG_TALLY),
    "threshold_sweep": (threshold_sweep, THRESHOLD_SWEEP),
    "content_name": (content_name, CONTENT_NAME),
}
