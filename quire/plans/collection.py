"""The stack algebra on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import iso_text
from ..operators import ranking, stacks
from .tables import spread_table, table


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines as stacks of copies: identity by part, flag, status and ship place."""
    line = spread_table(
        spark, root, "lineitem",
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate", "l_suppkey",
    )
    nothing = F.lit(None).cast("string")
    return line.withColumns(
        {
            "identity": stacks.stack_identity(
                F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), nothing, F.lit(False), F.lit(None).cast("array<string>"), nothing
            ),
            "at": F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate"),
            "quantity": F.col("l_quantity").cast("long"),
        }
    )


IDENTITY_SQL = """'["' || l_partkey || '","' || l_returnflag || '","' || l_linestatus || '",null,false,[],null]'"""


def collapse_identity(spark: SparkSession, root: str) -> DataFrame:
    """Lines collapsed to one stack an identity, histories joined by date."""
    moment = iso_text(F.col("l_shipdate").cast("timestamp"))
    rows = _lines(spark, root).withColumns(
        {
            "lots": F.array(F.struct(F.col("quantity"), moment.alias("at"), F.col("l_extendedprice").cast("string").alias("price"))),
            "created": moment,
        }
    )
    made = stacks.collapse(rows, "identity", "at", created="created")
    text = F.array_join(F.transform("lots", lambda lot: F.concat(F.substring(lot["at"], 1, 10), F.lit(":"), lot["quantity"].cast("string"))), " ")
    return made.select("identity", "bin", "quantity", "merged", F.substring("created", 1, 10).alias("created"), text.alias("history"))


COLLAPSE_IDENTITY = f"""
SELECT {IDENTITY_SQL} AS identity, 0::BIGINT AS bin, sum(l_quantity)::BIGINT AS quantity, count(*) AS merged,
  strftime(min(l_shipdate), '%Y-%m-%d') AS created,
  string_agg(strftime(l_shipdate, '%Y-%m-%d') || ':' || l_quantity::BIGINT, ' '
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey) AS history
FROM lineitem GROUP BY 1
"""


def first_fit(spark: SparkSession, root: str) -> DataFrame:
    """The same rows under ceilings of 100 copies and 4 lots, so most
    identities need several stacks."""
    rows = _lines(spark, root).withColumn("lots", F.array(F.struct("quantity", F.lit(None).cast("string").alias("at"))))
    made = stacks.collapse(rows, "identity", "at", copies=100, max_lots=4)
    return made.select("identity", "bin", "quantity", "merged")


FIRST_FIT = f"""
WITH RECURSIVE r AS (SELECT {IDENTITY_SQL} AS identity, l_quantity::BIGINT AS q, row_number() OVER (
    PARTITION BY l_partkey, l_returnflag, l_linestatus
    ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_shipdate) AS n FROM lineitem),
f AS (SELECT identity, 1::BIGINT AS n, [q] AS loads, [1::BIGINT] AS lots, 1::BIGINT AS bin, q FROM r WHERE n = 1
  UNION ALL
  SELECT identity, n, CASE WHEN spot IS NULL THEN list_append(loads, q)
      ELSE list_transform(loads, lambda x, i: CASE WHEN i = spot THEN x + q ELSE x END) END,
    CASE WHEN spot IS NULL THEN list_append(lots, 1)
      ELSE list_transform(lots, lambda x, i: CASE WHEN i = spot THEN x + 1 ELSE x END) END,
    coalesce(spot, len(loads) + 1), q
  FROM (SELECT f.identity, r.n, f.loads, f.lots, r.q, nullif(coalesce(list_position(list_transform(f.loads,
      lambda x, i: x + r.q <= 100 AND f.lots[i] + 1 <= 4), true), 0), 0)::BIGINT AS spot
    FROM f JOIN r ON r.identity = f.identity AND r.n = f.n + 1))
SELECT identity, bin - 1 AS bin, sum(q)::BIGINT AS quantity, count(*) AS merged FROM f GROUP BY 1, 2
"""


def _conversation_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "conversations").select("conv_id", "turn", F.length("text").alias("size"))


def pack_parts(spark: SparkSession, root: str) -> DataFrame:
    """Turns packed into parts of at most three, or about 900 characters."""
    return stacks.pack_parts(_conversation_rows(spark, root), "conv_id", "turn", F.col("size"), entries=3, chars=900)


PACK_PARTS = """
WITH RECURSIVE r AS (SELECT conv_id, turn, length(text)::INT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations),
f AS (SELECT conv_id, turn, size, n, 0::BIGINT AS part, 1 AS held, size AS chars FROM r WHERE n = 1
  UNION ALL
  SELECT r.conv_id, r.turn, r.size, r.n,
    CASE WHEN held >= 3 OR chars + r.size > 900 THEN part + 1 ELSE part END,
    CASE WHEN held >= 3 OR chars + r.size > 900 THEN 1 ELSE held + 1 END,
    CASE WHEN held >= 3 OR chars + r.size > 900 THEN r.size ELSE chars + r.size END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn, size, part FROM f
"""


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Held: finished lines collapsed by part and flag. Imported: open lines."""
    line = table(spark, root, "lineitem").select(
        F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("identity"),
        F.col("l_quantity").cast("long").alias("quantity"),
        "l_linestatus", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate",
    )
    held = line.filter(F.col("l_linestatus") == "F").groupBy("identity").agg(
        F.sum("quantity").alias("quantity"), F.min("l_orderkey").alias("held_id_n"), F.min("l_partkey").alias("at")
    )
    held = held.select("identity", "quantity", F.concat(F.lit("rec-"), "identity").alias("held_id"), "at")
    imported = line.filter(F.col("l_linestatus") == "O").withColumn(
        "key", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate")
    )
    placed = ranking.ranked(imported, ["identity"], [F.asc("key")], "at")
    return held, placed.select("identity", "quantity", "at")


SIDES_SQL = """
h AS (SELECT l_partkey || '/' || l_returnflag AS identity, sum(l_quantity)::BIGINT AS q FROM lineitem
      WHERE l_linestatus = 'F' GROUP BY 1),
i AS (SELECT l_partkey || '/' || l_returnflag AS identity, l_quantity::BIGINT AS q, row_number() OVER (
        PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_shipdate) AS n
      FROM lineitem WHERE l_linestatus = 'O')"""


def reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Open lines against held stacks: which records change, and by how much."""
    held, imported = _sides(spark, root)
    return stacks.reconcile(imported, held, "identity", "at").select("identity", "held_id", "before", "after", "rows")


RECONCILE = f"""
WITH {SIDES_SQL}
SELECT identity, CASE WHEN max(h.q) IS NOT NULL THEN 'rec-' || identity END AS held_id, coalesce(max(h.q), 0)::BIGINT AS before,
  (coalesce(max(h.q), 0) + sum(i.q))::BIGINT AS after, count(*) AS rows FROM i LEFT JOIN h USING (identity) GROUP BY 1
"""


def reconcile_weight(spark: SparkSession, root: str) -> DataFrame:
    """The same plan in six numbers."""
    held, imported = _sides(spark, root)
    return stacks.weigh(stacks.reconcile(imported, held, "identity", "at"), held)


RECONCILE_WEIGHT = f"""
WITH {SIDES_SQL}, s AS (SELECT identity, sum(q) AS q FROM i GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (WHERE h.q IS NULL) AS fresh, count(*) FILTER (WHERE h.q IS NOT NULL) AS joined,
  sum(s.q)::BIGINT AS adding, (SELECT sum(q) FROM h)::BIGINT AS before, ((SELECT sum(q) FROM h) + sum(s.q))::BIGINT AS after
FROM s LEFT JOIN h USING (identity)
"""


def landing(spark: SparkSession, root: str) -> DataFrame:
    """Held stacks with waiting copies laid over them under a ceiling of 200."""
    held, imported = _sides(spark, root)
    shelf = stacks.landing(held, imported, "identity", "at", copies=200)
    return shelf


LANDING = f"""
WITH RECURSIVE {SIDES_SQL}, g AS (SELECT * FROM h),
f AS (SELECT identity, i.n, i.q, g.q AS written, coalesce(g.q, 0) AS base,
        CASE WHEN g.q IS NULL OR g.q + i.q <= 200 THEN i.q ELSE 0 END AS waiting, g.q IS NOT NULL AND g.q + i.q > 200 AS alone
      FROM i LEFT JOIN g USING (identity) WHERE i.n = 1
  UNION ALL
  SELECT f.identity, i.n, i.q, f.written, f.base, CASE WHEN f.base + f.waiting + i.q <= 200 THEN f.waiting + i.q ELSE f.waiting END,
    f.base + f.waiting + i.q > 200 FROM f JOIN i ON i.identity = f.identity AND i.n = f.n + 1)
SELECT identity, CASE WHEN max(written) IS NOT NULL THEN 'rec-' || identity END AS held_id, coalesce(max(written), 0)::BIGINT AS written,
  max(waiting)::BIGINT AS waiting FROM f GROUP BY 1
UNION ALL SELECT identity, NULL, 0, q FROM f WHERE alone
UNION ALL SELECT identity, 'rec-' || identity, q, 0 FROM g WHERE identity NOT IN (SELECT identity FROM i)
"""


def spend_lots(spark: SparkSession, root: str) -> DataFrame:
    """Each order's copies spent on its lines in date order: what each line
    gives, then a row for what no line covers; lines past the end say so."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_suppkey", "l_quantity")
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 4000).alias("copies")
    )
    order = [F.asc("l_shipdate"), F.asc("l_linenumber"), F.asc("l_extendedprice"), F.asc("l_suppkey")]
    lots = line.withColumn("half", F.col("l_quantity") * 0.75).join(orders, "l_orderkey")
    spent = stacks.allocate(lots, ["l_orderkey"], order, "half", "copies")
    given = spent.filter(F.floor("half") >= 1).select(
        "l_orderkey", "l_extendedprice", F.col("take").alias("quantity"), (F.col("take") == 0).alias("unspent")
    )
    sums = spent.groupBy("l_orderkey").agg(F.sum("take").alias("taken"), F.max("copies").alias("copies"))
    rest = sums.filter(F.col("copies") > F.col("taken")).select(
        "l_orderkey", F.lit(None).cast("double"), (F.col("copies") - F.col("taken")).cast("long"), F.lit(False)
    )
    return given.union(rest)


SPEND_LOTS = """
WITH l AS (SELECT l_orderkey, l_extendedprice, floor(l_quantity * 0.75)::BIGINT AS q, floor(o_totalprice / 4000)::BIGINT AS c,
  coalesce(sum(floor(l_quantity * 0.75)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT *, greatest(0, least(q, c - b))::BIGINT AS take FROM l)
SELECT l_orderkey, l_extendedprice, take AS quantity, take = 0 AS unspent FROM t WHERE q >= 1
UNION ALL SELECT l_orderkey, NULL, (max(c) - sum(take))::BIGINT, false FROM t GROUP BY 1 HAVING max(c) > sum(take)
"""


def consume_waiting(spark: SparkSession, root: str) -> DataFrame:
    """Sixty copies of each part taken out of waiting orders, oldest first:
    what is left of each entry, emptied ones gone."""
    line = table(spark, root, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity")
    )
    order = [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice"), F.asc("l_suppkey")]
    spent = stacks.allocate(line.withColumn("copies", F.lit(60)), ["l_partkey"], order, "quantity", "copies")
    left = spent.withColumn("left", F.col("quantity") - F.col("take"))
    per_order = left.groupBy("l_orderkey").agg(
        F.count_if(F.col("left") > 0).alias("entries"), F.sum("left").alias("copies"), F.bool_or(F.col("take") > 0).alias("touched")
    )
    return per_order.select(
        "l_orderkey", "entries", "copies",
        F.when(~F.col("touched"), "kept").when(F.col("entries") == 0, "delete").otherwise("update").alias("action"),
    )


CONSUME_WAITING = """
WITH l AS (SELECT l_partkey, l_orderkey, l_quantity::BIGINT AS q, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_partkey
    ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM lineitem),
t AS (SELECT *, greatest(0, least(q, 60 - b))::BIGINT AS take FROM l)
SELECT l_orderkey, count(*) FILTER (WHERE q > take) AS entries, sum(q - take)::BIGINT AS copies,
  CASE WHEN NOT bool_or(take > 0) THEN 'kept' WHEN count(*) FILTER (WHERE q > take) = 0 THEN 'delete' ELSE 'update' END AS action
FROM t GROUP BY 1
"""


def _waiting(spark: SparkSession, root: str) -> DataFrame:
    """Orders as waiting parts of imports, their lines as entries."""
    line = table(spark, root, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    entry = F.struct(
        "position", F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("identity"),
        F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linestatus").alias("note"),
    )
    return line.withColumn("position", F.row_number().over(w).cast("long")).groupBy(F.col("l_orderkey").cast("string").alias("part_key")).agg(
        F.concat(F.lit("d"), F.first(F.col("l_orderkey") % 50).cast("string")).alias("digest"), F.array_sort(F.collect_list(entry)).alias("entries")
    )


def take_back(spark: SparkSession, root: str) -> DataFrame:
    """Thirty copies of every third part taken back out of the parts that
    wait, one in ten being drained already: what each touched part becomes."""
    parts = _waiting(spark, root)
    wanted = table(spark, root, "lineitem").filter("l_partkey % 3 = 0").select(
        F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("identity")
    ).distinct().withColumn("copies", F.lit(30))
    done = parts.filter(F.col("part_key").cast("long") % 10 == 3)
    found = stacks.take_back(parts, wanted, done=done)
    text = F.transform("entries", lambda e: F.concat_ws(" ", e["position"], e["identity"], e["quantity"], e["note"]))
    return found.select("part_key", "action", "taken", F.array_join(text, ", ").alias("entries"))


_WAITING_SQL = """
l AS (SELECT l_orderkey, l_orderkey::VARCHAR AS part_key, 'd' || (l_orderkey % 50) AS digest, l_partkey, l_partkey || '/' || l_returnflag AS identity, l_quantity::BIGINT AS q, l_linestatus AS note,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem)"""
TAKE_BACK = f"""
WITH {_WAITING_SQL}, b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY identity ORDER BY part_key, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM l WHERE l_orderkey % 10 <> 3),
t AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN greatest(0, least(q, 30 - before)) ELSE 0 END::BIGINT AS take FROM b)
SELECT part_key, CASE WHEN bool_or(q > take) THEN 'update' ELSE 'delete' END AS action, sum(take)::BIGINT AS taken,
  coalesce(string_agg(position || ' ' || identity || ' ' || (q - take) || ' ' || note, ', ' ORDER BY position) FILTER (WHERE q > take), '') AS entries
FROM t GROUP BY 1 HAVING sum(take) > 0
"""


def owed(spark: SparkSession, root: str) -> DataFrame:
    """What every import still has waiting while two thirds of its parts are drained."""
    parts = _waiting(spark, root)
    return stacks.owed(parts, parts.filter(F.col("part_key").cast("long") % 3 > 0))


OWED = f"""
WITH {_WAITING_SQL}
SELECT digest, count(DISTINCT part_key) AS parts, count(*) AS entries, sum(q)::BIGINT AS copies FROM l WHERE l_orderkey % 3 = 0 GROUP BY 1
"""


def overlay_latest(spark: SparkSession, root: str) -> DataFrame:
    """Users' first view or click with all their other kinds of events laid over it, the newest winning."""
    events = table(spark, root, "events").select("user_id", "event_id", "event_type", "value")
    base = ranking.best_per_group(events.filter(F.col("event_type").isin("view", "click")), ["user_id"], [F.asc("event_id")])
    newer = events.filter(~F.col("event_type").isin("view", "click"))
    return stacks.overlay_latest(base, newer, "user_id", "event_id")


OVERLAY_LATEST = """
WITH b AS (SELECT *, 0 AS v FROM events WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
n AS (SELECT *, 1 AS v FROM events WHERE event_type NOT IN ('view', 'click')), u AS (SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT user_id, event_id, event_type, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id DESC) = 1
"""


def then_changes(spark: SparkSession, root: str) -> DataFrame:
    """Two rounds of changes to parts: the lines up to 1995, then all later ones."""
    line = table(spark, root, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")

    def change(late: bool) -> DataFrame:
        rows = line.filter((F.year("l_shipdate") > 1995) == late)
        last = ranking.best_per_group(
            rows, ["l_partkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice"), F.desc("l_suppkey")]
        )
        return last.select("l_partkey", (F.col("l_returnflag") == "R").alias("gone"), F.col("l_extendedprice").alias("price"))

    return stacks.then_changes(change(False), change(True), "l_partkey", "gone")


THEN_CHANGES = """
WITH c AS (SELECT l_partkey, (year(l_shipdate) > 1995)::INT AS y, l_returnflag = 'R' AS gone, l_extendedprice AS price FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) > 1995
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC) = 1),
g AS (SELECT l_partkey, max(CASE WHEN NOT gone THEN y END) AS wy, arg_max(price, y) FILTER (WHERE NOT gone) AS price,
  max(CASE WHEN gone THEN y END) AS gy FROM c GROUP BY 1)
SELECT l_partkey, wy IS NOT NULL AND coalesce(gy, 0) <> 1 AS written, gy IS NOT NULL AS dropped,
  CASE WHEN wy IS NOT NULL AND coalesce(gy, 0) <> 1 THEN price END AS price FROM g
"""


def merge_fields(spark: SparkSession, root: str) -> DataFrame:
    """Per user: earliest and latest moments kept as text, distinct sorted tags."""
    from ..functions.values import clean_tags, earlier, later

    events = table(spark, root, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    folded = events.groupBy("user_id").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("event_type").alias("tags")
    )
    zone = F.concat("first", F.lit("+01:00"))
    return folded.select(
        "user_id",
        earlier(F.concat("first", F.lit("Z")), zone).alias("earliest"),
        later(F.concat("last", F.lit("Z")), F.lit(None).cast("string")).alias("latest"),
        F.array_join(clean_tags(F.concat("tags", F.array(F.lit("view")))), ",").alias("tags"),
    )


MERGE_FIELDS = """
SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+01:00' AS earliest, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS latest,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM (SELECT user_id, ts, event_type FROM events
  UNION ALL SELECT user_id, min(ts), 'view' FROM events GROUP BY 1) GROUP BY 1
"""


QUERIES = {
    "collapse_identity": (collapse_identity, COLLAPSE_IDENTITY),
    "first_fit": (first_fit, FIRST_FIT),
    "pack_parts": (pack_parts, PACK_PARTS),
    "reconcile": (reconcile, RECONCILE),
    "reconcile_weight": (reconcile_weight, RECONCILE_WEIGHT),
    "landing": (landing, LANDING),
    "spend_lots": (spend_lots, SPEND_LOTS),
    "consume_waiting": (consume_waiting, CONSUME_WAITING),
    "take_back": (take_back, TAKE_BACK),
    "owed": (owed, OWED),
    "overlay_latest": (overlay_latest, OVERLAY_LATEST),
    "then_changes": (then_changes, THEN_CHANGES),
    "merge_fields": (merge_fields, MERGE_FIELDS),
}
