"""Incremental jobs over files Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import folding, similarity, stacks
from ..session import fresh_path
from ..streaming import backfill, drain, edits, refresh
from .tables import table


#: Event types in the order they arrive as versions; the second comes twice and the last is followed by an empty one.
STEPS = [("click", "v1"), ("view", "v2"), ("signup", "v3"), ("error", "v4"), ("purchase", "v5")]


def stream_replace(spark: SparkSession, root: str) -> DataFrame:
    """Event types as bulk versions, in turn: each passes the gates and
    replaces the table, or is refused. The table's users and the history."""
    events = table(spark, root, "events").select("event_id", "user_id", "event_type", "value")
    base = fresh_path(spark, "refresh")
    steps = [*STEPS[:2], STEPS[1], *STEPS[2:], (None, "v6")]
    for n, (kind, version) in enumerate(steps):
        part = events.filter(F.col("event_type") == kind) if kind else events.limit(0)
        part.write.parquet(f"{base}/data/{n}")
        refresh.notify(spark, f"{base}/landing", "bulk", version, f"{base}/data/{n}", n)

    def ingest(data: DataFrame, before: int | None):
        counted = data.agg(
            F.count_if(F.col("value") >= 0.5).alias("written"), F.count_if(F.col("value") < 0.5).alias("skipped"), F.count_if(F.col("user_id") >= 0).alias("s")
        )
        outcome = folding.gate_outcome(F.col("written"), F.col("skipped"), F.lit(before).cast("long"), {"user": F.col("s")})
        report = counted.withColumn("outcome", outcome).first().asDict()
        return data.filter(F.col("value") >= 0.5), report

    refresh.refresh_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", ingest)
    rows = refresh.published(spark, f"{base}/table", "bulk").groupBy(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("what")).agg(
        F.count(F.lit(1)).alias("n")
    )
    history = refresh.read_batches(spark, f"{base}/table/history", refresh.HISTORY)
    return rows.union(history.select(F.concat_ws(" ", F.col("version"), F.col("outcome")), F.col("written")))


def _step_sql(i: int, kind: str) -> str:
    """Outcome ``o``, rows ``w`` and, after it, the version that stands (``t``) and its rows (``b``)."""
    return f"""
s{i} AS (SELECT *, CASE WHEN o{i} = 'synced' THEN w{i} ELSE b{i - 1} END AS b{i}, CASE WHEN o{i} = 'synced' THEN '{kind}' ELSE t{i - 1} END AS t{i}
  FROM (SELECT *, CASE WHEN n{i} >= 1000 AND n{i} - w{i} > n{i} * 0.01 THEN 'skipped' WHEN w{i} < b{i - 1} * 0.95 THEN 'shrunk' ELSE 'synced' END AS o{i}
    FROM (SELECT *, (SELECT count(*) FROM events WHERE event_type = '{kind}') AS n{i},
      (SELECT count(*) FROM events WHERE event_type = '{kind}' AND value >= 0.5) AS w{i} FROM s{i - 1})))"""


STREAM_REPLACE = f"""
WITH s0 AS (SELECT NULL::BIGINT AS b0, NULL::VARCHAR AS t0),{",".join(_step_sql(i, kind) for i, (kind, _) in enumerate(STEPS, 1))}
SELECT 'user ' || user_id AS what, count(*) AS n FROM events, s{len(STEPS)} WHERE event_type = t{len(STEPS)} AND value >= 0.5 GROUP BY 1
{" ".join(f"UNION ALL SELECT '{version} ' || o{i}, w{i} FROM s{len(STEPS)}" for i, (_, version) in enumerate(STEPS, 1))}
UNION ALL SELECT 'v2 ' || o2, w2 FROM s{len(STEPS)} WHERE o2 <> 'synced' UNION ALL SELECT 'v6 empty', 0
"""


def _parts(spark: SparkSession, root: str) -> DataFrame:
    """Open lines as parts of imports: a part an order, an import a supplier."""
    line = table(spark, root, "lineitem")
    key = F.sha2(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), 256)
    return line.select(
        F.col("l_orderkey").cast("string").alias("part_key"),
        F.concat(F.lit("d"), (F.col("l_orderkey") % 50).cast("string")).alias("digest"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint").alias("position"),
        F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("identity"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (F.col("l_linenumber") % 3).cast("long").alias("lots"),
    )


def _packed(entries: DataFrame) -> DataFrame:
    """One row a part: an order's lines."""
    return entries.groupBy("part_key", "digest").agg(F.collect_list(F.struct("position", "identity", "quantity", "lots")).alias("entries"))


#: Lines of parts a landed file holds about, so none grows with the input.
_LANDED = 500_000


def _share(lines: DataFrame) -> int:
    """How many times more files there are to land than of a short table."""
    return 1 + lines.count() // (2 * _LANDED)


def stream_drain(spark: SparkSession, root: str) -> DataFrame:
    """Parts landing as files, some sent twice and one import given up, drained
    in micro-batches and then all sent again: every copy once."""
    lines = _parts(spark, root)
    parts, n = _packed(lines), _share(lines)
    base = fresh_path(spark, "drain")
    parts.repartition(8 * n, "part_key").write.parquet(f"{base}/landing")
    parts.filter(F.size("entries") > 1).repartition(2 * n).write.mode("append").parquet(f"{base}/landing")
    cancelled = spark.createDataFrame([("d7",)], "digest string")
    drain.drain_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", files=5 * n, cancelled=cancelled)
    parts.repartition(3 * n).write.mode("append").parquet(f"{base}/landing")
    drain.drain_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", files=5 * n, cancelled=cancelled)
    return drain.collection(spark, f"{base}/table").groupBy("identity").agg(F.sum("quantity").alias("quantity"))


STREAM_DRAIN = """
SELECT l_partkey || '/' || l_returnflag AS identity, sum(l_quantity)::BIGINT AS quantity FROM lineitem
WHERE l_orderkey % 50 <> 7 GROUP BY 1
"""


def live_totals(spark: SparkSession, root: str) -> DataFrame:
    """Copies an import has written and has waiting while half its parts are
    drained, from a running stream total."""
    parts = _parts(spark, root)
    base = fresh_path(spark, "totals")
    n = _share(parts)
    _packed(parts.filter(F.col("quantity") <= 30)).repartition(6 * n).write.parquet(f"{base}/landing")
    done = drain.totals_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", "digest", files=3 * n)
    waiting = parts.filter(F.col("quantity") > 30).select("digest", "quantity")
    return drain.live_totals(done, waiting, "digest")


LIVE_TOTALS = """
SELECT 'd' || (l_orderkey % 50) AS digest, sum(CASE WHEN l_quantity <= 30 THEN l_quantity ELSE 0 END)::BIGINT AS written,
  sum(CASE WHEN l_quantity > 30 THEN l_quantity ELSE 0 END)::BIGINT AS waiting, sum(l_quantity)::BIGINT AS total
FROM lineitem GROUP BY 1
"""


def amend_log(spark: SparkSession, root: str) -> DataFrame:
    """Events as edits of one entry a user and hour of day, in two deliveries:
    counts go up, down and are set; an entry that reaches zero stays gone."""
    events = table(spark, root, "events")
    op = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("plus")).when(F.col("event_type") == "error", "minus")
        .when(F.col("event_type") == "purchase", F.when(F.col("value") > 60, "counted").otherwise("regraded")).otherwise("add")
    )
    log = events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("entry"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.when(F.col("value") > 60, F.floor(F.col("value") / 60).cast("string")).otherwise(F.get_json_object("props", "$.k")).alias("value"),
        "ts",
    )
    base = fresh_path(spark, "edits")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    log.filter(half).drop("ts").write.parquet(f"{base}/landing")
    edits.edit_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint")
    log.filter(~half).drop("ts").write.mode("append").parquet(f"{base}/landing")
    held = edits.edit_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint")
    return held.select("entry", "quantity", "condition")


AMEND_LOG = """
WITH RECURSIVE e AS (SELECT user_id || '/' || hour(ts) AS entry, CASE WHEN event_type IN ('click', 'view') THEN 'plus' WHEN event_type = 'error' THEN 'minus'
    WHEN event_type = 'purchase' THEN CASE WHEN value > 60 THEN 'counted' ELSE 'regraded' END ELSE 'add' END AS op,
  floor(value / 60)::BIGINT AS n, json_extract_string(props, '$.k') AS k,
  row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id) AS i FROM events),
f AS (SELECT entry, 0::BIGINT AS i, 0::BIGINT AS q, false AS gone, '' AS condition FROM (SELECT DISTINCT entry FROM e)
  UNION ALL
  SELECT f.entry, e.i, CASE WHEN gone THEN 0 WHEN op = 'add' THEN greatest(q, 1) WHEN q < 1 THEN 0 WHEN op = 'plus' THEN least(q + 1, 10000)
      WHEN op = 'minus' THEN q - 1 WHEN op = 'counted' THEN greatest(1, n) ELSE q END,
    gone OR (op = 'minus' AND q = 1), CASE WHEN op = 'regraded' AND NOT gone AND q > 0 THEN k ELSE condition END
  FROM f JOIN e ON e.entry = f.entry AND e.i = f.i + 1)
SELECT entry, arg_max(q, i) AS quantity, arg_max(condition, i) AS condition FROM f GROUP BY 1 HAVING arg_max(q, i) > 0
"""


def _made() -> Column:
    """What a printing was made in, by its number; every sixth is not known at all."""
    ways = [["nonfoil", "foil"], ["foil"], ["etched", "foil"], ["nonfoil", "foil", "etched"], []]
    return F.element_at(F.array(*[F.array(*map(F.lit, w)).cast("array<string>") for w in ways]), (F.col("p_partkey") % 6 + 1).cast("int"))


def list_moves(spark: SparkSession, root: str) -> DataFrame:
    """Events as all eleven moves on one list entry a user and hour of day, in
    two deliveries: printings are chosen among the parts, which settle and
    limit the finish."""
    n = F.col("event_id")
    ops = ["add", "add", "plus", "minus", "counted", "choose", "refinish", "cycled", "regraded", "dropping", "reported", "drop"]
    op = F.element_at(F.array(*map(F.lit, ops)), (n % 12 + 1).cast("int"))
    op = F.when((op == "drop") & (n % 5 > 0), "plus").otherwise(op)

    def named(by: int):
        return F.concat(F.lit("p"), (n * by % 40).cast("string"))

    value = (
        F.when(op == "add", named(1)).when(op == "choose", named(7)).when(op == "counted", (n % 5 - 1).cast("string"))
        .when(op == "refinish", F.element_at(F.array(F.lit("nonfoil"), F.lit("foil"), F.lit("etched")), (n % 3 + 1).cast("int")))
        .when(op == "regraded", F.concat(F.lit("g"), (n % 4).cast("string"))).when(op == "dropping", (n % 2 == 1).cast("string"))
        .when(op == "reported", F.concat(F.lit("t"), n.cast("string")))
    )
    log = table(spark, root, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("entry"), n.alias("seq"), op.alias("op"), value.alias("value")
    )
    prints = table(spark, root, "part").filter("p_partkey % 6 < 5").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("printing"), _made().alias("finishes"))
    base = fresh_path(spark, "moves")
    middle = log.agg((F.max("seq") / 2).alias("m")).first().m
    log.filter(F.col("seq") < middle).write.parquet(f"{base}/landing")
    edits.edit_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", prints)
    log.filter(F.col("seq") >= middle).write.mode("append").parquet(f"{base}/landing")
    held = edits.edit_stream(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", prints)
    return held.select("entry", "quantity", "printing", "finish", "picked", "condition", "dropped", "reported")


LIST_MOVES = """
WITH RECURSIVE p AS (SELECT 'p' || p_partkey AS printing,
    CASE p_partkey % 6 WHEN 0 THEN ['nonfoil', 'foil'] WHEN 1 THEN ['foil'] WHEN 2 THEN ['etched', 'foil'] WHEN 3 THEN ['nonfoil', 'foil', 'etched'] ELSE []::VARCHAR[] END AS made
  FROM part WHERE p_partkey % 6 < 5),
o AS (SELECT user_id || '/' || hour(ts) AS entry, event_id AS n,
    ['add', 'add', 'plus', 'minus', 'counted', 'choose', 'refinish', 'cycled', 'regraded', 'dropping', 'reported', 'drop'][event_id % 12 + 1] AS op0 FROM events),
x AS (SELECT entry, n, CASE WHEN op0 = 'drop' AND n % 5 > 0 THEN 'plus' ELSE op0 END AS op FROM o),
v AS (SELECT *, CASE op WHEN 'add' THEN 'p' || (n % 40) WHEN 'choose' THEN 'p' || (n * 7 % 40) WHEN 'counted' THEN (n % 5 - 1)::VARCHAR
    WHEN 'refinish' THEN ['nonfoil', 'foil', 'etched'][n % 3 + 1] WHEN 'regraded' THEN 'g' || (n % 4) WHEN 'dropping' THEN (n % 2 = 1)::VARCHAR
    WHEN 'reported' THEN 't' || n END AS value, row_number() OVER (PARTITION BY entry ORDER BY n) AS i FROM x),
e AS (SELECT v.*, coalesce(p.made, []::VARCHAR[]) AS ways,
    CASE WHEN len(ways) = 1 THEN ways[1] WHEN len(ways) = 0 OR list_contains(ways, 'nonfoil') THEN 'nonfoil' ELSE ways[1] END AS settled
  FROM v LEFT JOIN p ON p.printing = v.value AND op IN ('add', 'choose')),
f AS (SELECT entry, 0::BIGINT AS i, 0::BIGINT AS q, NULL::VARCHAR AS printing, []::VARCHAR[] AS made, 'nonfoil' AS finish, false AS picked,
    '' AS condition, false AS dropped, NULL::VARCHAR AS reported FROM (SELECT DISTINCT entry FROM e)
  UNION ALL
  SELECT f.entry, e.i,
    CASE WHEN op = 'add' AND q = 0 THEN 1 WHEN q <= 0 THEN q WHEN op = 'plus' THEN least(q + 1, 10000) WHEN op = 'minus' THEN CASE WHEN q = 1 THEN -1 ELSE q - 1 END
      WHEN op = 'counted' THEN greatest(1, value::BIGINT) WHEN op = 'drop' THEN -1 ELSE q END,
    CASE WHEN (op = 'add' AND q = 0) OR (op = 'choose' AND q > 0) THEN value ELSE printing END,
    CASE WHEN (op = 'add' AND q = 0) OR (op = 'choose' AND q > 0) THEN ways ELSE made END,
    CASE WHEN (op = 'add' AND q = 0) OR (op = 'choose' AND q > 0 AND value IS DISTINCT FROM printing) THEN settled
      WHEN op = 'refinish' AND q > 0 AND list_contains(made, value) THEN value
      WHEN op = 'cycled' AND q > 0 AND len(made) > 1 THEN made[coalesce(list_position(made, finish), 0) % len(made) + 1] ELSE finish END,
    picked OR (op = 'choose' AND q > 0), CASE WHEN op = 'regraded' AND q > 0 THEN value ELSE condition END,
    CASE WHEN op = 'dropping' AND q > 0 THEN value = 'true' ELSE dropped END, CASE WHEN op = 'reported' AND q > 0 THEN value ELSE reported END
  FROM f JOIN e ON e.entry = f.entry AND e.i = f.i + 1)
SELECT entry, q AS quantity, printing, finish, picked, condition, dropped, reported FROM f
QUALIFY row_number() OVER (PARTITION BY entry ORDER BY i DESC) = 1 AND q > 0
"""


def unfile(spark: SparkSession, root: str) -> DataFrame:
    """Every stack of one place taken out of it: those that come to equal a
    loose one join it, under a ceiling of 500 copies."""
    line = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"))
    place = F.when(F.col("l_suppkey") % 3 == 0, F.lit("none")).when(F.col("l_suppkey") % 3 == 1, F.lit("box")).otherwise(F.lit("shelf"))
    held = line.groupBy(F.col("l_partkey").alias("part"), place.alias("place")).agg(F.sum("quantity").alias("quantity"))
    shelf = held.select(
        F.concat_ws("/", F.lit("at"), F.col("part").cast("string"), "place").alias("uri"),
        F.concat_ws("/", F.col("part").cast("string"), "place").alias("identity"),
        "quantity", F.col("part").alias("at"), "part", "place",
    )
    moved = shelf.filter(F.col("place") == "box").select(
        "uri", F.concat(F.col("part").cast("string"), F.lit("/none")).alias("identity"), F.lit(None).cast("long").alias("quantity")
    )
    return edits.amend_stacks(shelf.drop("part", "place"), moved, copies=500).select("uri", "identity", "quantity", "merged")


UNFILE = """
WITH h AS (SELECT l_partkey AS part, ['none', 'box', 'shelf'][l_suppkey % 3 + 1] AS place, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT part, max(CASE WHEN place = 'none' THEN q END) AS n, max(CASE WHEN place = 'box' THEN q END) AS x FROM h GROUP BY 1),
j AS (SELECT *, n IS NOT NULL AND x IS NOT NULL AND n + x <= 500 AS fits FROM b)
SELECT 'at/' || part || '/shelf' AS uri, part || '/shelf' AS identity, q AS quantity, 1::BIGINT AS merged FROM h WHERE place = 'shelf'
UNION ALL SELECT 'at/' || part || '/none', part || '/none', n + CASE WHEN fits THEN x ELSE 0 END, CASE WHEN fits THEN 2 ELSE 1 END FROM j WHERE n IS NOT NULL
UNION ALL SELECT 'at/' || part || '/box', part || '/none', x, 1 FROM j WHERE x IS NOT NULL AND NOT fits
"""


def capped_backfill(spark: SparkSession, root: str) -> DataFrame:
    """One run of filling a hash store: forty missing embeddings at most, some
    of which cannot be hashed."""
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding", "label")
    store = vectors.filter(~F.col("label").isin(3, 7)).select("vec_id")

    def make(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", similarity.sign_hash(F.col("embedding")).alias("hash"), (F.get("embedding", F.lit(0)) > -0.1).alias("ok"))

    added, report = backfill.capped_backfill(vectors, store, "vec_id", [F.asc("vec_id")], 40, make)
    return added.select(F.lit("added").alias("what"), F.col("vec_id").alias("n")).union(
        report.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("waiting", "failed")])).alias("r")).select("r.*")
    )


CAPPED_BACKFILL = """
WITH m AS (SELECT vec_id, embedding[1] > -0.1::FLOAT AS ok FROM embeddings WHERE label IN (3, 7)),
t AS (SELECT * FROM m ORDER BY vec_id LIMIT 40)
SELECT 'added' AS what, vec_id AS n FROM t WHERE ok
UNION ALL SELECT 'waiting', (SELECT count(*) FROM m) - count(*) FILTER (WHERE ok) FROM t
UNION ALL SELECT 'failed', count(*) FILTER (WHERE NOT ok) FROM t
"""


QUERIES = {
    "stream_replace": (stream_replace, STREAM_REPLACE),
    "stream_drain": (stream_drain, STREAM_DRAIN),
    "live_totals": (live_totals, LIVE_TOTALS),
    "amend_log": (amend_log, AMEND_LOG),
    "list_moves": (list_moves, LIST_MOVES),
    "unfile": (unfile, UNFILE),
    "capped_backfill": (capped_backfill, CAPPED_BACKFILL),
}
