"""Sources and sinks on data Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import HASH_INSETS
from ..operators import catalog, ranking, similarity
from ..session import fresh_path, materialize
from ..sources import catalog_files, images, jsonl, records
from .tables import table


def bulk_scan(spark: SparkSession, root: str) -> DataFrame:
    """Events written as gzip JSON lines with broken, blank, short and repeated
    lines, read back: the rows taken, and refusals by reason."""
    events = table(spark, root, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "k"))
    wrong = F.to_json(F.struct("event_id", "user_id", "event_type", F.lit("much").alias("value"), "k"))
    short = F.to_json(F.struct("event_id", "user_id", "event_type", "k"))
    line = (
        F.when(F.col("event_id") % 97 == 0, F.expr("left(event_type, 3)"))
        .when(F.col("event_id") % 89 == 0, F.lit("  "))
        .when(F.col("event_id") % 83 == 0, short)
        .when(F.col("event_id") % 79 == 0, wrong)
        .otherwise(whole)
    )
    path = fresh_path(spark, "bulk")
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.option("compression", "gzip").text(path)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, value double, k int")
    good, rejects = jsonl.scan_json_lines(spark, path, schema, ["event_id", "user_id", "event_type", "value"], {"k is 13": F.col("row.k") == 13}, splittable=False)
    kept = catalog.accept_in_order(materialize(good, "events"), ["file", "line"], [["user_id", "k", "event_type"], ["event_id"]])
    counted = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.lit("row").alias("what"), F.col("event_id").alias("n"), "value").union(
        counted.select("reason", "n", F.lit(None).cast("double"))
    )


BULK_SCAN = """
WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events),
r AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'not a record of this shape' WHEN event_id % 89 = 0 THEN 'blank'
  WHEN event_id % 83 = 0 THEN 'no value' WHEN event_id % 79 = 0 THEN 'not a record of this shape' WHEN k = 13 THEN 'k is 13' END AS reason FROM e)
SELECT 'row' AS what, event_id AS n, value FROM (SELECT * FROM r WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, k, event_type ORDER BY event_id) = 1)
UNION ALL SELECT reason, count(*), NULL FROM r WHERE reason <> 'blank' GROUP BY 1
"""


def version_index(spark: SparkSession, root: str) -> DataFrame:
    """Nations as a bulk index file a region; which entries this schema version
    has not ingested, and how often each was tried."""
    nation = table(spark, root, "nation")
    entry = F.struct(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("type"), F.col("n_name").alias("name"),
        F.concat(F.lit("2026-"), F.col("n_regionkey").cast("string")).alias("updated_at"), F.lit("u").alias("jsonl_download_uri"),
        F.col("n_nationkey").cast("long").alias("compressed_size"), F.lit("ignored").alias("extra"),
    )
    doc = nation.groupBy("n_regionkey").agg(F.collect_list(entry).alias("data")).select(
        "n_regionkey", F.to_json(F.struct(F.lit("list").alias("object"), F.lit(False).alias("has_more"), "data")).alias("value")
    )
    path = fresh_path(spark, "index")
    doc.write.partitionBy("n_regionkey").text(path)
    index = jsonl.bulk_index(spark, f"{path}/*")
    synced = nation.select(
        F.col("n_name").alias("kind"),
        F.concat(F.lit("2026-"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("9")).otherwise(F.col("n_regionkey").cast("string"))).alias("updated_at"),
        (F.col("n_nationkey") % 3).alias("schema_version"),
    )
    open_ = jsonl.version_gate(index, synced, 1)
    tries = synced.groupBy(F.col("kind").alias("type"), "updated_at").agg(F.count(F.lit(1)).alias("attempts"))
    return open_.join(tries, ["type", "updated_at"], "left").select("type", "updated_at", "compressed_size", F.coalesce("attempts", F.lit(0)).alias("attempts"))


VERSION_INDEX = """
SELECT n_name AS type, '2026-' || n_regionkey AS updated_at, n_nationkey::BIGINT AS compressed_size,
  (n_nationkey % 4 <> 0)::BIGINT AS attempts FROM nation WHERE NOT (n_nationkey % 3 = 1 AND n_nationkey % 4 <> 0)
"""


def record_tree(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document a conversation, key from its path, every turn checked
    against byte, cluster and number limits."""
    turns = table(spark, root, "conversations")
    # A conversation is one document, so its turns belong together.
    doc = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))).alias("value"))
    path = fresh_path(spark, "records")
    doc.select(F.lit("talk").alias("collection"), F.col("conv_id").alias("rkey"), "value").repartition(8, "rkey").write.partitionBy("collection", "rkey").text(path)
    held = records.scan_records(spark, path, "turns array<struct<turn:bigint,role:string,text:string>>", r"collection=([^/]+)/rkey=([^/]+)/")
    each = held.select("collection", "rkey", F.explode("value.turns").alias("t")).select("collection", "rkey", "t.turn", "t.role", "t.text")
    return records.record_violations(
        each,
        ["collection", "rkey", "turn"],
        {
            "text over 300 bytes": records.too_long(F.col("text"), 300),
            "text over 250 graphemes": records.too_many_graphemes(F.col("text"), 250),
            "role unknown": ~F.col("role").isin("user", "assistant"),
            "turn over 5": F.col("turn") > 5,
        },
    )


RECORD_TREE = """
SELECT 'talk' AS collection, conv_id::VARCHAR AS rkey, turn, v AS violation FROM (SELECT conv_id, turn, unnest([
  CASE WHEN octet_length(encode(text)) > 300 THEN 'text over 300 bytes' END, CASE WHEN length(text) > 250 THEN 'text over 250 graphemes' END,
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'role unknown' END, CASE WHEN turn > 5 THEN 'turn over 5' END]) AS v FROM conversations) WHERE v IS NOT NULL
"""


def encoded_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Lines written as places in dictionaries with a manifest, and decoded."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice")
    path = fresh_path(spark, "catalog")
    catalog_files.write_catalog(line, path, "2026-01-01", ["l_returnflag", "l_linestatus"], [F.asc("l_orderkey"), F.asc("l_linenumber")])
    # A reader of the first five fields only.
    return catalog_files.read_catalog(spark, path, line.columns[:5])


ENCODED_CATALOG = "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey FROM lineitem"


def encoded_arrays(spark: SparkSession, root: str) -> DataFrame:
    """Orders with the parts they hold as places, the flags of their lines as a
    mask and their flags in full as one interned text, published twice, decoded."""
    line = table(spark, root, "lineitem")
    rows = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")))).alias("kinds"),
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
        F.to_json(F.array_sort(F.collect_set(F.struct("l_returnflag", "l_linestatus")))).alias("legal"),
    )
    # Some have none of a kind, some nothing said at all.
    rows = rows.withColumn("kinds", F.when(F.col("l_orderkey") % 7 == 0, F.array().cast("array<string>")).when(F.col("l_orderkey") % 7 > 1, F.col("kinds")))
    rows = materialize(rows, "orders")  # published twice
    path = fresh_path(spark, "catalog")
    how = {"arrays": {"kinds": "places", "flags": "mask"}, "interned": {"legal": ["l_orderkey"]}}
    catalog_files.write_catalog(rows.filter("l_orderkey % 2 = 0"), path, "1", [], [F.asc("l_orderkey")], **how)
    catalog_files.write_catalog(rows, path, "2", [], [F.asc("l_orderkey")], **how)
    now = catalog_files.read_catalog(spark, path, rows.columns)
    before = catalog_files.read_catalog(spark, path, ["l_orderkey"], back=1).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).cast("bigint").alias("l_orderkey"), F.lit(None).cast("string").alias("kinds"), F.lit(None).cast("string").alias("flags"), F.col("n").cast("string").alias("legal")
    )
    words = lambda c: F.array_join(F.array_sort(c), " ")
    return now.select(F.col("l_orderkey").cast("bigint"), words("kinds").alias("kinds"), words("flags").alias("flags"), "legal").unionByName(before)


ENCODED_ARRAYS = """
WITH l AS (SELECT l_orderkey, string_agg(DISTINCT 's' || (l_suppkey % 40), ' ' ORDER BY 's' || (l_suppkey % 40)) AS kinds, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS flags,
  '[' || string_agg(DISTINCT '{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}', ','
    ORDER BY '{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}') || ']' AS legal FROM lineitem GROUP BY 1)
SELECT l_orderkey::BIGINT AS l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 7 > 1 THEN kinds END AS kinds, flags, legal FROM l
UNION ALL SELECT -1, NULL, NULL, count(*) FILTER (WHERE l_orderkey % 2 = 0)::VARCHAR FROM l
"""


def artwork_index(spark: SparkSession, root: str) -> DataFrame:
    """Lines as printings with a part on the front and for some another on the
    back: the published index of their artwork, hashed where the embeddings
    have it, its pairs, and what it says about itself."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    name = lambda n: F.concat(F.lit("art"), n.cast("string"))
    front = F.when(F.col("l_partkey") % 11 > 0, name(F.col("l_partkey") % 700))
    back = F.when(F.col("l_suppkey") % 3 == 0, name(F.col("l_partkey") % 900 + F.col("l_suppkey") % 2))
    prints = ranking.number_rows(line, order, "seq").select("seq", front.alias("front"), back.alias("back"))
    vectors = table(spark, root, "embeddings").filter("vec_id % 5 > 0")
    store = vectors.select(name(F.col("vec_id")).alias("artwork"), F.array(similarity.sign_hash(F.col("embedding")), similarity.sign_hash(F.col("embedding"), 0.05)).alias("hashes"))
    path = fresh_path(spark, "catalog")
    made = catalog_files.artwork_part(prints, store, path, width=2, hasher="h1")
    catalog_files.write_catalog(prints, path, "v1", ["front", "back"], [F.asc("seq")], artwork=made)
    artwork, backs = catalog_files.read_artwork(spark, path, "h1")
    said = catalog_files.read_manifest(spark, path)["artwork"]
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    bits = F.bit_count(F.get("hashes", F.lit(0))) * 100 + F.bit_count(F.get("hashes", F.lit(1)))
    return (
        artwork.select(F.lit("artwork").alias("what"), "number", "artwork", "present", bits.cast("bigint").alias("n"))
        .union(backs.select(F.lit("back"), "back_number", none, F.lit(None).cast("boolean"), "front_number"))
        .union(spark.createDataFrame([(k, said[k]) for k in ("rows", "fronts", "absent", "backs", "hashes")], "what string, n bigint").select("what", zero, none, F.lit(None).cast("boolean"), "n"))
    )


def _bits_sql(over: str) -> str:
    return f"len(list_filter(range(1, 65), lambda i: embedding[i] > {over}))"


ARTWORK_INDEX = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  CASE WHEN l_partkey % 11 > 0 THEN 'art' || (l_partkey % 700) END AS front, CASE WHEN l_suppkey % 3 = 0 THEN 'art' || (l_partkey % 900 + l_suppkey % 2) END AS back FROM lineitem),
f AS (SELECT front AS artwork, row_number() OVER (ORDER BY min(seq)) - 1 AS number FROM p WHERE front IS NOT NULL GROUP BY 1),
b AS (SELECT DISTINCT front, back FROM p WHERE front <> back),
o AS (SELECT artwork, row_number() OVER (ORDER BY artwork) - 1 + (SELECT count(*) FROM f) AS number FROM (SELECT DISTINCT back AS artwork FROM b) WHERE artwork NOT IN (SELECT artwork FROM f)),
a AS (SELECT * FROM f UNION ALL SELECT * FROM o),
s AS (SELECT 'art' || vec_id AS artwork, {_bits_sql("0")} * 100 + {_bits_sql("0.05::FLOAT")} AS n FROM embeddings WHERE vec_id % 5 > 0),
w AS (SELECT number, artwork, n IS NOT NULL AS present, coalesce(n, 0) AS n FROM a LEFT JOIN s USING (artwork))
SELECT 'artwork' AS what, number, artwork, present, n::BIGINT AS n FROM w
UNION ALL SELECT 'back', x.number, NULL, NULL, y.number FROM b JOIN a x ON x.artwork = b.back JOIN a y ON y.artwork = b.front
UNION ALL SELECT unnest(['rows', 'fronts', 'absent', 'backs', 'hashes']), NULL, NULL, NULL,
  unnest([(SELECT count(*) FROM a), (SELECT count(*) FROM f), (SELECT count(*) FROM w WHERE NOT present), (SELECT count(*) FROM b), 2])
"""


def retention(spark: SparkSession, root: str) -> DataFrame:
    """Orders as a listing of published files: what may be swept, and of the
    finished ones what would still have to be sent."""
    orders = table(spark, root, "orders")
    listing = orders.select(
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("note-"), F.col("o_orderkey").cast("string")))
        .otherwise(F.concat(F.lit("rows."), F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 16), F.lit(".json"))).alias("name"),
        F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate")).alias("age"),
        "o_orderstatus", "o_orderpriority",
    )
    keep = listing.filter(F.col("o_orderstatus") == "P").select("name")
    swept = catalog_files.retention_sweep(listing, keep, "name", "age", 30)
    parts = listing.filter(F.col("o_orderpriority") == "1-URGENT").select("name")
    sent = catalog_files.already_present(parts, listing.filter(F.col("o_orderstatus") == "F"), "name")
    return swept.select(F.lit("sweep").alias("what"), "name").union(sent.select(F.when(F.col("held"), "held").otherwise("send"), "name"))


RETENTION = """
WITH l AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'note-' || o_orderkey ELSE 'rows.' || left(md5(o_orderkey::VARCHAR), 16) || '.json' END AS name,
  DATE '1999-01-01' - o_orderdate::DATE AS age, o_orderstatus, o_orderpriority, o_orderkey FROM orders)
SELECT 'sweep' AS what, name FROM l WHERE o_orderkey % 10 <> 0 AND age >= 30 AND o_orderstatus <> 'P'
UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'held' ELSE 'send' END, name FROM l WHERE o_orderpriority = '1-URGENT'
"""


def frame_hash(spark: SparkSession, root: str) -> DataFrame:
    """Embeddings as small luma planes: hashed at four insets, stored with the
    hasher's stamp and read back; with each plane's sharpness."""
    vectors = table(spark, root, "embeddings")
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + x * 400).cast("int"))))
    luma = F.unhex(F.array_join(F.transform(level, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    frames = vectors.select(
        F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(8).alias("stride"), luma.alias("luma")
    )
    path = fresh_path(spark, "store")
    images.write_store(images.hash_frames(frames, tuple(HASH_INSETS)), path)
    held = images.read_store(spark, path, images.fingerprint(tuple(HASH_INSETS)))
    return held.select("id", F.element_at("hashes", 1).alias("first"), F.element_at("hashes", 4).alias("last"), "gradient", F.round("energy", 6).alias("energy"))


QUERIES = {
    "bulk_scan": (bulk_scan, BULK_SCAN),
    "version_index": (version_index, VERSION_INDEX),
    "record_tree": (record_tree, RECORD_TREE),
    "encoded_catalog": (encoded_catalog, ENCODED_CATALOG),
    "encoded_arrays": (encoded_arrays, ENCODED_ARRAYS),
    "artwork_index": (artwork_index, ARTWORK_INDEX),
    "retention": (retention, RETENTION),
    "frame_hash": (frame_hash, None),
}
