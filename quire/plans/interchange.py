"""Vendor files, formats, values and losses on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clip, text as tx, values as v
from ..operators import interchange as ix
from ..session import fresh_path, materialize
from ..sources import csv_lined
from ..sources.images import luma_level
from .tables import table


def _uuid(seed: Column) -> Column:
    h = F.md5(seed.cast("string").cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _part_stacks(spark: SparkSession, root: str) -> DataFrame:
    """Parts as stacks in our own shape, awkward notes and tags included."""
    part = table(spark, root, "part")
    size = F.col("p_size")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    lot = F.struct(
        size.cast("long").alias("quantity"),
        F.when(size % 2 == 0, F.lit("2024-03-01T00:00:00.000Z")).alias("at"),
        F.when(size % 3 == 0, price).alias("price"),
        F.when(size % 3 == 0, F.lit("EUR")).alias("currency"),
        F.lit(None).cast("string").alias("marketValue"),
        F.lit(None).cast("string").alias("marketCurrency"),
    )
    return part.select(
        "p_partkey",
        _uuid(F.col("p_partkey")).alias("printing"),
        F.col("p_name").alias("name"),
        F.lower("p_brand").alias("set_code"),
        F.concat("p_type", F.lit(", the set")).alias("set_name"),
        F.concat(size.cast("string"), F.lit("a")).alias("collector_number"),
        F.lit("rare").alias("rarity"),
        F.lit("en").alias("lang"),
        F.when(size % 13 == 0, "gilded").when(size % 2 == 0, "foil").otherwise("nonfoil").alias("finish"),
        F.when(size % 10 == 0, F.lit(10001)).otherwise(size).cast("long").alias("take"),
        F.when(size % 4 == 0, F.lit("nearMint")).alias("condition"),
        F.when(size % 5 == 0, F.array(F.lit("signed"), F.col("p_type"))).alias("tags"),
        F.when(size % 3 != 0, F.concat(F.lit('say "'), "p_name", F.lit('",\n'), "p_brand")).alias("note"),
        (size % 7 == 0).alias("proxy"),
        lot.alias("lot"),
        F.lit("2024-01-02T03:04:05.000Z").alias("created"),
        F.lit(None).cast("string").alias("updated"),
    )


def csv_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Parts written as a vendor file, read back as records with line numbers,
    recognised, bound and judged: the stacks accepted and each refusal."""
    stacks = _part_stacks(spark, root)
    cells = ix.export_cells(stacks, ix.OWN, keep=["p_partkey"])
    path = fresh_path(spark, "csv")
    csv_lined.write_csv(cells, path, ix.OWN.columns, "p_partkey")
    records = materialize(csv_lined.scan_csv_lined(spark, path), "records")
    heads = csv_lined.header_of(records).filter(ix.detect_format(F.col("head")) == "own")
    judged = materialize(ix.judge_rows(ix.bind_columns(records, heads, ix.OWN), ix.OWN), "judged")
    good = ix.stacks_of(judged.filter("reason is null"), "2026-01-01T00:00:00.000Z").select(
        "printing", "finish", "quantity", "condition", F.array_join("tags", "|").alias("tags"), "note", "proxy",
        F.get("lots", F.lit(0))["price"].alias("price"), F.get("lots", F.lit(0))["at"].alias("at"), F.lit(None).cast("string").alias("reason"),
    )
    bad = judged.filter("reason is not null").select(
        F.col("scryfallId"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("reason"),
    )
    return good.union(bad)


CSV_ROUND_TRIP = """
WITH p AS (SELECT *, md5(p_partkey::VARCHAR) AS h, CASE WHEN p_size % 13 = 0 THEN 'unknown finish gilded'
    WHEN p_size % 10 = 0 THEN '10001 is not a count' END AS reason FROM part)
SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS printing,
  CASE WHEN reason IS NULL THEN CASE WHEN p_size % 2 = 0 THEN 'foil' ELSE 'nonfoil' END END AS finish,
  CASE WHEN reason IS NULL THEN p_size::BIGINT END AS quantity,
  CASE WHEN reason IS NULL AND p_size % 4 = 0 THEN 'nearMint' END AS condition,
  CASE WHEN reason IS NULL AND p_size % 5 = 0 THEN 'signed|' || p_type END AS tags,
  CASE WHEN reason IS NULL AND p_size % 3 <> 0 THEN 'say "' || p_name || '",' || chr(10) || p_brand END AS note,
  CASE WHEN reason IS NULL AND p_size % 7 = 0 THEN true END AS proxy,
  CASE WHEN reason IS NULL AND p_size % 3 = 0 THEN p_retailprice::DECIMAL(12,2)::VARCHAR END AS price,
  CASE WHEN reason IS NULL AND p_size % 2 = 0 THEN '2024-03-01T00:00:00.000Z' END AS at, reason FROM p
""".replace(" AS at,", ' AS "at",')


def gated_parse(spark: SparkSession, root: str) -> DataFrame:
    """Event times and amounts in several spellings, and which can be kept."""
    events = table(spark, root, "events").select("event_id", "ts", "value", F.get_json_object("props", "$.k").alias("k"))
    form = F.col("event_id") % 5
    when = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(form == 2, F.date_format("ts", "dd/MM/yyyy"))
        .when(form == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+01:00'"))
        .otherwise(F.concat(F.lit("2024-13-"), F.col("k")))
    )
    amount = F.when(form == 2, F.concat(F.lit("$"), F.col("k"))).when(form == 3, F.col("value").cast("string")).otherwise(F.col("k"))
    money = F.when(form == 1, F.lit("euro")).when(form == 4, F.lit(None).cast("string")).otherwise(F.lit("eur"))
    lot = F.struct(
        F.when(form != 4, amount).alias("price"), money.alias("currency"), F.lit(None).cast("string").alias("marketValue"),
        F.lit(None).cast("string").alias("marketCurrency"), F.when(form != 3, when).alias("at"),
    )
    return events.select(
        "event_id", v.gated_timestamp(when).alias("moment"), v.money_pair(amount, money).alias("kept"), v.legible_lot(lot).alias("legible")
    )


GATED_PARSE = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z')
    WHEN 3 THEN strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') END AS moment,
  event_id % 5 IN (0, 3) AS kept, event_id % 5 IN (0, 3) OR (event_id % 5 = 4 AND length(json_extract_string(props, '$.k')) = 2) AS legible
FROM events
"""


def format_gate(spark: SparkSession, root: str) -> DataFrame:
    """Headers spelled many ways, one a part: which format each is taken for
    and what it lacks."""
    part = table(spark, root, "part").select("p_partkey", "p_size")
    own = F.array(*[F.lit(c) for c in ix.OWN.columns])
    vendor = F.array(*[F.lit(c) for c in ix.VENDOR.columns])
    loud = lambda head: F.transform(head, lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("_"))))
    head = (
        F.when(F.col("p_size") % 6 == 0, own)
        .when(F.col("p_size") % 6 == 1, loud(vendor))
        .when(F.col("p_size") % 6 == 2, F.filter(vendor, lambda c: ~c.isin("Signed", "Proxy", "Set name")))
        .when(F.col("p_size") % 6 == 3, F.filter(own, lambda c: c != "Quantity"))
        .when(F.col("p_size") % 6 == 4, F.filter(own, lambda c: c != "Rarity"))
        .otherwise(F.array(F.lit("Name"), F.lit("Finish")))
    )
    paid = ix.as_paid(ix.VENDOR)
    return part.withColumn("head", head).select(
        "p_partkey",
        ix.detect_format(F.col("head")).alias("format"),
        ix.missing_columns(F.col("head"), ix.OWN).alias("missing"),
        F.lit(f"{paid.binding['price']}/{paid.binding['currency']}").alias("paid_from"),
    )


FORMAT_GATE = """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'own' WHEN 1 THEN 'vendor' WHEN 2 THEN 'vendor' WHEN 4 THEN 'own' END AS format,
  CASE p_size % 6 WHEN 1 THEN 'Finish' WHEN 2 THEN 'Finish' WHEN 3 THEN 'Quantity' WHEN 5 THEN 'Scryfall ID, Quantity' ELSE '' END AS missing,
  'Purchase price/Purchase price currency' AS paid_from FROM part
"""


def loss_report(spark: SparkSession, root: str) -> DataFrame:
    """What the vendor's narrower file loses of the parts, and of a language
    its importer refuses."""
    stacks = _part_stacks(spark, root).withColumns(
        {
            "quantity": F.col("take"),
            "known": F.col("set_code") != "brand#3",
            "lang": F.when(F.col("take") % 9 == 0, "ph").otherwise("en"),
            "lots": F.array("lot"),
            "container": F.when(F.col("take") == 11, F.lit("at://box")),
        }
    )
    return ix.loss_report(stacks, ix.VENDOR)


LOSS_REPORT = """
WITH p AS (SELECT *, CASE WHEN p_size % 10 = 0 THEN 10001 ELSE p_size END AS q FROM part)
SELECT coalesce(sum(q) FILTER (WHERE p_brand = 'Brand#3'), 0)::BIGINT AS unnamed, coalesce(sum(q) FILTER (WHERE p_size % 13 = 0), 0)::BIGINT AS unspelled,
  sum(q) FILTER (WHERE p_size % 2 <> 0 AND p_size % 3 <> 0)::BIGINT AS unkept, sum(q) FILTER (WHERE q % 9 = 0)::BIGINT AS refused,
  'container,note,price,currency,acquiredAt,tags' AS dropped, '' AS unread FROM p
"""


def spend_rows(spark: SparkSession, root: str) -> DataFrame:
    """Each order's lines as lots of one stack, spent inside their row: what
    each export row carries."""
    line = table(spark, root, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_suppkey", "l_quantity")
    key = F.struct("l_shipdate", "l_linenumber", "l_extendedprice", "l_suppkey")
    lot = F.struct(
        F.col("l_quantity").alias("quantity"), F.lit(None).cast("string").alias("at"), F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("price"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("marketValue"), F.lit(None).cast("string").alias("marketCurrency"),
    )
    # An order holds a few lines, as a stack holds a few lots.
    lots = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), lot.alias("lot")))).alias("pairs"))
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 4000).alias("quantity"))
    stacks = lots.join(orders, "l_orderkey").select("l_orderkey", "quantity", F.transform("pairs", lambda p: p["lot"]).alias("lots"))
    rows = ix.spend_stack_lots(stacks, ix.OWN)
    return rows.select("l_orderkey", F.col("take").cast("long").alias("take"), F.col("lot.price").alias("price"), F.col("unspent").cast("long").alias("unspent"))


SPEND_ROWS = """
WITH l AS (SELECT l_orderkey, l_extendedprice::DECIMAL(14,2)::VARCHAR AS price, l_quantity::BIGINT AS q, floor(o_totalprice / 4000)::BIGINT AS c,
  coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT *, greatest(0, least(q, c - b))::BIGINT AS take, count(*) FILTER (WHERE c - b <= 0) OVER (PARTITION BY l_orderkey) AS unspent FROM l)
SELECT l_orderkey, take, price, unspent FROM t WHERE take > 0
UNION ALL SELECT l_orderkey, (max(c) - sum(take))::BIGINT, NULL, any_value(unspent) FROM t GROUP BY 1 HAVING max(c) > sum(take)
"""


def text_scalars(spark: SparkSession, root: str) -> DataFrame:
    """Names, slugs, tags, words and links of parts and pages."""
    part = table(spark, root, "part")
    size = F.col("p_size")
    kind = F.when(size % 2 == 0, F.lit("draft-innovation")).otherwise(F.lit("core"))
    name = tx.card_name(
        F.col("p_name"), F.when(size % 3 == 0, F.concat(F.lit(""), "p_name")).otherwise(F.upper("p_name")), F.when(size % 2 == 0, "ja").otherwise("fr"), "ja"
    )
    tag = F.element_at(F.array(*[F.lit(t) for t in ("zh-TW", "zh-Hans-CN", "pt-BR", "en")]), size % 4 + 1)
    tags = v.tags_of({"signed": F.when(size % 2 == 0, "YES").otherwise("no"), "altered": F.lit("1")}, F.concat(F.lit(" signed, "), "p_name", F.lit(",,"), "p_brand"))
    rgb = [size * 5 % 256, size * 7 % 256, size * 11 % 256]
    parts = part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(
            "~",
            tx.kind_key(F.concat("p_type", F.lit(" -x"))),
            F.coalesce(tx.product_words(kind, ["core", "expansion"]), F.lit("none")),
            name["text"], name["lang"],
            tx.language_tag(tag),
            tx.fold_key(F.col("p_brand")),
            F.array_join(tags, "/"),
            tx.plain_slug(F.concat(F.lit("("), "p_name", F.lit(" & co)"))),
            tx.describe_print(F.col("p_type"), F.lower("p_brand"), size.cast("string"), F.when(size > 25, F.lit("rare"))),
            tx.image_url("https://img.example.org", F.md5(F.col("p_partkey").cast("string").cast("binary")), "normal"),
            tx.spaced_words(F.concat(F.lit("fullArt_"), F.lower("p_type"))),
            v.grade_out(F.lit("lightPlayed")),
            luma_level(*rgb).cast("string"),
        ).alias("text"),
    )
    pages = table(spark, root, "pages").select((-F.col("page_id") - 1).alias("id"), tx.plain_slug(F.col("url")).alias("text"))
    return parts.union(pages)


TEXT_SCALARS = r"""
SELECT p_partkey AS id, concat_ws('~', lower(p_type) || '_x', CASE WHEN p_size % 2 = 0 THEN 'draft-innovation' ELSE 'none' END,
  CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'ja' ELSE 'en' END,
  ['zht', 'zhs', 'pt', 'en'][p_size % 4 + 1], lower(p_brand),
  'altered/signed/' || p_name || '/' || p_brand, replace(p_name, ' ', '-') || '-co',
  p_type || ' · ' || upper(p_brand) || ' #' || p_size || CASE WHEN p_size > 25 THEN ' · rare' ELSE '' END,
  'https://img.example.org/normal/front/' || md5(p_partkey::VARCHAR)[1:1] || '/' || md5(p_partkey::VARCHAR)[2:2] || '/' || md5(p_partkey::VARCHAR) || '.jpg',
  'full art ' || lower(p_type), 'light_played', ((p_size * 5 % 256 * 2126 + p_size * 7 % 256 * 7152 + p_size * 11 % 256 * 722 + 5000) // 10000)::VARCHAR) AS text FROM part
UNION ALL
SELECT -page_id - 1, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') FROM pages
"""


def clipped(spark: SparkSession, root: str) -> DataFrame:
    """Documents cut to 64 bytes at whole clusters, and to 300 of them."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    return docs.select("doc_id", clip.clip_text(F.col("text"), 64).alias("tag"), F.length(clip.clip_text(F.col("text"), 3000, 300)).cast("long").alias("note"))


CLIPPED = """
SELECT doc_id, left(text, list_max(list_filter(range(0, 65), lambda i: octet_length(encode(left(text, i))) <= 64))::INT) AS tag,
  least(length(text), 300)::BIGINT AS note FROM documents
"""


QUERIES = {
    "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP),
    "gated_parse": (gated_parse, GATED_PARSE),
    "format_gate": (format_gate, FORMAT_GATE),
    "loss_report": (loss_report, LOSS_REPORT),
    "spend_rows": (spend_rows, SPEND_ROWS),
    "text_scalars": (text_scalars, TEXT_SCALARS),
    "clip": (clipped, CLIPPED),
}
