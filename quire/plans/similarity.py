"""Similarity, passages and full text on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import entries as review, folding, fulltext, inverted, lookups, measures, passages, similarity
from ..session import fresh_path, materialize
from .aggregates import WORDS_SQL
from .tables import table


def _hashes(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    two = F.array(similarity.sign_hash(F.col("embedding")), similarity.sign_hash(F.col("embedding"), 0.05))
    return vectors.select(F.col("vec_id").alias("artwork"), two.alias("hashes"), "label")


def _word_sql(over: str) -> str:
    return (
        "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > "
        f"{over} THEN 1::UBIGINT << (64 - i) ELSE 0 END))::UBIGINT"
    )


PAIRS_SQL = f"""
w AS (SELECT vec_id, label, {_word_sql("0")} AS a, {_word_sql("0.05::FLOAT")} AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, i.vec_id AS artwork, q.label = i.label AS same,
  least(bit_count(xor(q.a, i.a)), bit_count(xor(q.a, i.b)), bit_count(xor(q.b, i.a)), bit_count(xor(q.b, i.b)))::BIGINT AS distance
  FROM w q CROSS JOIN w i)"""


def hamming_top_k(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest of every embedding by two hashes a side, with margins."""
    index = _hashes(spark, root)
    found = similarity.nearest(index.withColumnRenamed("artwork", "query_id"), index)
    return found.join(similarity.margins(found), "query_id")


HAMMING_TOP_K = f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, artwork) AS place FROM d)
SELECT query_id, place, artwork, distance, (max(CASE WHEN place = 2 THEN distance END) OVER (PARTITION BY query_id)
  - max(CASE WHEN place = 1 THEN distance END) OVER (PARTITION BY query_id))::BIGINT AS margin FROM r WHERE place <= 5
"""


def recall_at_k(spark: SparkSession, root: str) -> DataFrame:
    """How often the nearest others share an embedding's label, by label and
    over all, with the upper median distance of the first that does."""
    index = _hashes(spark, root)
    ten = similarity.nearest(index.withColumnRenamed("artwork", "query_id"), index, keep=11)
    others = ten.filter(F.col("artwork") != F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy("place")
    ranked = others.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 10)
    labels = index.select("artwork", "label")
    asked = labels.select(F.col("artwork").alias("query_id"), F.col("label").alias("truth"))
    hits = ranked.join(labels, "artwork").join(asked, "query_id").groupBy("query_id", "truth").agg(
        F.min(F.when(F.col("label") == F.col("truth"), F.col("k"))).alias("first"),
        F.min(F.when(F.col("label") == F.col("truth"), F.col("distance"))).alias("apart"),
    )
    both = hits.select(F.explode(F.array(F.lit("(all)"), F.col("truth").cast("string"))).alias("cut"), "first", "apart")

    def at(k: int):
        return F.round(F.count_if(F.coalesce(F.col("first") <= k, F.lit(False))) / F.count(F.lit(1)), 9).alias(f"recall_{k}")

    rates = both.groupBy("cut").agg(F.count(F.lit(1)).alias("queries"), at(1), at(5), at(10))
    return rates.join(folding.quantiles(both, ["cut"], "apart", {"median": folding.upper_middle}), "cut", "left")


RECALL_AT_K = f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, artwork) AS k FROM d WHERE artwork <> query_id),
h AS (SELECT query_id, min(CASE WHEN same THEN k END) AS first, min(CASE WHEN same THEN distance END) AS apart FROM r WHERE k <= 10 GROUP BY 1),
b AS (SELECT unnest(['(all)', label::VARCHAR]) AS cut, first, apart FROM h JOIN embeddings ON vec_id = query_id)
SELECT cut, count(*) AS queries, round(count(*) FILTER (WHERE first <= 1) / count(*), 9) AS recall_1,
  round(count(*) FILTER (WHERE first <= 5) / count(*), 9) AS recall_5, round(count(*) FILTER (WHERE first <= 10) / count(*), 9) AS recall_10,
  list_sort(list(apart) FILTER (WHERE apart IS NOT NULL))[count(apart) // 2 + 1] AS median FROM b GROUP BY 1
"""


def distance_alike(spark: SparkSession, root: str) -> DataFrame:
    """The upper median of every embedding's distance to the nearest other one
    of its label over the whole index, by label and over all; ``alike`` counts
    the embeddings that have one."""
    index = _hashes(spark, root)
    asked = index.withColumnRenamed("artwork", "query_id")
    apart = similarity.nearest_alike(asked, index, "label").withColumnRenamed("distance", "apart")
    held = asked.select("query_id", "label").join(apart, "query_id", "left")
    # Read for the counts and for the medians.
    both = materialize(held.select(F.explode(F.array(F.lit("(all)"), F.col("label").cast("string"))).alias("cut"), "apart"), "apart")
    counts = both.groupBy("cut").agg(F.count(F.lit(1)).alias("queries"), F.count("apart").alias("alike"))
    return counts.join(folding.quantiles(both, ["cut"], "apart", {"median": folding.upper_middle}), "cut", "left")


DISTANCE_ALIKE = f"""
WITH {PAIRS_SQL}, h AS (SELECT query_id, min(CASE WHEN same THEN distance END) AS apart FROM d WHERE artwork <> query_id GROUP BY 1),
b AS (SELECT unnest(['(all)', label::VARCHAR]) AS cut, apart FROM embeddings LEFT JOIN h ON vec_id = query_id)
SELECT cut, count(*) AS queries, count(apart) AS alike,
  list_sort(list(apart) FILTER (WHERE apart IS NOT NULL))[count(apart) // 2 + 1] AS median FROM b GROUP BY 1
"""


#: Ways an embedding comes back changed: every component, by its place and its vector's number.
_CHANGES = {
    "flipped": lambda x, i, n: F.when((i + n) % 6 == 0, -x).otherwise(x),
    "dimmed": lambda x, i, n: x - 0.06,
    "cropped": lambda x, i, n: F.when((i >= 24) & (i < 32), F.lit(0.0)).otherwise(x),
}
#: How many hashes of the changed embedding, and of the held one, each way of holding compares.
_KINDS = {"plain": (1, 1), "levels": (1, 2), "asked": (2, 2)}


def _changed(change):
    return F.transform("embedding", lambda x, i: change(x.cast("double"), i, F.col("vec_id")))


def recall_report(spark: SparkSession, root: str) -> DataFrame:
    """Every embedding asked for in three changed forms against three ways of
    holding it: at which rank of the whole index it comes back, how far it is
    and how much further the nearest other one."""
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")

    def hashes(vector):
        return F.array(*[similarity.sign_hash(vector, v) for v in (0.0, 0.05)]).alias("hashes")

    index = vectors.select(F.col("vec_id").alias("artwork"), hashes(F.col("embedding")))
    asked = None
    for name, change in _CHANGES.items():
        one = vectors.select(F.col("vec_id").alias("artwork"), hashes(_changed(change)), F.lit(name).alias("change"))
        asked = one if asked is None else asked.unionByName(one)
    asked = asked.withColumn("query_id", F.concat_ws("/", "change", "artwork"))
    ranks = similarity.true_ranks(asked, index, "artwork", kinds=_KINDS)
    cut = asked.select("query_id", "change")
    both = materialize(ranks.join(cut, "query_id"), "ranks")
    return measures.recall_report(both, ["change", "kind"])


def _changed_sql(change: str) -> str:
    return {
        "flipped": "CASE WHEN (i - 1 + vec_id) % 6 = 0 THEN -(embedding[i]::DOUBLE) ELSE embedding[i]::DOUBLE END",
        "dimmed": "embedding[i]::DOUBLE - 0.06::DOUBLE",
        "cropped": "CASE WHEN i - 1 >= 24 AND i - 1 < 32 THEN 0 ELSE embedding[i]::DOUBLE END",
    }[change]


def _level_sql(value: str, over: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {value} > {over} THEN 1::UBIGINT << (64 - i) ELSE 0 END))::UBIGINT"


_ASKED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS change, vec_id AS query_id, {_level_sql(_changed_sql(c), '0')} AS a, {_level_sql(_changed_sql(c), '0.05::DOUBLE')} AS b FROM embeddings" for c in _CHANGES
)
RECALL_REPORT = f"""
WITH i AS (SELECT vec_id AS artwork, {_level_sql("embedding[i]::DOUBLE", "0")} AS a, {_level_sql("embedding[i]::DOUBLE", "0.05::DOUBLE")} AS b FROM embeddings),
q AS ({_ASKED_SQL}),
p AS (SELECT change, query_id, artwork, bit_count(xor(q.a, i.a)) AS aa, bit_count(xor(q.a, i.b)) AS ab, bit_count(xor(q.b, i.a)) AS ba, bit_count(xor(q.b, i.b)) AS bb
  FROM q CROSS JOIN i),
d AS (SELECT change, query_id, artwork, unnest([{{'kind': 'plain', 'apart': aa}}, {{'kind': 'levels', 'apart': least(aa, ab)}}, {{'kind': 'asked', 'apart': least(aa, ab, ba, bb)}}], recursive := true) FROM p),
t AS (SELECT *, max(CASE WHEN artwork = query_id THEN apart END) OVER (PARTITION BY change, kind, query_id) AS truth FROM d),
r AS (SELECT change, kind, query_id, any_value(truth) AS truth, count(*) FILTER (WHERE artwork <> query_id AND apart < truth) + 1 AS rank,
  min(CASE WHEN artwork <> query_id THEN apart END)::INT - any_value(truth)::INT AS margin FROM t GROUP BY ALL)
SELECT change, kind, count(*) AS asked, round(count(*) FILTER (WHERE rank <= 1) / count(*), 9) AS recall_1, round(count(*) FILTER (WHERE rank <= 5) / count(*), 9) AS recall_5,
  round(count(*) FILTER (WHERE rank <= 10) / count(*), 9) AS recall_10, max(rank) AS worst,
  list_sort(list(truth))[count(*) // 2 + 1]::BIGINT AS distance, list_sort(list(margin))[count(margin) // 2 + 1]::BIGINT AS margin
FROM r GROUP BY 1, 2
"""


def _entries(spark: SparkSession, root: str) -> DataFrame:
    index = _hashes(spark, root)
    asked = index.withColumnRenamed("artwork", "query_id")
    found = similarity.nearest(asked, index)
    margin = similarity.margins(found)
    # Printings: one or two a vector, none for one label, some made in one finish.
    prints = index.filter(F.col("label") != 3).select(
        "artwork",
        F.explode(F.when(F.col("label") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("side"),
        F.when(F.col("artwork") % 3 == 0, F.array(F.lit("foil"))).otherwise(F.array(F.lit("foil"), F.lit("nonfoil"))).alias("finishes"),
    ).select("artwork", F.concat(F.col("artwork").cast("string"), "side").alias("id"), "finishes")
    none = F.array().cast("array<struct<id:string,finishes:array<string>>>")
    carried = prints.groupBy("artwork").agg(F.array_sort(F.collect_list(F.struct("id", "finishes"))).alias("prints"))
    rows = found.join(carried, "artwork", "left").groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "distance", "artwork", F.coalesce("prints", none).alias("prints")))),
            lambda m: F.struct(m["distance"].alias("distance"), m["artwork"].alias("artwork"), m["prints"].alias("prints")),
        ).alias("found")
    )
    return similarity.scan_entries(rows.join(margin, "query_id"), "query_id")


def scan_entries(spark: SparkSession, root: str) -> DataFrame:
    """What a scan of every embedding would list: its nearest artworks through
    the printings that carry them, the margin between nameable ones, whether
    the read settles it."""
    entries = _entries(spark, root)
    return entries.select("query_id", F.size("matched").cast("long").alias("matched"), F.col("margin").cast("long").alias("margin"), "chosen", "finish", "sure")


SCAN_ENTRIES = f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, artwork) AS place FROM d),
f AS (SELECT query_id, place, artwork, distance, label FROM r JOIN embeddings ON vec_id = artwork WHERE place <= 5),
m AS (SELECT query_id, max(CASE WHEN place = 2 THEN distance END) - max(CASE WHEN place = 1 THEN distance END) AS margin,
  bool_or(place = 1 AND label = 3) AS unnamed FROM f GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS at_ FROM f WHERE label <> 3),
e AS (SELECT query_id, count(*) AS matched, max(CASE WHEN at_ = 1 THEN distance END) AS d1, max(CASE WHEN at_ = 2 THEN distance END) AS d2,
  max(CASE WHEN at_ = 1 THEN artwork END) AS art, max(CASE WHEN at_ = 1 THEN label END) AS label FROM n GROUP BY 1),
g AS (SELECT e.*, (CASE WHEN d2 IS NOT NULL THEN d2 - d1 WHEN unnamed THEN 0 ELSE margin END)::BIGINT AS gap FROM e JOIN m USING (query_id))
SELECT query_id, matched, gap AS margin, art || 'a' AS chosen, CASE WHEN art % 3 = 0 THEN 'foil' ELSE 'nonfoil' END AS finish,
  gap >= 4 AND label % 2 = 1 AS sure FROM g
"""


def list_reads(spark: SparkSession, root: str) -> DataFrame:
    """Of every scanned entry: the printings of its nearest artwork, whether the
    index offered the printing somebody names for it, and whether the read
    settles it; and every printing the list needs a row of."""
    entries = materialize(_entries(spark, root), "entries")
    named = F.concat(F.floor(F.col("query_id") / 2).cast("string"), F.lit("b"))
    read = entries.select(
        F.col("query_id").cast("string").alias("what"), F.array_join(review.among(F.col("matched")), " ").alias("among"),
        review.offered(F.col("matched"), named).alias("offered"), review.sure(F.col("margin"), F.col("matched")).alias("sure"),
    )
    needed = review.referenced(entries.withColumn("named", named), "named")
    return read.unionByName(needed.select("id", F.lit(None).cast("string").alias("among"), F.lit(None).cast("boolean").alias("offered"), F.lit(None).cast("boolean").alias("sure")).withColumnRenamed("id", "what"))


LIST_READS = f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, artwork) AS place FROM d),
f AS (SELECT query_id, place, artwork, distance, label FROM r JOIN embeddings ON vec_id = artwork WHERE place <= 5),
m AS (SELECT query_id, max(CASE WHEN place = 2 THEN distance END) - max(CASE WHEN place = 1 THEN distance END) AS margin,
  bool_or(place = 1 AND label = 3) AS unnamed FROM f GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS at_ FROM f WHERE label <> 3),
e AS (SELECT query_id, max(CASE WHEN at_ = 1 THEN distance END) AS d1, max(CASE WHEN at_ = 2 THEN distance END) AS d2,
  max(CASE WHEN at_ = 1 THEN artwork END) AS art, max(CASE WHEN at_ = 1 THEN label END) AS label,
  bool_or(artwork = query_id // 2 AND n.label % 2 = 0) AS offered FROM n GROUP BY 1),
g AS (SELECT e.*, (CASE WHEN d2 IS NOT NULL THEN d2 - d1 WHEN unnamed THEN 0 ELSE margin END)::BIGINT AS gap FROM e JOIN m USING (query_id))
SELECT query_id::VARCHAR AS what, art || 'a' || CASE WHEN label % 2 = 0 THEN ' ' || art || 'b' ELSE '' END AS among, offered, gap >= 4 AND label % 2 = 1 AS sure FROM g
UNION ALL SELECT id, NULL, NULL, NULL FROM (SELECT (query_id // 2) || 'b' AS id FROM g UNION SELECT artwork || 'a' FROM n UNION SELECT artwork || 'b' FROM n WHERE label % 2 = 0)
"""


def hash_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every artwork in order against a store that lacks some, zeroed where absent."""
    index = _hashes(spark, root)
    store = index.filter(F.col("label") != 7).select("artwork", "hashes")
    rows = lookups.artwork_rows(index.select("artwork"), store, "artwork", "hashes", 2)
    return rows.select(
        "artwork", "present", F.bit_count(F.get("hashes", F.lit(0))).cast("long").alias("one"), F.bit_count(F.get("hashes", F.lit(1))).cast("long").alias("two")
    )


HASH_ROWS = f"""
SELECT vec_id AS artwork, label <> 7 AS present, CASE WHEN label <> 7 THEN bit_count({_word_sql("0")}) ELSE 0 END::BIGINT AS one,
  CASE WHEN label <> 7 THEN bit_count({_word_sql("0.05::FLOAT")}) ELSE 0 END::BIGINT AS two FROM embeddings
"""


def repeated_passages(spark: SparkSession, root: str) -> DataFrame:
    """Passages of documents that stand in the benchmark, by eight-word runs."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    items = table(spark, root, "benchmark").select("item_id", F.col("text").alias("item"))
    return passages.repeated_from(docs, items, "doc_id", "text", "item_id", "item").select(
        "doc_id", "source", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )


def _runs_sql(name: str, key: str, source: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS key, list_filter({WORDS_SQL}, lambda x: x <> '') AS w FROM {source}),
{name} AS (SELECT key, p AS start, array_to_string(w[p + 1 : p + 8], ' ') AS phrase
  FROM (SELECT key, w, unnest(range(0, len(w) - 7)) AS p FROM {name}_w))"""


SPANS_SQL = """
n AS (SELECT *, lag(source) OVER g AS ps, lag(start) OVER g AS pp FROM h WINDOW g AS (PARTITION BY key ORDER BY start)),
s AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> source OR start > pp + 8 THEN 1 ELSE 0 END)
  OVER (PARTITION BY key ORDER BY start) AS span FROM n)
SELECT key AS doc_id, any_value(source) AS source, min(start) AS start, max(start) + 8 AS "end" FROM s GROUP BY key, span"""

REPEATED_PASSAGES = f"""
WITH {_runs_sql("d", "doc_id", "documents")},
{_runs_sql("b", "item_id", "benchmark")},
f AS (SELECT phrase, min(key) AS source FROM b GROUP BY 1),
h AS (SELECT d.key, d.start, f.source FROM d JOIN f USING (phrase)),
{SPANS_SQL}
"""


def repeated_within(spark: SparkSession, root: str) -> DataFrame:
    """Passages each document repeats from an earlier one."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    return passages.repeated_within(docs, "doc_id", "text").select(
        "doc_id", "source", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
    )


REPEATED_WITHIN = f"""
WITH {_runs_sql("d", "doc_id", "documents")},
f AS (SELECT phrase, min(key) AS source FROM d GROUP BY 1),
h AS (SELECT d.key, d.start, f.source FROM d JOIN f USING (phrase) WHERE d.key <> f.source),
{SPANS_SQL}
"""


def fulltext_top_k(spark: SparkSession, root: str) -> DataFrame:
    """The fifty best documents for two word prefixes, by language, then score."""
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    kind = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    hits = fulltext.search_text(docs.withColumn("kind", kind), "doc_id", "text", "thé on", keep=["kind"])
    top = hits.withColumn("score", F.round("score", 6)).orderBy("kind", "score", "doc_id").limit(50)
    return top.select("doc_id", F.col("kind").cast("long").alias("kind"), "score")


FULLTEXT_TOP_K = """
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END::BIGINT AS kind,
  list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, kind, len(t) AS d, len(list_filter(t, lambda x: starts_with(x, 'the'))) AS f1,
  len(list_filter(t, lambda x: starts_with(x, 'on'))) AS f2 FROM t),
s AS (SELECT count(*) AS n, avg(d) AS a, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM c),
i AS (SELECT *, CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1,
  CASE WHEN ln((n - n2 + 0.5) / (n2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n2 + 0.5) / (n2 + 0.5)) END AS i2 FROM s),
r AS (SELECT doc_id, kind, round(0.0::DOUBLE - i1 * (f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / a)))
  - i2 * (f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / a))), 6) AS score FROM c, i WHERE f1 > 0 AND f2 > 0)
SELECT doc_id, kind, score FROM r ORDER BY kind, score, doc_id LIMIT 50
""".replace("\\\\", "\\")


#: Words, prefixes and words of several pieces asked of one index.
_ASKED_WORDS = ["the", "thé on", "a an", "de-la", "no-such on", "lorem", "in-th er"]


def fulltext_index(spark: SparkSession, root: str) -> DataFrame:
    """Several searches of one index of all documents: every document each finds, with its score."""
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    path = fresh_path(spark, "index")
    inverted.build_index(docs, "doc_id", "text", path, keep=["lang"])
    out = None
    for query in _ASKED_WORDS:
        hits = inverted.search_index(spark, path, "doc_id", query, keep=["lang"]).withColumn("query", F.lit(query))
        out = hits if out is None else out.unionByName(hits)
    return out.select("query", "doc_id", "lang", F.round("score", 6).alias("score"))


def _times_sql(word: str) -> str:
    pieces = fulltext.query_pieces(word)[0]
    here = " AND ".join([f"t[i + {j}] = '{p}'" for j, p in enumerate(pieces[:-1])] + [f"starts_with(t[i + {len(pieces) - 1}], '{pieces[-1]}')"])
    return f"len(list_filter(range(1, len(t) - {len(pieces) - 2}), lambda i: {here}))"


def _search_sql(n: int, query: str) -> str:
    words = query.split()
    f = [f"{_times_sql(w)} AS f{k}" for k, w in enumerate(words)]
    s = [f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(words))]
    i = [f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END AS i{k}" for k in range(len(words))]
    r = [f"- i{k} * (f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / a)))" for k in range(len(words))]
    return f"""
c{n} AS (SELECT doc_id, lang, len(t) AS d, {", ".join(f)} FROM t), s{n} AS (SELECT count(*) AS n, avg(d) AS a, {", ".join(s)} FROM c{n}),
i{n} AS (SELECT *, {", ".join(i)} FROM s{n}),
r{n} AS (SELECT '{query}' AS query, doc_id, lang, round(0.0::DOUBLE {" ".join(r)}, 6) AS score FROM c{n}, i{n} WHERE {" AND ".join(f"f{k} > 0" for k in range(len(words)))})"""


FULLTEXT_INDEX = f"""
WITH t AS (SELECT doc_id, lang,
  list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
{",".join(_search_sql(n, q) for n, q in enumerate(_ASKED_WORDS))}
{" UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(len(_ASKED_WORDS)))}
""".replace("\\\\", "\\")


QUERIES = {
    "hamming_top_k": (hamming_top_k, HAMMING_TOP_K),
    "recall_at_k": (recall_at_k, RECALL_AT_K),
    "recall_report": (recall_report, RECALL_REPORT),
    "distance_alike": (distance_alike, DISTANCE_ALIKE),
    "scan_entries": (scan_entries, SCAN_ENTRIES),
    "list_reads": (list_reads, LIST_READS),
    "hash_rows": (hash_rows, HASH_ROWS),
    "repeated_passages": (repeated_passages, REPEATED_PASSAGES),
    "repeated_within": (repeated_within, REPEATED_WITHIN),
    "fulltext_index": (fulltext_index, FULLTEXT_INDEX),
    "fulltext_top_k": (fulltext_top_k, FULLTEXT_TOP_K),
}
