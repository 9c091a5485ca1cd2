"""The numbered operators on the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import crf, debruijn, decontaminate, exact_dedup, filter_audit, gam, packing, periods, preference, sentencepieces, simhash_grid, suffix_dedup, url_reputation
from . import sql


#: Rows of an Arrow batch: texts are wide, and a batch is held whole.
BATCH = 1000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return spark.read.parquet(f"{root}/{name}.parquet")


def page_outcomes(spark, root) -> DataFrame:
    """Labelled pages: the number in a page's path names its document; bad if of
    low quality or toxic."""
    number = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    pages = table(spark, root, "pages").select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, root, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    )
    return pages.join(labels, "doc_id").select("url", "bad")


def op1_decontaminate(spark, root):
    found = decontaminate.judge(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def tokenizer_path() -> str:
    """The public byte-level vocabulary, where the machine has it."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark, root):
    return packing.pack(table(spark, root, "documents"), tokenizer_path())


def op2_url_reputation(spark, root):
    return url_reputation.judge(table(spark, root, "pages"), page_outcomes(spark, root)).drop("bound")


def op3_exact_dedup(spark, root):
    return exact_dedup.groups(table(spark, root, "documents"))


def op5_quality_gam(spark, root):
    return gam.judge(table(spark, root, "documents"), table(spark, root, "labels"))


def op6_toxicity_crf(spark, root):
    return crf.judge(table(spark, root, "documents"), table(spark, root, "labels")).drop("spans")


def op7_preference(spark, root):
    turns = preference.numbered(table(spark, root, "conversations"))
    return preference.format_pairs(turns, preference.alike(turns))


def op8_simhash_grid(spark, root):
    found = simhash_grid.near_groups(table(spark, root, "documents"))
    return found.select("doc_id", simhash_grid.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def covered_length(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op4_suffix_dedup(spark, root):
    found = suffix_dedup.remove(table(spark, root, "documents"))
    return found.select(
        "doc_id", "n_bytes", covered_length("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_debruijn(spark, root):
    found = debruijn.remove(table(spark, root, "documents"))
    return found.select("doc_id", "n_words", covered_length("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def pieces_path() -> str:
    """The public vocabulary of merges, where the machine has it."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_sentencepieces(spark, root):
    model = pieces_path()
    both = sentencepieces.decode(sentencepieces.encode(table(spark, root, "documents"), model), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("same") & F.col("same_decoded")).alias("as_library"),
    )


def op12_filter_audit(spark, root):
    return filter_audit.audit(spark, f"{root}/documents.parquet", table(spark, root, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """One document in ten repeats a stretch of its own words from some word on, as the contract of op13 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    held = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.nullif(F.size("words"), F.lit(0)))
    held = held.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    held = held.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    root = F.slice("words", F.col("a") + 1, F.col("p"))
    filled = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(root, times))), F.lit(1), F.col("n"))
    return held.select("doc_id", F.when(F.col("n") > 0, F.array_join(filled, " ")).otherwise(F.col("text")).alias("text"))


def op13_periods(spark, root):
    found = periods.runs(planted(table(spark, root, "documents")))
    best = F.aggregate(
        F.slice("runs", F.lit(2), F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda held, r: F.when(r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (
        found.withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


QUERIES = {
    "op1_decontaminate": (op1_decontaminate, None),
    "op2_url_reputation": (op2_url_reputation, sql.URL_REPUTATION),
    "op3_exact_dedup": (op3_exact_dedup, sql.EXACT_DEDUP),
    "op10_packing": (op10_packing, None),
    "op5_quality_gam": (op5_quality_gam, None),
    "op6_toxicity_crf": (op6_toxicity_crf, None),
    "op7_preference": (op7_preference, sql.PREFERENCE),
    "op9_debruijn": (op9_debruijn, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op8_simhash_grid": (op8_simhash_grid, None),
    "op11_sentencepieces": (op11_sentencepieces, None),
    "op12_filter_audit": (op12_filter_audit, sql.FILTER_AUDIT),
    "op13_periods": (op13_periods, None),
}
