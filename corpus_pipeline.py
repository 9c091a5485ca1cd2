"""A corpus pipeline of five operators, each on all that the one before kept.

Rows are documents (doc_id, text, lang, source, n_chars, and any others, which
pass through whatever their names). Nulls, empty and very long texts, repeated
rows and empty tables are each operator's defined cases; see their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import crf, decontaminate, exact_dedup, packing, simhash_grid
from quire.llm.registry import table, tokenizer_path
from quire.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the field learns from the labelled ones of the whole table."""
    model = crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return crf.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_grid.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth the name."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the trained stage; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
