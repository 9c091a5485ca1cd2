"""Passages one text repeats from another, by runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import RUN_WORDS
from ..functions.text import words
from .sizes import checked, spread


def _starts(list_: Column, run: int) -> Column:
    last = F.size(list_) - run
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _phrase(list_: Column, at: Column, run: int) -> Column:
    return F.array_join(F.slice(list_, at + 1, run), " ")


def word_runs(docs: DataFrame, key: str, text: str, run: int = RUN_WORDS) -> DataFrame:
    """(key, start, phrase) for every run of words of every text."""
    return _listed_runs(_listed(docs, key, text), key, run)


def _listed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return spread(docs.select(key, text)).select(key, words(F.col(text)).alias("_words"))


def _listed_runs(listed: DataFrame, key: str, run: int) -> DataFrame:
    each = F.transform(
        _starts(F.col("_words"), run),
        lambda at: F.struct(at.alias("start"), _phrase(F.col("_words"), at, run).alias("phrase")),
    )
    return listed.select(key, F.explode(each).alias("_r")).select(key, "_r.start", "_r.phrase")


def _named_runs(listed: DataFrame, key: str, run: int) -> DataFrame:
    """(key, start, high, low): the runs by names of 128 bits instead of their words."""

    def named(at: Column) -> Column:
        held = F.slice(F.col("_words"), at + 1, run)
        return F.struct(at.alias("start"), F.xxhash64(held).alias("high"), F.xxhash64(F.lit(run), held).alias("low"))

    return listed.select(key, F.explode(F.transform(_starts(F.col("_words"), run), named)).alias("_r")).select(key, "_r.*")


def first_seen_phrases(runs: DataFrame, key: str) -> DataFrame:
    """Which text, in key order, held each phrase first. A phrase many texts
    repeat is reduced before the shuffle."""
    return runs.groupBy("phrase").agg(F.min(key).alias("source"))


def merge_spans(hits: DataFrame, key: str, run: int = RUN_WORDS) -> DataFrame:
    """Overlapping or touching hits of one source as one passage.

    Each text's hits are one window partition, as long as the text at most."""
    w = Window.partitionBy(key).orderBy("start")
    before = F.lag(F.struct("source", "start")).over(w)
    fresh = before.isNull() | (before["source"] != F.col("source")) | (F.col("start") > before["start"] + run)
    placed = hits.withColumn("_new", fresh.cast("int"))
    placed = placed.withColumn("_span", F.sum("_new").over(w))
    return placed.groupBy(key, "_span").agg(
        F.first("source").alias("source"), F.min("start").alias("start"), (F.max("start") + run).alias("end")
    ).drop("_span")


def repeated_from(docs: DataFrame, sources: DataFrame, key: str, text: str, source_key: str, source_text: str, run: int = RUN_WORDS) -> DataFrame:
    """Passages of ``docs`` that occur in ``sources``: (key, source, start, end).

    Each phrase has one first source, so a text joins at most one row a run.
    Where the phrases are few enough to ship, the runs never leave their task.
    """
    seen = first_seen_phrases(word_runs(sources, source_key, source_text, run), source_key)
    hits = word_runs(docs, key, text, run).join(checked(seen), "phrase").select(key, "start", "source")
    return merge_spans(hits, key, run)


def repeated_within(docs: DataFrame, key: str, text: str, run: int = RUN_WORDS) -> DataFrame:
    """Passages each text repeats from an earlier one of the same collection.

    Every run is dealt once, by a name of 128 bits made of two hashes of its
    words; its words stay where they are. Where a name lies, the first text is
    told and only what repeats it goes on. Runs of equal names are not
    compared word by word.
    """
    # A text cut up is dealt at once, so it is never written as words.
    runs = _named_runs(_listed(docs, key, text), key, run)
    first = F.min(key).over(Window.partitionBy("high", "low"))
    hits = runs.withColumn("source", first).filter(F.col(key) != F.col("source")).select(key, "start", "source")
    return merge_spans(hits, key, run)
