"""Ranked full-text search: every word a prefix, all required, BM25."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bare, strip_marks
from ..session import materialize
from .sizes import spread

# --- fixed values: BM25 -------------------------------------------------------
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6


def tokens(text: Column) -> Column:
    """Lower-case words without marks: runs of letters and digits."""
    return F.filter(F.split(F.lower(strip_marks(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _pieces(word: str) -> list[str]:
    """A query word as the tokens it would be, worked out on the driver."""
    return re.findall(r"[^\W_]+", bare(word).lower())


def _occurrences(held: Column, pieces: list[str]) -> Column:
    """How often the pieces stand in a row, the last one as a prefix."""
    if len(pieces) == 1:
        return F.size(F.filter(held, lambda t: F.startswith(t, F.lit(pieces[0]))))
    last = F.size(held) - len(pieces)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(at: Column) -> Column:
        fits = F.startswith(F.get(held, at + len(pieces) - 1), F.lit(pieces[-1]))
        for i, piece in enumerate(pieces[:-1]):
            fits = fits & (F.get(held, at + i) == piece)
        return fits

    return F.size(F.filter(starts, here))


def search_text(docs: DataFrame, key: str, text: str, query: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows holding a word that starts with each query word, with their score
    (lower is better).

    Hits are counted inside each row, so nothing is exploded. What the score
    needs of the collection is one row of sums.
    """
    wanted = query_pieces(query)
    listed = spread(docs.select(key, *keep, text)).select(key, *keep, tokens(F.col(text)).alias("_t"))
    if not wanted:
        return listed.limit(0).select(key, *keep, F.lit(0.0).alias("score"))

    hits = {f"_f{i}": _occurrences(F.col("_t"), pieces) for i, pieces in enumerate(wanted)}
    # A few numbers a row, written once: the texts are read and cut up once.
    counted = materialize(listed.select(key, *keep, F.size("_t").alias("_d"), *[c.alias(n) for n, c in hits.items()]), "hits")
    stats = counted.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg("_d").alias("_avg"),
        *[F.count_if(F.col(n) > 0).alias(f"_n{n}") for n in hits],
    )
    return bm25(counted, stats, list(hits)).select(key, *keep, "score")


def query_pieces(query: str) -> list[list[str]]:
    """The words of a query, each as its tokens."""
    return [pieces for pieces in map(_pieces, query.split()) if pieces]


def bm25(counted: DataFrame, stats: DataFrame, hits: Sequence[str]) -> DataFrame:
    """Rows with every one of ``hits`` (how often each word stands) and their
    ``score``. ``_d`` is a row's length; ``stats`` is one row: how many rows
    there are, their mean length and how many have each word."""
    matched = F.lit(True)
    score = F.lit(0.0)
    for n in hits:
        matched = matched & (F.col(n) > 0)
        idf = F.log((F.col("_rows") - F.col(f"_n{n}") + 0.5) / (F.col(f"_n{n}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        weight = F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))
        score = score - idf * weight
    return counted.filter(matched).join(F.broadcast(stats)).withColumn("score", score)
