"""Full-text search from an index written once: which word stands where.

A file holds the places of some texts, sorted by word, so a word or a prefix is
a range of every file that a search reads by the bounds of the file's blocks;
a word that half of all texts hold lies in all files alike, and a text's hits
are counted before anything is shuffled. Texts are read when the index is built
and never again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .fulltext import bm25, query_pieces, tokens
from .sizes import spread

#: Bytes of places whose words a reader tells from their bounds.
BLOCK = 8 << 20


def build_index(docs: DataFrame, key: str, text: str, root: str, keep: Sequence[str] = ()) -> None:
    """Write the index of ``docs`` under ``root``: places (word, key, place,
    words of the text), rows (key, *keep) and the sums a score needs.

    ``key`` is unique. A text without words has a row and no places; one that
    is null counts as a row but not for the mean length. Names of ``keep`` must not be those of the index.
    """
    taken = {c.lower() for c in (key, *keep)} & {"_word", "_at", "_d"}
    if taken:
        raise ValueError(f"columns of the index itself: {sorted(taken)}")
    cut = spread(docs.select(key, *keep, text)).select(key, *keep, tokens(F.col(text)).alias("_t"))
    # Read for the rows and for the places; a text is cut up once.
    cut = materialize(cut, "words")
    cut.select(key, *keep, F.size("_t").alias("_d")).write.parquet(f"{root}/rows")
    places = cut.select(key, F.size("_t").alias("_d"), F.posexplode("_t").alias("_at", "_word"))
    # A text's places stay in the task that reads it: nothing is shuffled, and every file is in order by itself.
    places = places.sortWithinPartitions("_word", key, "_at")
    places.write.option("parquet.block.size", str(BLOCK)).parquet(f"{root}/places")
    rows = docs.sparkSession.read.parquet(f"{root}/rows")
    rows.agg(F.count(F.lit(1)).alias("_rows"), F.avg("_d").alias("_avg")).write.parquet(f"{root}/sums")


def _range(word: str, whole: bool) -> Column:
    """The words that are ``word``, or begin with it: in order, those from it up to the next that does not."""
    if whole:
        return F.col("_word") == word
    return (F.col("_word") >= word) & (F.col("_word") < word[:-1] + chr(ord(word[-1]) + 1))


def search_index(spark: SparkSession, root: str, key: str, query: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, score): what :func:`.fulltext.search_text` finds, from the index under ``root``."""
    wanted = query_pieces(query)
    rows = spark.read.parquet(f"{root}/rows")
    if not wanted:
        return rows.limit(0).select(key, *keep, F.lit(0.0).alias("score"))
    places = spark.read.parquet(f"{root}/places")
    found = None
    for i, pieces in enumerate(wanted):
        for j, piece in enumerate(pieces):
            some = places.filter(_range(piece, j + 1 < len(pieces))).select(key, "_d", F.lit(i).alias("_i"), (F.col("_at") - j).alias("_from"))
            found = some if found is None else found.unionByName(some)
    if any(len(pieces) > 1 for pieces in wanted):
        # Pieces of one word stand together where all of them reckon from one place.
        size = F.element_at(F.array(*[F.lit(len(p)) for p in wanted]), F.col("_i") + 1)
        found = found.groupBy(key, "_d", "_i", "_from").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size)
    hits = [f"_f{i}" for i in range(len(wanted))]
    # As many short rows as there are texts with any of the words.
    counted = materialize(found.groupBy(key).agg(F.max("_d").alias("_d"), *[F.count_if(F.col("_i") == i).alias(n) for i, n in enumerate(hits)]), "hits")
    holding = counted.agg(*[F.count_if(F.col(n) > 0).alias(f"_n{n}") for n in hits])
    stats = spark.read.parquet(f"{root}/sums").join(F.broadcast(holding))  # one row and one row
    scored = bm25(counted, stats, hits).select(key, "score")
    return scored.join(rows, key).select(key, *keep, "score") if keep else scored
