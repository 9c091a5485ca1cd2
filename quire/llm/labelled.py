"""A bounded sample of labelled documents, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One document in so many, by crc32 of its id, is never learnt from.
FOLDS = 5


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def least_hashes(df: DataFrame, code: Column, rows: int, *ties: str) -> DataFrame:
    """The ``rows`` rows of least ``code``, an even 64-bit hash.

    A count tells where about one and a half times as many hashes end; only
    those are sorted, so no task reads more than a few times ``rows``.
    """
    n = df.count()
    if n > 4 * rows:
        df = df.filter(code < int(-(2**63) + 2**64 * (1.5 * rows / n)))
    return df.orderBy(code, *ties).limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, label: at most ``rows`` labelled documents outside the held-out fold.

    The sample takes the least hashes of the id, so it is the same for the same
    labels. Null ids and labels are left out; an id labelled twice counts by its
    larger label.
    """
    wanted = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    chosen = least_hashes(wanted.groupBy(id).agg(F.max(F.col(label).cast("int")).alias("label")), F.xxhash64(id), rows, id)
    # at most `rows` short rows
    return docs.select(id, F.col(text).alias("text")).join(F.broadcast(chosen), id).select("text", "label")
