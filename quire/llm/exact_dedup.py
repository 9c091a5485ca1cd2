"""Exact duplicates by two passes of a Bloom filter.

Pass one marks slots that two or more texts fall in. Pass two splits rows by
the marks: a text in an unmarked slot is alone for certain and goes straight
through; only rows in marked slots are shuffled, and pre-aggregated before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from . import bloom
from .frames import fresh


def _texts(column) -> list[bytes]:
    return [(x or "").encode().lower() for x in column.to_pylist()]  # bytes.lower: A-Z only


def _digest(batch: pa.RecordBatch, text: str) -> tuple[pa.Array, pa.Array]:
    found = [hashlib.sha256(x).digest() for x in _texts(batch.column(text))]
    keys = np.frombuffer(b"".join(x[:8] for x in found), ">i8").astype(np.int64)
    return pa.array(found, pa.binary()), pa.array(keys)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, sha, key (the hash's first 64 bits), row: one short row a document, written once."""

    def run(batches):
        for batch in batches:
            sha, key = _digest(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column(id), sha, key], [id, "sha", "key"])

    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, sha binary, key bigint")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def repeated_marks(held: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap of the slots that more than one row of ``held`` falls in."""
    bits = bloom.bits_for(held.count())
    counted = held.groupBy(bloom.slot(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n"))
    return bloom.marks(counted.filter("n > 1").select("slot"), bits), bits


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its group of equal texts, equal after lower-casing A-Z.

    Null text is empty; of equal texts the row with the largest id stays (a
    null id only if there is no other), and of rows repeated with one id just
    one. An empty table gives no rows; only ``id`` and ``text`` are read, so
    other columns cannot clash.
    """
    held = digests(docs, id, text)
    marked, bits = repeated_marks(held)
    suspects = bloom.keep_marked(held, marked, "key", bits)
    alone = bloom.keep_marked(held, marked, "key", bits, False)
    found = materialize(
        suspects.groupBy("sha").agg(F.max(F.struct(id, "row")).alias("last"), F.count("*").alias("n")), "groups"
    )
    out = suspects.join(found, "sha").select(
        id, F.col(f"last.{id}").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out.unionByName(
        alone.select(
            id, F.col(id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row left of each group; columns as they were, clashing names too.

    The row with the largest id stays, a null id only if there is no other; of
    rows that share it the one with the largest text as it was written, then by
    the other columns, so no partitioning changes which. Null text is empty, an
    empty table stays empty.
    """
    marked, bits = repeated_marks(digests(docs, id, text))
    held = docs.sparkSession.sparkContext.broadcast(marked)
    sha = fresh(docs, "sha")
    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.BinaryType())])

    def run(batches):
        # In one pass, so a task needs one Python worker: the hash of a row that may be repeated, none of one that is alone.
        for batch in batches:
            found, key = _digest(batch, text)
            again = bloom.hits(held.value, key.to_numpy(), bits)
            found = pc.if_else(pa.array(again), found, pa.nulls(len(found), found.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, sha])

    hashed = docs.mapInArrow(run, schema)
    ordered = [c for c in docs.columns if c not in (id, text) and not _unordered(docs.schema[c].dataType)]
    last = (
        hashed.filter(F.col(sha).isNotNull())
        .groupBy(sha)
        .agg(F.max_by(F.struct(*docs.columns), F.struct(id, text, *ordered)).alias("last"))
    )
    alone = hashed.filter(F.col(sha).isNull()).select(*docs.columns)
    return alone.unionByName(last.select("last.*"))


def _unordered(kind: T.DataType) -> bool:
    """Whether values of a type have no order: maps, and what holds one."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, (T.MapType, T.VariantType)) or any(map(_unordered, inner))
