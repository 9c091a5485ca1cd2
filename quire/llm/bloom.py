"""A one-hash Bloom filter whose size is fixed before the data are read.

The filter has a bounded number of slots, so what is broadcast never outgrows
``MAX_BITS / 8`` bytes. Past that load it lets more rows by; it never loses one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Slots at most: 2**28 bits are 32 MB on every executor.
MAX_BITS = 28
#: Slots a key, as a power of two.
SPARE = 4


def bits_for(keys: int) -> int:
    return min(MAX_BITS, max(16, int(keys).bit_length() + SPARE))


def slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def marks(slots: DataFrame, bits: int) -> np.ndarray:
    """The filter as a bitmap; ``slots`` has one long column.

    Each task sends the bytes it marked; equal ones merge before and after the
    shuffle, so at most 2**(bits - 3) short rows reach the driver.
    """
    rows = (
        slots.toDF("slot")
        .groupBy(F.shiftright("slot", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def hits(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``keys`` (int64) the filter may hold."""
    at = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def keep_marked(df: DataFrame, words: np.ndarray, key: str, bits: int, wanted: bool = True) -> DataFrame:
    """Rows whose ``key`` the filter may hold, or those it surely does not."""
    held = df.sparkSession.sparkContext.broadcast(words)

    def pick(batches):
        for batch in batches:
            got = hits(held.value, np.ascontiguousarray(batch.column(key).to_numpy(zero_copy_only=False)), bits)
            yield batch.filter(pa.array(got == wanted))

    return df.mapInArrow(pick, df.schema)
