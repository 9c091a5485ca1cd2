"""Luma planes and their hashes; numpy inside tasks, frames spread by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import HASH_INSETS, HASH_MIX, PROBE_SIZE

# --- fixed values: the hasher -------------------------------------------------
SIDE = 32
KEPT = 8


def luma_level(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel in whole numbers, rounded."""
    return F.floor((red * 2126 + green * 7152 + blue * 722 + 5000) / 10000).cast("int")


@lru_cache(maxsize=256)
def _taps(source: int, target: int) -> np.ndarray:
    """Triangle-filter weights as one matrix: target rows over source pixels."""
    ratio = np.float32(source / target)
    scale = max(ratio, np.float32(1))
    center = (np.arange(target, dtype=np.float32) + np.float32(0.5)) * ratio - np.float32(0.5)
    away = np.abs(np.arange(source, dtype=np.float32)[None, :] - center[:, None]) / scale
    weights = np.clip(np.float32(1) - away, 0, None).astype(np.float32)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    wide = plane.astype(np.float32) @ _taps(plane.shape[1], width).T
    grid = _taps(plane.shape[0], height) @ wide
    return np.clip(np.floor(grid + np.float32(0.5)), 0, 255).astype(np.float32)


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    k, n = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE)).astype(np.float32)


def _word(bits: np.ndarray) -> int:
    return int("".join("1" if b else "0" for b in bits), 2)


def perceptual_hash(plane: np.ndarray) -> int:
    """63 low frequencies against their upper median, the average left out."""
    freqs = _basis() @ resample(plane, SIDE, SIDE) @ _basis().T
    kept = freqs[:KEPT, :KEPT].ravel()[1:]
    return _word(kept > np.sort(kept)[len(kept) // 2])


def gradient_hash(plane: np.ndarray) -> int:
    """64 bits: whether each pixel of a 9 by 8 grid is brighter than the next."""
    grid = resample(plane, 9, 8)
    return _word((grid[:, :-1] > grid[:, 1:]).ravel())


def entry_hashes(plane: np.ndarray, insets: tuple[float, ...]) -> list[int]:
    """One hash an inset, each a margin cut off every side."""
    out = []
    for inset in insets:
        y, x = int(plane.shape[0] * inset), int(plane.shape[1] * inset)
        out.append(perceptual_hash(plane[y : plane.shape[0] - y, x : plane.shape[1] - x]))
    return out


def gradient_energy(plane: np.ndarray, step: int = 2) -> float:
    """Mean absolute gradient over a sampled grid; more where the frame is sharp."""
    held = plane.astype(np.int32)
    here = held[step::step, step::step]
    if here.size == 0:
        return 0.0
    across = np.abs(here - held[step::step, : held.shape[1] - step : step][:, : here.shape[1]])
    down = np.abs(here - held[: held.shape[0] - step : step, step::step][: here.shape[0]])
    return float((across.sum() + down.sum()) / (2 * here.size))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def fingerprint(insets: tuple[float, ...]) -> str:
    """What this hasher makes of a picture anyone can compute; stamped on every
    stored hash, so rows of another hasher are never compared."""
    width, height = PROBE_SIZE
    at = np.arange(width * height)
    red, green, blue = (((at % width) * a + (at // width) * d) % 251 for a, d in ((7, 11), (13, 5), (3, 17)))
    levels = (red * 2126 + green * 7152 + blue * 722 + 5000) // 10000
    held = 0
    for word in entry_hashes(levels.reshape(height, width).astype(np.uint8), insets):
        held = ((held ^ word) * HASH_MIX) & (2**64 - 1)
    return f"{held:016x}"


def hash_frames(frames: DataFrame, insets: tuple[float, ...]) -> DataFrame:
    """(id, hashes, gradient, energy, fingerprint) of (id, width, height,
    stride, luma) rows."""
    if len(insets) != len(HASH_INSETS):
        raise ValueError(f"an entry has {len(HASH_INSETS)} hashes")
    stamp = fingerprint(insets)
    key = frames.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one in batch.itertuples(index=False):
                plane = np.frombuffer(one.luma, dtype=np.uint8)[: one.stride * one.height]
                plane = plane.reshape(one.height, one.stride)[:, : one.width]
                words = [_signed(w) for w in entry_hashes(plane, insets)]
                rows.append((one.id, words, _signed(gradient_hash(plane)), gradient_energy(plane), stamp))
            yield pd.DataFrame(rows, columns=["id", "hashes", "gradient", "energy", "fingerprint"])

    return frames.select("id", "width", "height", "stride", "luma").mapInPandas(
        run, f"id {key}, hashes array<bigint>, gradient bigint, energy double, fingerprint string"
    )


def scan_planes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Raw luma planes, one a file, keyed by the file's name."""
    held = spark.read.format("binaryFile").load(path)
    return held.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("id"),
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.lit(width).alias("stride"),
        F.col("content").alias("luma"),
    )


def write_store(hashes: DataFrame, path: str) -> None:
    """Hashes by id, sorted, each with the stamp of what made it."""
    hashes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)


def read_store(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """The store, refused where another hasher wrote it or a key repeats."""
    held = spark.read.parquet(path)
    other = held.filter(~F.col("fingerprint").eqNullSafe(F.lit(stamp)))
    if not other.isEmpty():
        raise ValueError("the store was written by another hasher")
    if not held.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("the store holds a key twice")
    return held
