"""Numpy helpers for Arrow batches of text: words, rolling hashes, anchored runs.

Everything here works on a piece of one batch at a time, so memory is bounded by
the piece whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer document is a piece of its own.
PIECE = 1 << 18
_U = np.uint64
_SEED = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93  # 3 mod 8: its powers share few low bits
_MASK = (1 << 64) - 1
HIGH = _U(0xFFFFFFFF00000000)
LOW = _U(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


#: One word a byte value, for polynomial hashes.
BYTE_WORDS = mix(np.arange(1, 257, dtype=_U) * _U(_SEED))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, _U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_ODD), of(pow(_ODD, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, ``n`` of each or more."""
    return _powers(max(1 << 19, 1 << int(n).bit_length()))


def prefix(words: np.ndarray) -> np.ndarray:
    """``P`` such that ``span(P, a, b)`` hashes ``words[a:b]`` wherever it stands."""
    out = np.zeros(len(words) + 1, _U)
    np.cumsum(words * powers(len(words) + 1)[0][: len(words)], out=out[1:])
    return out


def span(p: np.ndarray, a, b) -> np.ndarray:
    return (p[b] - p[a]) * powers(len(p))[1][a]


def rolling(p: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive symbols."""
    n = len(p) - k
    return (p[k:] - p[:n]) * powers(len(p))[1][:n] if n > 0 else np.zeros(0, _U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text each.

    Yields (slice, bytes, bounds): row ``i`` of the slice is
    ``bytes[bounds[i]:bounds[i + 1]]``; a null text is empty.
    """
    column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    flat = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def byte_table(low: str, inside: bool) -> np.ndarray:
    """Which of the 256 bytes belong to words: those ``inside`` (or outside) a set."""
    out = np.full(256, not inside)
    out[list(low.encode("latin-1"))] = inside
    return out


#: Words are what stands between ASCII white space.
SPACED = byte_table(" \t\n\x0b\x0c\r", False)
#: Words are ASCII letters and digits and all beyond ASCII.
ALNUM = ~byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])), True)
#: A-Z to a-z, all else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(flat: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and where each row's begin.

    ``first`` has one entry more than rows: row ``i`` owns words
    ``first[i]:first[i + 1]``.
    """
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = table[flat]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[inside[1:][cut] & inside[:-1][cut]]  # a word on both sides of a row's border
    starts[cut] = ends[cut] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, bounds)


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in blocks that end between words."""
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + block, "right")))
        p = prefix(BYTE_WORDS[flat[base : end[j - 1]]])
        out[i:j] = span(p, start[i:j] - base, end[i:j] - base)
        i = j
    return mix(out)


def inner_windows(first: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
    """For window starts ``low <= i < high``: does the window stay within one row?"""
    edge = np.zeros(high - low + 1, np.int32)
    a = np.clip(first[:-1], low, high) - low
    b = np.clip(first[1:] - length + 1, low, high) - low
    ok = b > a
    np.add.at(edge, a[ok], 1)
    np.subtract.at(edge, b[ok], 1)
    return np.cumsum(edge[:-1]) > 0


def runs(symbols: np.ndarray, first: np.ndarray, length: int, gram: int, block: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """Cut all windows of ``length`` symbols into runs that share an anchor.

    The anchor of a window is its gram of ``gram`` symbols with the least hash,
    the leftmost if several. It depends on the window's content alone, so equal
    windows have equal anchors at equal offsets. Yields, block by block,
    (first window, last window, anchor's hash, hash of the whole run with its
    anchor's place, anchor's place after the first window's start); windows that cross a row's border are in no run.
    """
    n = len(symbols) - length + 1
    for low in range(0, max(n, 0), block):
        high = min(low + block, n)
        p = prefix(symbols[low : high + length - 1])
        keys = mix(rolling(p, gram))
        at = np.arange(len(keys), dtype=_U)
        least = sliding_min((keys & HIGH) | at, length - gram + 1)
        anchor = (least & LOW).astype(np.int64)
        inside = inner_windows(first, length, low, high)
        begins = inside.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(a):
            whole = mix(span(p, a, b + length) + mix(((anchor[a] - a).astype(_U) << _U(32)) + (b - a).astype(_U)))
            yield a + low, b + low, keys[anchor[a]], whole, anchor[a] - a
