"""Nearest artworks by Hamming distance over several hashes a side."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, PandasCogroupedOps, SparkSession, Window, functions as F

from ..constants import APART, KEEP_NEAREST, SURE_MARGIN
from ..functions.shapes import settle_finish
from ..session import materialize
from .ranking import best_per_group

# Rows of each side one task compares at most, and of queries at least where there are cores to spare.
QUERY_BLOCK = 32_768
INDEX_BLOCK = 65_536
LEAST_QUERIES = 1_024
# Distances taken at a time: a tile that stays in a core's own cache, so what
# a task holds beside its blocks is under a megabyte.
TILE_ROWS = 16
TILE_COLUMNS = 4_096
# The same where ranks are counted: rows, and columns of three hashes each.
RANK_ROWS = 256
RANK_COLUMNS = 683
FAR = 75  # the top byte of a float from 2^23 to 2^24


def sign_hash(vector: Column, over: float = 0.0) -> Column:
    """64 bits, the first on top: whether each component is over a level."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.transform(
        vector, lambda x, i: F.when(x > over, F.call_function("shiftleft", one, (63 - i).cast("int"))).otherwise(none)
    )
    return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))


def _tiles(ask: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first query row, first index row, least distances over all their hashes)
    of every tile, by query rows; the distances are good until the next."""
    columns = np.ascontiguousarray(held.T)
    apart = np.empty((TILE_ROWS, TILE_COLUMNS), np.uint64)
    bits, best = np.empty(apart.shape, np.uint8), np.empty(apart.shape, np.uint8)
    for at in range(0, len(ask), TILE_ROWS):
        rows = ask[at : at + TILE_ROWS]
        for c in range(0, len(held), TILE_COLUMNS):
            some = columns[:, c : c + TILE_COLUMNS]
            here = np.s_[: len(rows), : some.shape[1]]
            best[here] = 255
            for a in range(ask.shape[1]):
                for h in range(len(some)):
                    np.bitwise_xor(rows[:, a, None], some[h], out=apart[here])
                    np.bitwise_count(apart[here], out=bits[here])
                    np.minimum(best[here], bits[here], out=best[here])
            yield at, c, best[here]


def _nearest_rows(ask: np.ndarray, held: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, distance) of the ``keep`` nearest index rows of each
    query row, ties by the lower. After a query's first tile only what is nearer
    than its farthest kept is looked at; of the same distance, later rows lose."""
    width, out = len(held), []
    for at, tiles in groupby(_tiles(ask, held), key=lambda tile: tile[0]):
        row, key = np.empty(0, np.int64), np.empty(0, np.int64)
        bound = np.full((TILE_ROWS, 1), 255, np.uint8)
        for _, c, apart in tiles:
            hit = apart < bound[: len(apart)]
            if c == 0 and apart.shape[1] > keep:
                hit = apart <= np.partition(apart, keep - 1, axis=1)[:, keep - 1 : keep]
            r, col = np.divmod(np.flatnonzero(hit), apart.shape[1])
            if not len(r):
                continue
            # Distance first, then number: one key orders both.
            row, key = np.concatenate([row, r]), np.concatenate([key, apart[r, col].astype(np.int64) * width + c + col])
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, key, place = (x[place < keep] for x in (row, key, place))
            full = place == keep - 1
            bound[row[full], 0] = key[full] // width
        out.append((row + at, key % width, key // width))
    return tuple(np.concatenate(part) for part in zip(*out))


def _matrix(column: pd.Series) -> np.ndarray:
    """Hash lists as one matrix; a shorter list repeats its first hash."""
    width = max(len(v) for v in column)
    rows = [list(v) + [v[0]] * (width - len(v)) for v in column]
    return np.array(rows, dtype=np.int64).view(np.uint64)


def _most(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and groups."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    return sizes["most"] or 0, sizes["groups"]


def _apart_in_partitions(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers, each dealt to a partition of its own where ``n`` partitions are dealt by their hash."""
    tries = n * (10 + math.ceil(math.log(n)))
    dealt = spark.range(tries).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    first = {r["p"]: r["id"] for r in dealt}
    return [first.get(p, tries + p) for p in range(n)]


def _paired(asked: DataFrame, ask: str, held: DataFrame, by: str, own: list[str], wider: tuple[int, int] = (1, 1)) -> PandasCogroupedOps:
    """Every block of ``asked`` beside every block of ``held``, dealt by a hash
    of ``ask`` and of ``by``, within each value of ``own``.

    Each row goes to as many tasks as the other side has blocks, so blocks are
    as large as they may be once there are some for every core. ``wider`` says
    how many times the usual rows a block of either side may have.
    """
    spark = asked.sparkSession
    questions, groups = _most(asked, own)
    rows, _ = _most(held, own)
    across = max(1, math.ceil(rows / (INDEX_BLOCK * wider[1])))
    wanted = math.ceil(4 * spark.sparkContext.defaultParallelism / (across * max(1, groups)))
    down = max(1, math.ceil(questions / (QUERY_BLOCK * wider[0])), min(wanted, math.ceil(questions / LEAST_QUERIES)))
    # A number of its own, as few bytes here are much work: partitions are not put together by size.
    parts = min(4_096, (1 if not own else 2 * max(1, groups)) * across * down)
    pairs = across * down
    names = _apart_in_partitions(spark, pairs) if pairs <= parts and not own else range(pairs)

    def dealt(df: DataFrame, column: str, own_block: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        both = df.select("*", F.pmod(F.xxhash64(column), F.lit(n)).alias(own_block)).select("*", every.alias(other))
        number = F.col("qb") * across + F.col("ib")
        block = number if isinstance(names, range) else F.get(F.lit(names).cast("array<bigint>"), number.cast("int"))
        return both.withColumn("block", block).drop("qb", "ib").repartition(parts, *keys)

    keys = ["block", *own]
    left, right = dealt(asked, ask, "qb", down, "ib", across), dealt(held, by, "ib", across, "qb", down)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def nearest(
    queries: DataFrame,
    index: DataFrame,
    query: str = "query_id",
    artwork: str = "artwork",
    hashes: str = "hashes",
    keep: int = KEEP_NEAREST,
    within: str | None = None,
) -> DataFrame:
    """The ``keep`` nearest artworks of each query: (query, place, artwork,
    distance), nearest first, ties by lower artwork number. Exact. ``within``
    names a column of both sides; then only artworks that hold the query's
    value of it are compared, and none where it is null.

    A whole query is compared with one artwork by the least distance over all
    pairs of their hashes. Queries that ask the same are asked once, and of
    artworks with the same hashes only the lowest ``keep`` numbers can ever be
    kept, so a group of copies costs no more than that. Both sides are cut
    into blocks; each pair of blocks is one bounded task that answers only
    ``keep`` rows a query, and the answers merge by a top-k.
    """
    own = [within] if within else []
    present = F.col(hashes).isNotNull()
    for c in own:
        present &= F.col(c).isNotNull()
    # Both are counted and joined; written once, no frame is hashed again for it.
    held = materialize(best_per_group(index.filter(present).select(artwork, hashes, *own), [hashes, *own], [F.asc(artwork)], keep), "held")
    asked = materialize(queries.select(hashes, *own).distinct(), "asked")

    def compare(ask: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or near.empty:
            return pd.DataFrame(columns=["ask", "artwork", "distance", *own], dtype=object)
        near = near.sort_values("artwork")
        rows, cols, apart = _nearest_rows(_matrix(ask["ask"]), _matrix(near["held"]), keep)
        found = {"ask": ask["ask"].to_numpy()[rows], "artwork": near["artwork"].to_numpy()[cols], "distance": apart}
        return pd.DataFrame(found).assign(**{c: ask[c].iloc[0] for c in own})

    kinds = "".join(f", `{c}` {index.schema[c].dataType.simpleString()}" for c in own)
    asked = asked.select(F.col(hashes).alias("ask"), *own)
    held = held.select(F.col(artwork).cast("long").alias("artwork"), F.col(hashes).alias("held"), *own)
    local = _paired(asked, "ask", held, "artwork", own).applyInPandas(compare, f"ask array<bigint>, artwork bigint, distance bigint{kinds}")
    w = Window.partitionBy("ask", *own).orderBy("distance", "artwork")
    # Written: who reads the answer twice does not compare again.
    best = materialize(local.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= keep), "nearest")
    return queries.select(query, F.col(hashes).alias("ask"), *own).join(best, ["ask", *own]).select(
        query, "place", F.col("artwork").alias(artwork), "distance"
    )


def nearest_alike(
    queries: DataFrame, index: DataFrame, label: str, query: str = "query_id", artwork: str = "artwork", hashes: str = "hashes"
) -> DataFrame:
    """(query, distance): least distance of each query to another artwork of its
    label over the whole index, whatever artworks of other labels lie nearer.

    A query that shares its number with an artwork is not its own answer;
    numbers of artworks are unique, so of the two nearest one is another. A
    query with no other artwork of its label gives no row.
    """
    two = nearest(queries, index, query, artwork, hashes, keep=2, within=label)
    return two.filter(F.col(artwork) != F.col(query)).groupBy(query).agg(F.min("distance").alias("distance"))


def least_distance(asked: Column, held: Column) -> Column:
    """The nearest any hash of one list comes to any of the other; null where either is null or empty."""
    return F.array_min(F.flatten(F.transform(asked, lambda a: F.transform(held, lambda h: F.bit_count(a.bitwiseXOR(h)))))).cast("long")


def _bits(words: np.ndarray) -> np.ndarray:
    """The bits of each hash, and a one."""
    out = np.ones((len(words), 65), np.float32)
    out[:, :64] = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1)
    return out


def _packed(words: np.ndarray) -> np.ndarray:
    """Three hashes a column, so that a row of :func:`_bits` times a column is a
    whole number under 2^24 whose float holds their distances in three bytes.

    Every sum on the way is a whole number under 2^24 too and so exact in a
    float, in whatever order a product takes them. The fourth byte is 75, and
    so are the bytes of hashes missing in the last column: further than any.
    """
    n, scale = -(-len(words) // 3), np.array([1, 1 << 8, 1 << 16], np.float32)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1)
    turns, ones = np.zeros((3 * n, 64), np.float32), np.full(3 * n, FAR, np.float32)
    turns[: len(words)] = 1 - 2 * bits.astype(np.float32)
    ones[: len(words)] = bits.sum(axis=1)
    out = np.empty((65, n), np.float32)
    out[:64] = (turns.reshape(n, 3, 64) * scale[:, None]).sum(axis=1).T
    out[64] = ones.reshape(n, 3) @ scale + (1 << 23)  # from here on a float's lowest bytes are its number
    return out


def _ranked(
    ask: np.ndarray, held: np.ndarray, copies: np.ndarray, bounds: np.ndarray, kinds: Sequence[tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every kind and query row: index rows nearer than its bound and those
    as far, each counted ``copies`` times, the least distance, and the least
    past the bound, which is only told where none is nearer and one as far."""
    shape = len(kinds), len(ask)
    nearer, same = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    least, beyond = np.full(shape, 255, np.int64), np.full(shape, 255, np.int64)
    needed = sorted({(a, h) for wide, high in kinds for a in range(wide) for h in range(high)})
    tiles = []
    for c in range(0, len(held), 3 * RANK_COLUMNS):
        some = held[c : c + 3 * RANK_COLUMNS]
        more = np.flatnonzero(copies[c : c + len(some)] > 1)
        # Where the copies' bytes lie, and what they count beside the first.
        tiles.append(([_packed(some[:, h]) for h in range(held.shape[1])], more // 3 * 4 + more % 3, (copies[c + more] - 1).astype(np.float64)))
    room = np.empty((len(needed), RANK_ROWS * RANK_COLUMNS), np.float32)

    def times(hit: np.ndarray, place: np.ndarray, extra: np.ndarray) -> np.ndarray:
        n = np.bitwise_count(hit.view(np.uint32)).sum(axis=1, dtype=np.int64)
        return n + (hit[:, place].astype(np.float64) @ extra).astype(np.int64) if len(place) else n

    for at in range(0, len(ask), RANK_ROWS):
        rows = [_bits(ask[at : at + RANK_ROWS, a]) for a in range(ask.shape[1])]
        here = slice(at, at + len(rows[0]))
        for columns, place, extra in tiles:
            size = len(rows[0]), columns[0].shape[1]
            apart, lowest = {}, {}
            for (a, h), out in zip(needed, room):
                apart[a, h] = np.matmul(rows[a], columns[h], out=out[: size[0] * size[1]].reshape(size)).view(np.uint8)
                lowest[a, h] = apart[a, h].min(axis=1)
            for k, (wide, high) in enumerate(kinds):
                pairs = [(a, h) for a in range(wide) for h in range(high)]
                first, bound = np.minimum.reduce([lowest[pair] for pair in pairs]), bounds[k, here]
                least[k, here] = np.minimum(least[k, here], first)
                beyond[k, here] = np.minimum(beyond[k, here], np.where(first > bound, first, 255))
                close = np.flatnonzero(first <= bound)
                if not len(close):
                    continue
                # Only these rows are looked at more closely.
                own, t = np.minimum.reduce([apart[pair][close] for pair in pairs]), bound[close, None].astype(np.uint8)
                less, level = times(own < t, place, extra), times(own == t, place, extra)
                nearer[k, at + close] += less
                same[k, at + close] += level
                alone = (less == 0) & (level == 1)
                past = own[alone] - (t[alone] + np.uint8(1))  # what is no further than the bound wraps round
                beyond[k, at + close[alone]] = np.minimum(beyond[k, at + close[alone]], past.min(axis=1).astype(np.int64) + t[alone, 0] + 1)
    return nearer, same, least, beyond


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Hash lists as one matrix; a shorter list repeats its first hash."""
    lists = column.combine_chunks()
    if lists.flatten().null_count:
        raise ValueError("a hash is null")
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    width = sizes.max()
    place = np.arange(width)
    starts = np.cumsum(sizes) - sizes
    return flat[starts[:, None] + np.where(place < sizes[:, None], place, 0)].view(np.uint64)


def true_ranks(
    queries: DataFrame,
    index: DataFrame,
    truth: str,
    query: str = "query_id",
    artwork: str = "artwork",
    hashes: str = "hashes",
    within: str | None = None,
    kinds: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """(query, distance, rank, margin) of every query with hashes whose true
    artwork, named in ``truth``, the index holds.

    ``rank`` is one more than the artworks nearer than the true one, however
    many those are; ``margin`` is how much further the nearest other artwork
    lies, under zero where it is nearer, null where there is none. Nothing is
    ranked: each pair of blocks answers a query with two counts and two least
    distances, and those add up. Artworks with the same hashes are compared once
    and queries that ask the same at the same distance are asked once.
    ``within`` as in :func:`nearest`; a number may occur once in each of its values.
    ``kinds`` names ways to compare, each by how many of a query's and of an
    artwork's first hashes it takes; every query is answered once a kind, named
    in a column ``kind``, and what kinds share is compared once.
    """
    own = [within] if within else []
    present = F.col(hashes).isNotNull()
    for c in own:
        present &= F.col(c).isNotNull()
    index = index.filter(present)
    held = materialize(index.groupBy(F.col(hashes).alias("held"), *own).agg(F.count(F.lit(1)).alias("n")), "held")
    true = index.select(F.col(artwork).alias(truth), F.col(hashes).alias("true"), *own)
    known = queries.select(query, F.col(hashes).alias("ask"), truth, *own).join(true, [truth, *own])
    ways = list((kinds or {"": (None, None)}).values())

    def first(column: str, n: int | None) -> Column:
        return F.col(column) if n is None else F.slice(column, 1, n)

    far = F.array(*[least_distance(first("ask", a), first("true", h)) for a, h in ways])
    known = materialize(known.select(query, "ask", *own, far.alias("far")).filter(F.exists("far", lambda d: d.isNotNull())), "known")
    asked = materialize(known.select("ask", "far", *own).distinct(), "asked")
    told = [f"{name}_{k}" for name in ("nearer", "same", "least", "beyond") for k in range(len(ways))]

    def compare(ask: pa.Table, near: pa.Table) -> pa.Table:
        if not near.num_rows:
            ask = ask.slice(0, 0)
        found = np.empty((4, len(ways), 0), np.int64)
        if ask.num_rows:
            index_words, query_words = _words(near["held"]), _words(ask["ask"])
            bounds = pc.fill_null(ask["far"].combine_chunks().flatten(), -1).to_numpy().reshape(-1, len(ways)).T
            widths = query_words.shape[1], index_words.shape[1]
            taken = [tuple(min(w, n or w) for w, n in zip(widths, way)) for way in ways]
            found = _ranked(query_words, index_words, near["n"].to_numpy(), bounds.astype(np.int16), taken)
        columns = [ask["ask"], ask["far"], *[pa.array(row) for part in found for row in part], *[ask[c] for c in own]]
        return pa.table(columns, ["ask", "far", *told, *own])

    kind = "".join(f", `{c}` {index.schema[c].dataType.simpleString()}" for c in own)
    schema = f"ask array<bigint>, far array<bigint>, {', '.join(f'{c} bigint' for c in told)}{kind}"
    local = _paired(asked, "ask", held, "held", own, (8, 2)).applyInArrow(compare, schema)
    sums = [(F.sum if c.startswith(("nearer", "same")) else F.min)(c).alias(c) for c in told]
    found = local.groupBy("ask", "far", *own).agg(*sums)

    def answer(k: int, name: str) -> Column:
        distance = F.get("far", F.lit(k))
        other = F.when(F.col(f"nearer_{k}") > 0, F.col(f"least_{k}")).when(F.col(f"same_{k}") > 1, distance).otherwise(F.col(f"beyond_{k}"))
        margin = F.when(other <= APART, other - distance)
        return F.struct(F.lit(name).alias("kind"), distance.alias("distance"), (F.col(f"nearer_{k}") + 1).alias("rank"), margin.alias("margin"))

    answers = F.explode(F.array(*[answer(k, name) for k, name in enumerate(kinds or [""])]))
    out = known.join(found, ["ask", "far", *own]).select(query, *own, answers.alias("a")).filter("a.distance IS NOT NULL")
    return out.select(query, *own, *["a.kind"] * bool(kinds), "a.distance", "a.rank", "a.margin")


def margins(matches: DataFrame, query: str = "query_id") -> DataFrame:
    """How far the runner-up is behind the best; alone, how far anything is."""
    first = F.max(F.when(F.col("place") == 1, F.col("distance")))
    second = F.max(F.when(F.col("place") == 2, F.col("distance")))
    return matches.groupBy(query).agg((F.coalesce(second, F.lit(APART)) - first).alias("margin"))


def scan_entries(found: DataFrame, query: str, margin: str = "margin") -> DataFrame:
    """One list entry a query out of ``found``: array<struct<distance, artwork,
    prints: array<struct<id, finishes>>>>, nearest first.

    Only artworks some printing carries can be named, and the margin is taken
    between those; where the very nearest names none and nothing follows, the
    read settles nothing.
    """
    named = F.filter("found", lambda m: F.size(m["prints"]) > 0)
    first, second = F.get(F.col("matched"), F.lit(0)), F.get(F.col("matched"), F.lit(1))
    nearest_named = F.size(F.get(F.col("found"), F.lit(0))["prints"]) > 0
    gap = (
        F.when(second.isNotNull(), second["distance"] - first["distance"])
        .when(~nearest_named, F.lit(0))
        .otherwise(F.col(margin))
    )
    lead = F.get(first["prints"], F.lit(0))
    held = found.withColumn("matched", named).filter(F.size("matched") > 0)
    return held.select(
        query,
        F.col("matched"),
        gap.alias("margin"),
        lead["id"].alias("chosen"),
        settle_finish(lead["finishes"]).alias("finish"),
        ((gap >= SURE_MARGIN) & (F.size(first["prints"]) == 1)).alias("sure"),
    )
