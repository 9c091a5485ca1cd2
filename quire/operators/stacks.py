"""The algebra of owned copies: stacks keyed by identity that merge, fill up,
reconcile and spend."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_COPIES, MAX_LOTS, PART_CHARS, PART_ENTRIES
from ..functions.values import instant
from .folding import fold_in_order
from ..session import materialize
from .ranking import HOT_ROWS, ranked
from .sizes import BROADCAST_ROWS, maybe_broadcast


def _json(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    # Most words need no escaping, which is cheaper to see than to do.
    bare = text.rlike(r"^[^\"\\\x00-\x1F]*$")
    return F.when(text.isNull(), F.lit("null")).when(bare, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )


def stack_identity(
    printing: Column, finish: Column, condition: Column, container: Column, proxy: Column, tags: Column, note: Column
) -> Column:
    """Everything said about these copies in particular, as one text: absent
    equals absent, an unstated proxy is no proxy, tags compare sorted."""
    none = F.array().cast("array<string>")
    fields = [
        _json(printing),
        _json(finish),
        _json(condition),
        _json(container),
        F.coalesce(proxy, F.lit(False)).cast("string"),
        F.to_json(F.array_sort(F.coalesce(tags, none))),
        _json(note),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))


def _bins(policy: str, copies: int, lots: int, add_lots: bool):
    """The ordered part of filling: which bin each slim row goes to.

    ``first`` tries every open bin in order, ``only`` the first alone, ``last``
    the most recently opened. A fixed row opens a bin of its own.
    """

    def start():
        held: list[list[int]] = []  # [bin, copies, lots] of bins with room
        opened = 0

        def step(q: int, n: int, stay: bool) -> int:
            nonlocal opened
            tries = [] if stay else held if policy == "first" else held[:1] if policy == "only" else held[-1:]
            for one in tries:
                if one[1] + q <= copies and one[2] + n <= lots:
                    one[1] += q
                    if add_lots:
                        one[2] += n
                    if policy == "first" and one[1] >= copies:
                        # Nothing holds less than one copy, so it is done with.
                        held.remove(one)
                    return one[0]
            if policy != "only" or not held:
                held.append([opened, q, n])
                if policy == "last":
                    del held[:-1]
            opened += 1
            return opened - 1

        return step

    return start


def assign_bins(
    df: DataFrame,
    identity: str,
    order: str,
    quantity: Column,
    lots: Column,
    policy: str = "first",
    fixed: Column | None = None,
    copies: int = MAX_COPIES,
    max_lots: int = MAX_LOTS,
    add_lots: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``bin``: which stack of its identity each row lands in, in ``order``.

    ``order`` names a column unique in an identity. Three ways, by what an
    identity needs:

    - all of it fits one stack: bin 0, no ordering at all;
    - equal rows: the bin follows from the row's rank, which is spread over
      tasks where the identity is hot;
    - otherwise an ordered fold over (order, copies, lots) alone, streamed, so
      no group is ever held in memory. What the rows carry does not pass
      through it.
    """
    stay = F.lit(False) if fixed is None else F.coalesce(fixed, F.lit(False))
    rows = df.withColumns({"_q": quantity.cast("long"), "_l": F.coalesce(lots, F.lit(0)).cast("long"), "_f": stay})
    totals = rows.groupBy(F.col(identity).alias("_key")).agg(
        F.sum("_q").alias("_sq"),
        F.sum("_l").alias("_sl"),
        F.count_if("_f").alias("_held"),
        (F.min("_q") == F.max("_q")).alias("_eq"),
        (F.min("_l") == F.max("_l")).alias("_el"),
        F.max("_q").alias("_mq"),
        F.max("_l").alias("_ml"),
        F.count(F.lit(1)).alias("_n"),
    )
    tight = totals.filter((F.col("_sq") > copies) | (F.col("_sl") > max_lots) | (F.col("_held") > 1))
    even = F.col("_eq") & F.col("_el") & (F.col("_held") == 0) & (F.col("_mq") <= copies) & (F.col("_ml") <= max_lots)
    if policy == "only" or not add_lots:
        even = F.lit(False)
    room = F.least(
        F.floor(F.lit(copies) / F.col("_mq")),
        F.when(F.col("_ml") > 0, F.floor(F.lit(max_lots) / F.col("_ml"))).otherwise(F.lit(copies)),
    )
    # Written once: it is asked three small questions before it is joined.
    marked = materialize(tight.select("_key", "_n", F.when(even, room).alias("_room")), "tight")
    asked = marked.agg(
        F.count(F.lit(1)).alias("all"),
        F.count("_room").alias("even"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("most"),
    ).first()
    if asked["all"] == 0:
        return df.withColumn("bin", F.lit(0).cast("long"))
    small = F.broadcast(marked) if asked["all"] <= BROADCAST_ROWS else marked
    # The cast drops not-null marks inside a struct, which Arrow would insist on.
    place = F.col(order).cast(df.schema[order].dataType.simpleString())
    slim = rows.select(F.col(identity).alias("_key"), place.alias("_o"), "_q", "_l", "_f").join(small, "_key")
    # Eight bytes a row are dealt to look for equal ones; only where some are, the rows themselves.
    hashed = slim.select(F.xxhash64("_key", "_o").alias("_h")).groupBy("_h").count().filter("count > 1")
    if not hashed.isEmpty() and not slim.groupBy("_key", "_o").count().filter("count > 1").isEmpty():
        raise ValueError(f"{order} names two rows of one identity")

    placed = None
    if asked["even"] > 0:
        placed = ranked(
            slim.filter(F.col("_room").isNotNull()).select("_key", "_o", "_room"),
            ["_key"],
            [F.asc("_o")],
            "_r",
            hot=asked["most"] > hot_rows,
        ).select("_key", "_o", F.floor((F.col("_r") - 1) / F.col("_room")).cast("long").alias("bin"))
    if asked["even"] < asked["all"]:
        folded = fold_in_order(
            slim.filter(F.col("_room").isNull()), "_key", "_o", ["_q", "_l", "_f"], _bins(policy, copies, max_lots, add_lots), "bin"
        )
        placed = folded if placed is None else placed.unionByName(folded)
    placed = placed.select(F.col("_key").alias("_pk"), F.col("_o").alias("_po"), "bin")
    # (identity, order) is unique, so a hot identity spreads over this join.
    joined = df.join(placed, F.col(identity).eqNullSafe(F.col("_pk")) & F.col(order).eqNullSafe(F.col("_po")), "left")
    return joined.select(*df.columns, F.coalesce("bin", F.lit(0).cast("long")).alias("bin"))


def merge_bins(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    quantity: str = "quantity",
    lots: str | None = "lots",
    tags: str | None = None,
    created: str | None = None,
    updated: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One record a (identity, bin): copies add, histories join in date order,
    the earlier beginning and the later change stay.

    A bin holds at most as many rows as copies, so no group is unbounded. A
    row that merges with none keeps its tags and lots as written.
    """
    at = F.col(order)
    alone = F.count(F.lit(1)) == 1
    parts = [F.sum(quantity).cast("long").alias(quantity), F.count(F.lit(1)).alias("merged"), F.min(at).alias(order)]
    parts += [F.min_by(c, at).alias(c) for c in keep]
    if lots:
        gathered = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(lots).alias("lots"))))
        joined = F.flatten(F.transform(F.filter(gathered, lambda g: g["lots"].isNotNull()), lambda g: g["lots"]))
        dated = F.transform(
            joined,
            lambda lot, i: F.struct(
                F.coalesce(F.unix_micros(instant(lot["at"])), F.lit(-(1 << 62)).cast("long")).alias("m"),
                i.alias("i"),
                lot.alias("lot"),
            ),
        )
        ordered = F.transform(F.array_sort(dated), lambda d: d["lot"])
        parts.append(F.when(alone, F.min_by(lots, at)).otherwise(F.when(F.size(joined) > 0, ordered)).alias(lots))
    if tags:
        parts.append(F.when(alone, F.min_by(tags, at)).otherwise(F.array_sort(F.array_distinct(F.min_by(tags, at)))).alias(tags))
    if created:
        parts.append(F.min_by(created, F.struct(instant(F.col(created)), at)).alias(created))
    if updated:
        latest = F.struct(instant(F.col(updated)).alias("m"), F.col(updated).alias("text"))
        parts.append(F.max(F.when(F.col(updated).isNotNull(), latest))["text"].alias(updated))
    return df.groupBy(*by).agg(*parts)


def collapse(
    df: DataFrame,
    identity: str,
    order: str,
    quantity: str = "quantity",
    lots: str | None = "lots",
    copies: int = MAX_COPIES,
    max_lots: int = MAX_LOTS,
    policy: str = "first",
    hot_rows: int = HOT_ROWS,
    **columns,
) -> DataFrame:
    """One stack for each identity, and more of them only when a ceiling is met."""
    count = F.size(F.coalesce(F.col(lots), F.array().cast(df.schema[lots].dataType))) if lots else F.lit(0)
    placed = assign_bins(
        df, identity, order, F.col(quantity), count, policy, None, copies, max_lots, hot_rows=hot_rows
    )
    return merge_bins(placed, [identity, "bin"], order, quantity, lots, **columns)


def _two_sides(
    incoming: DataFrame, held: DataFrame, identity: str, order: str, quantity: str, lots: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Held and incoming stacks in one shape and one order: all that is held,
    by its own whole-number order, then what comes in, by any order it has.
    ``lots`` names each side's count of lots; without it no row has any."""
    some = (F.coalesce(F.col(lots), F.lit(0)) if lots else F.lit(0)).cast("long").alias("_lots")
    kind = incoming.schema[order].dataType.simpleString()
    id_kind = held.schema["held_id"].dataType
    # Records written together share an order; their ids tell them apart.
    ours = F.struct(
        F.lit(0).alias("side"), F.col(order).cast("long").alias("held"), F.col("held_id").alias("id"), F.lit(None).cast(kind).alias("at")
    )
    theirs = F.struct(
        F.lit(1).alias("side"), F.lit(None).cast("long").alias("held"), F.lit(None).cast(id_kind).alias("id"), F.col(order).cast(kind).alias("at")
    )
    return (
        held.select(identity, "held_id", quantity, some, ours.alias("_at")),
        incoming.select(
            identity, F.lit(None).cast(held.schema["held_id"].dataType).alias("held_id"), quantity, some, theirs.alias("_at")
        ),
    )


def reconcile(
    imported: DataFrame,
    held: DataFrame,
    identity: str,
    order: str,
    quantity: str = "quantity",
    copies: int = MAX_COPIES,
    policy: str = "first",
    lots: str | None = None,
    max_lots: int = MAX_LOTS,
) -> DataFrame:
    """What an import does to the collection: one row a record it touches.

    Held stacks come first in their identity and never join one another; an
    imported row joins the first stack with room for its copies and, where
    ``lots`` names their count on both sides, its lots. ``held_id`` names the
    record joined, or is null for a new one.
    """
    ours, theirs = _two_sides(imported, held, identity, order, quantity, lots)
    # Only identities the import names can change.
    near = ours.join(imported.select(identity).distinct(), identity, "left_semi")
    rows = near.unionByName(theirs)
    placed = assign_bins(rows, identity, "_at", F.col(quantity), F.col("_lots"), policy, F.col("_at.side") == 0, copies, max_lots)
    steps = placed.groupBy(identity, "bin").agg(
        F.max("held_id").alias("held_id"),
        F.sum(quantity).cast("long").alias("after"),
        F.sum(F.when(F.col("_at.side") == 0, F.col(quantity)).otherwise(0)).cast("long").alias("before"),
        F.count_if(F.col("_at.side") == 1).alias("rows"),
        *([F.sum("_lots").alias("lots_after")] if lots else []),
    )
    return steps.filter(F.col("rows") > 0)


def weigh(steps: DataFrame, held: DataFrame, quantity: str = "quantity") -> DataFrame:
    """A plan in six numbers, copies rather than records."""
    plan = steps.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("held_id").isNull()).alias("fresh"),
        F.count_if(F.col("held_id").isNotNull()).alias("joined"),
        F.coalesce(F.sum(F.col("after") - F.col("before")), F.lit(0)).cast("long").alias("adding"),
    )
    before = held.agg(F.coalesce(F.sum(quantity), F.lit(0)).cast("long").alias("before"))
    return plan.join(F.broadcast(before)).withColumn("after", F.col("before") + F.col("adding"))


def landing(
    held: DataFrame,
    waiting: DataFrame,
    identity: str,
    order: str,
    quantity: str = "quantity",
    copies: int = MAX_COPIES,
    lots: str | None = None,
    max_lots: int = MAX_LOTS,
) -> DataFrame:
    """The collection with waiting copies laid over it, never written: each
    identity's first stack takes what fits, by copies and by its own lots with
    the row's; the rest stand on their own."""
    ours, theirs = _two_sides(waiting, held, identity, order, quantity, lots)
    lead = ours.groupBy(identity).agg(F.min("_at").alias("_lead"))
    near = waiting.select(identity).distinct()
    first = ours.join(lead.join(near, identity, "left_semi"), identity).filter(F.col("_at").eqNullSafe(F.col("_lead"))).drop("_lead")
    placed = assign_bins(
        first.unionByName(theirs), identity, "_at", F.col(quantity), F.col("_lots"), "only", F.col("_at.side") == 0, copies, max_lots, add_lots=False
    )
    folded = placed.groupBy(identity, "bin").agg(
        F.max("held_id").alias("held_id"),
        F.sum(F.when(F.col("_at.side") == 0, F.col(quantity)).otherwise(0)).cast("long").alias("written"),
        F.sum(F.when(F.col("_at.side") == 1, F.col(quantity)).otherwise(0)).cast("long").alias("waiting"),
    )
    untouched = ours.join(folded.filter(F.col("held_id").isNotNull()).select("held_id"), "held_id", "left_anti").select(
        identity, "held_id", F.col(quantity).cast("long").alias("written"), F.lit(0).cast("long").alias("waiting")
    )
    return folded.select(identity, "held_id", "written", "waiting").unionByName(untouched)


def allocate(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    quantity: str,
    budget: str,
    take: str = "take",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Spend a group's budget on its rows in order: each takes what is left of
    it, up to its whole quantity. Fractions are cut off first and rows under
    one take nothing."""
    whole = F.greatest(F.lit(0), F.floor(F.col(quantity))).cast("long")
    placed = ranked(df, by, order, rank=None, before={"_spent": whole}, hot_rows=hot_rows)
    left = F.col(budget).cast("long") - F.col("_spent")
    return placed.withColumn(take, F.greatest(F.lit(0).cast("long"), F.least(whole, left))).drop("_spent")


def take_back(parts: DataFrame, wanted: DataFrame, part: str = "part_key", done: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What taking copies back out of waiting parts changes: (part, action, entries, taken), touched parts only.

    ``parts`` hold ``entries array<struct<position, identity, quantity, ...>>``
    and ``wanted`` (identity, copies). Copies come off an identity's entries by
    part and position until there are as many, whatever else an entry says it
    keeps; an entry without any left goes, and a part without entries is
    deleted. Parts in ``done``, already drained, are left alone and give none.
    """
    if done is not None:
        parts = parts.join(maybe_broadcast(done.select(part)), part, "left_anti")
    ask = wanted.groupBy("identity").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = parts.select(part, F.explode("entries").alias("_e"))
    # Only identities asked for are counted; a part is at most some hundred entries.
    named = rows.select(part, F.col("_e.position").alias("position"), F.col("_e.identity").alias("identity"), F.col("_e.quantity").alias("quantity"))
    spent = allocate(named.join(maybe_broadcast(ask), "identity"), ["identity"], [F.asc(part), F.asc("position")], "quantity", "copies", hot_rows=hot_rows)
    taken = spent.filter("take > 0").groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("position", "take"))).alias("_take"))

    def less(e: Column) -> Column:
        return e.withField("quantity", (e["quantity"] - F.coalesce(F.try_element_at("_take", e["position"]), F.lit(0))).cast(kind))

    kind = parts.schema["entries"].dataType.elementType["quantity"].dataType
    left = F.filter(F.transform("entries", less), lambda e: e["quantity"] > 0)
    return parts.join(taken, part).select(
        part, F.when(F.size(left) > 0, "update").otherwise("delete").alias("action"), left.alias("entries"),
        F.aggregate(F.map_values("_take"), F.lit(0).cast("long"), lambda n, t: n + t).alias("taken"),
    )


def owed(parts: DataFrame, done: DataFrame, part: str = "part_key", digest: str = "digest") -> DataFrame:
    """(digest, parts, entries, copies) still waiting of each import that has
    any: an import is planned as long as one of its parts is not drained."""
    left = parts.join(maybe_broadcast(done.select(part)), part, "left_anti")
    size = F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["quantity"])
    return left.groupBy(digest).agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size("entries")).alias("entries"), F.sum(size).alias("copies"))


def _next_fit(entries: int, chars: int):
    def start():
        part, count, size = 0, 0, 0

        def step(n: int) -> int:
            nonlocal part, count, size
            if count >= entries or (size + n > chars and count > 0):
                part, count, size = part + 1, 0, 0
            count, size = count + 1, size + n
            return part

        return step

    return start


def pack_parts(
    df: DataFrame, file: str, order: str, size: Column, entries: int = PART_ENTRIES, chars: int = PART_CHARS, block: int = 500_000
) -> DataFrame:
    """Add ``part``: entries packed in order, closing a part at ``entries`` of
    them or before ``chars`` is passed, never empty.

    A file under ``block`` entries is one streamed fold over sizes. A larger
    one is cut into blocks that are packed side by side for every way a part
    can straddle into them; see :func:`_pack_blocks`.
    """
    slim = df.select(F.col(file).alias("_key"), F.col(order).alias("_o"), size.cast("long").alias("_s"))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("_key", "_o")}
    schema = f"_key {kinds['_key']}, _o {kinds['_o']}, part long"
    counts = slim.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > block).select("_key")

    def fold(rows: DataFrame) -> DataFrame:
        return fold_in_order(rows, "_key", "_o", ["_s"], _next_fit(entries, chars), "part")

    if large.isEmpty():
        placed = fold(slim)
    else:
        small = maybe_broadcast(large)
        placed = fold(slim.join(small, "_key", "left_anti")).unionByName(
            _pack_blocks(slim.join(small, "_key", "left_semi"), entries, chars, block, schema)
        )
    placed = placed.select(F.col("_key").alias("_pk"), F.col("_o").alias("_po"), "part")
    return df.join(placed, (F.col(file) == F.col("_pk")) & (F.col(order) == F.col("_po"))).select(*df.columns, "part")


def _pack_blocks(slim: DataFrame, entries: int, chars: int, block: int, schema: str) -> DataFrame:
    """Exact packing of files too long for one task.

    A part spans at most ``entries`` rows, so the first part to start in a
    block starts in its first ``entries`` rows. Each block works out, for every
    such start, where the first part past its end starts and how many parts
    open on the way; those short tables are walked once in block order, and
    each block then numbers its own rows.
    """
    assert block >= entries
    numbered = materialize(ranked(slim, ["_key"], [F.asc("_o")], "_r", hot_rows=block), "packed")
    at = F.col("_r") - 1
    mine = numbered.withColumns({"_b": F.floor(at / block), "_i": at % block})
    # The rows after a block that its last part may reach into.
    ahead = mine.filter((F.col("_i") < entries) & (F.col("_b") > 0)).withColumns({"_b": F.col("_b") - 1, "_i": F.col("_i") + block})
    blocks = mine.unionByName(ahead)
    key = slim.schema["_key"].dataType.simpleString()

    def leaps(table: pa.Table) -> tuple[list[int], int]:
        """Where the next part starts if one starts at each row, by one sweep."""
        sizes = table.column("_s").to_pylist()
        inside = sum(1 for i in table.column("_i").to_pylist() if i < block)
        out, end, total = [0] * inside, 0, 0
        for start in range(inside):
            if end <= start:
                end, total = start + 1, sizes[start]
            while end < len(sizes) and end - start < entries and total + sizes[end] <= chars:
                total, end = total + sizes[end], end + 1
            out[start] = end
            total -= sizes[start]
        return out, inside

    def tables(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        jump, inside = leaps(table)
        land, parts = [0] * inside, [0] * inside
        for start in range(inside - 1, -1, -1):
            to = jump[start]
            land[start], parts[start] = (to - inside, 1) if to >= inside else (land[to], parts[to] + 1)
        first = min(entries, inside)
        return pa.table(
            {
                "_key": table.column("_key").slice(0, 1),
                "_b": table.column("_b").slice(0, 1),
                "_land": pa.array([land[:first]], type=pa.list_(pa.int64())),
                "_parts": pa.array([parts[:first]], type=pa.list_(pa.int64())),
            }
        )

    def walk():
        begin, part = 0, 0

        def step(land: list[int], count: list[int]) -> int:
            nonlocal begin, part
            at, held = begin, part
            if begin < len(land):
                begin, part = land[at], part + count[at]
            else:  # a short last block some earlier part covers whole
                begin -= len(land)
            return held * entries + at

        return step

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        jump, inside = leaps(table)
        part, start = divmod(table.column("_state")[0].as_py(), entries)
        out = [part - 1] * min(start, inside)
        while start < inside:
            to = min(jump[start], inside)
            out += [part] * (to - start)
            start, part = jump[start], part + 1
        held = table.slice(0, inside)
        return pa.table({"_key": held.column("_key"), "_o": held.column("_o"), "part": pa.array(out, type=pa.int64())})

    steps = blocks.groupBy("_key", "_b").applyInArrow(tables, f"_key {key}, _b long, _land array<long>, _parts array<long>")
    states = fold_in_order(steps, "_key", "_b", ["_land", "_parts"], walk, "_state")
    return blocks.join(states, ["_key", "_b"]).groupBy("_key", "_b").applyInArrow(number, schema)


def stack_index(held: DataFrame, later: DataFrame, identity: str, order: str) -> DataFrame:
    """One record an identity: the last of the later ones, else the first held."""
    columns = held.columns
    first = held.withColumn("_at", F.struct(F.lit(1), F.col(order).cast("long")))
    last = later.select(*columns).withColumn("_at", F.struct(F.lit(0), -F.col(order).cast("long")))
    rows = first.unionByName(last)
    record = F.min(F.struct("_at", *[c for c in columns if c != identity])).alias("_one")
    return rows.groupBy(identity).agg(record).select(identity, *[f"_one.{c}" for c in columns if c != identity])


def overlay_latest(base: DataFrame, newer: DataFrame, key: str, order: str) -> DataFrame:
    """Records with newer ones laid over them by key, the newest winning."""
    columns = [c for c in base.columns if c not in (key,)]
    rows = base.withColumn("_v", F.struct(F.lit(0), F.lit(0).cast("long"))).unionByName(
        newer.select(*base.columns, F.struct(F.lit(1), F.col(order).cast("long")).alias("_v"))
    )
    record = F.max(F.struct("_v", *columns)).alias("_one")
    return rows.groupBy(key).agg(record).select(key, *[f"_one.{c}" for c in columns])


def then_changes(first: DataFrame, second: DataFrame, key: str, dropped: str) -> DataFrame:
    """Two change sets in order: the later write of a key stands, and a key the
    second drops is only dropped."""
    rows = first.withColumn("_n", F.lit(0)).unionByName(second.withColumn("_n", F.lit(1)))
    columns = [c for c in first.columns if c not in (key, dropped)]
    write = F.max(F.when(~F.col(dropped), F.struct("_n", *columns))).alias("_w")
    gone = F.max(F.when(F.col(dropped), F.col("_n"))).alias("_gone")
    folded = rows.groupBy(key).agg(write, gone)
    # Only the second set's drops take back a write; the first's come before it.
    kept = F.col("_w").isNotNull() & ~F.coalesce(F.col("_gone") == 1, F.lit(False))
    return folded.select(key, kept.alias("written"), F.col("_gone").isNotNull().alias("dropped"), *[F.when(kept, F.col(f"_w.{c}")).alias(c) for c in columns])
