"""Preference pairs from conversations: one prompt, two masked completions.

Everything stays at the grain of turns, so a conversation of any length is never
gathered: turns are numbered, two conversations are laid side by side by an
aggregate on (pair, position), and the first position where they differ ends the
prompt. Numbering and running offsets spread a hot conversation over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import number_rows, ranked
from ..session import materialize

#: Role whose turns a completion is trained on.
TRAINED = "assistant"


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """(head, body): a turn's header and what follows it; the loss may cover the body alone."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n")), F.concat(text, F.lit("<|end|>\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: turns in order; nulls in role and text are empty.

    Rows that share a turn are ordered by role and text. Turns of no
    conversation (null conv_id) are left out.
    """
    plain = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return materialize(ranked(plain, ["conv_id"], order, rank="place").drop("turn"), "turns")


def alike(turns: DataFrame) -> DataFrame:
    """pair_id, conv_id, side: conversations paired with one that begins alike.

    Within a group of equal first turns, by their hash, conversations pair in
    the order of their ids; the last of an odd group is left over. Those left
    over, one a group, follow after all groups and pair among themselves in the
    order of hash and id, so they alone have a stranger for a partner. The
    earlier one is chosen over the next. With an odd number of conversations
    the very last has no partner and is left out: one completion is no pair.
    """
    first = turns.filter("place = 1").select("conv_id", F.md5(F.concat_ws("\n", "role", "text").cast("binary")).alias("code"))
    first = materialize(first, "first-turns")
    # one short row an odd group, joined on an id that no two rows share
    odd = materialize(
        first.groupBy("code").agg(F.max("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n % 2 = 1").select("conv_id", F.lit(1).alias("over")),
        "left-over")
    dealt = first.join(odd, "conv_id", "left").withColumn("over", F.coalesce("over", F.lit(0)))
    ranks = number_rows(dealt, [F.asc("over"), F.asc("code"), F.asc("conv_id")], "n")
    pairs = materialize(
        ranks.select(
            F.floor((F.col("n") - 1) / 2).alias("pair_id"), "conv_id",
            F.when(F.col("n") % 2 == 1, "chosen").otherwise("rejected").alias("side")),
        "pairs")
    whole = pairs.filter("side = 'rejected'").select("pair_id")
    return pairs.join(whole, "pair_id", "left_semi")


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, part, segment, role, rendered, start, mask_from, mask_to: a row a rendered turn.

    ``turns`` as :func:`numbered` gives them, ``pairs`` as :func:`alike`. The
    longest common prefix is the part ``prompt``, rendered once; the turns after
    it are the parts ``chosen`` and ``rejected``. ``start`` is the segment's
    offset in characters of its part. The loss covers the part's characters from
    ``mask_from`` to ``mask_to``: the bodies of the assistant's turns in
    completions, nothing elsewhere (both null). Equal conversations are all
    prompt; empty tables give no rows.
    """
    held = materialize(turns.join(pairs, "conv_id").select("pair_id", "side", "place", "role", "text"), "paired")
    turn = F.struct("role", "text")
    beside = held.groupBy("pair_id", "place").agg(F.count("*").alias("n"), F.min(turn).alias("a"), F.max(turn).alias("b"))
    same = (F.col("n") == 2) & (F.col("a") == F.col("b"))
    breaks = materialize(beside.groupBy("pair_id").agg(F.min(F.when(~same, F.col("place"))).alias("at")), "breaks")
    common = F.coalesce(F.col("place") < F.col("at"), F.lit(True))
    placed = held.join(breaks, "pair_id").filter(~common | (F.col("side") == "chosen")).withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
    head, body = render(F.col("role"), F.col("text"))
    rows = placed.select("pair_id", "part", F.col("place").alias("segment"), "role", F.concat(head, body).alias("rendered"), F.length(head).cast("long").alias("head"))
    out = ranked(rows, ["pair_id", "part"], [F.asc("segment")], rank=None, before={"start": F.length("rendered").cast("long")})
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED)
    return out.select(
        "pair_id", "part", "segment", "role", "rendered", "start",
        F.when(trained, F.col("start") + F.col("head")).alias("mask_from"),
        F.when(trained, F.col("start") + F.length("rendered")).alias("mask_to"),
    )
