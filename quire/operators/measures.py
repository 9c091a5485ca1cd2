"""Tallies, samples and summaries over any rows, by the names of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import folding, ranking

#: The cut that every row falls in.
ALL = "(all)"


def spread_sample(df: DataFrame, id: str, axes: dict[str, Column], keep: int, seed: str) -> DataFrame:
    """``keep`` rows for every value of every axis, each row named once.

    Rows rank by a hash of (seed, axis, value, id), so a value's choice does not
    depend on what else there is.
    """
    at = F.array(*[F.struct(F.lit(n).alias("axis"), c.cast("string").alias("value")) for n, c in axes.items()])
    melted = df.select(id, F.explode(at).alias("at")).select(id, "at.axis", "at.value")
    code = F.md5(F.concat_ws("|", F.lit(seed), "axis", "value", F.col(id).cast("string")))
    return ranking.best_per_group(melted, ["axis", "value"], [code.asc(), F.asc(id)], keep).select(id).distinct()


def totals_by(df: DataFrame, cuts: Sequence[Sequence[str]], total: str, level: str = "level") -> DataFrame:
    """Sums of one column by several cuts of the same columns in one pass; a
    null in a cut's column is a value of its own, told apart by ``level``."""
    names = list(dict.fromkeys(c for cut in cuts for c in cut))
    sets = df.groupingSets([[F.col(c) for c in cut] for cut in cuts], *[F.col(c) for c in names])
    return sets.agg(F.grouping_id().cast("long").alias(level), F.sum(total).alias(total)).select(level, *names, total)


def completeness(held: DataFrame, catalog: DataFrame, key: str, by: str, variant: str) -> DataFrame:
    """Per ``by``: how many of the catalog's keys there are, how many are held
    at least once, and how many variants of these are held."""
    worth = held.groupBy(key).agg(F.lit(1).cast("long").alias("_one"), F.count_distinct(variant).alias("_variants"))
    owned = worth.join(catalog.select(key, by), key).groupBy(by).agg(F.sum("_one").alias("owned"), F.sum("_variants").alias("treatments"))
    exists = catalog.groupBy(by).agg(F.count(F.lit(1)).alias("exists"))
    zero = F.lit(0)
    return exists.join(owned, by, "left").select(by, "exists", F.coalesce("owned", zero).alias("owned"), F.coalesce("treatments", zero).alias("treatments"))


def timing_summary(df: DataFrame, by: Sequence[str], took: str, found: Column) -> DataFrame:
    """Frames, worst, p50 and p90 of what each took, frames a second, and p50
    of those where ``found`` held."""
    half, most = folding.nearest_rank(0.5), folding.nearest_rank(0.9)
    hit = F.coalesce(found, F.lit(False))
    # Every frame once and a found one once more, so one ranking answers both.
    rows = df.select(*by, took, hit.alias("_found"), F.explode(F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_side"))
    cut = folding.quantiles(rows, [*by, "_side"], took, {"p50": half, "p90": most})
    all_, side = F.col("_side") == 0, F.col("_side") == 1
    cut = cut.groupBy(*by).agg(F.max(F.when(all_, F.col("p50"))).alias("p50"), F.max(F.when(all_, F.col("p90"))).alias("p90"), F.max(F.when(side, F.col("p50"))).alias("found"))
    size = df.withColumn("_found", hit).groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.max(took).alias("worst"), F.count_if("_found").alias("detected"),
        F.round(F.lit(1000.0) * F.count(F.lit(1)) / F.sum(took), 9).alias("rate"),
    )
    return size.join(cut, list(by), "left")


def recall_report(ranks: DataFrame, by: Sequence[str], rank: str = "rank", distance: str = "distance", margin: str = "margin") -> DataFrame:
    """Per group: queries asked, the shares that came back among the first 1, 5
    and 10, the worst rank, and the upper middle of distances and of margins."""

    def within(k: int) -> Column:
        return F.round(F.count_if(F.col(rank) <= k) / F.count(F.lit(1)), 9).alias(f"recall_{k}")

    rates = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"), within(1), within(5), within(10), F.max(rank).alias("worst"))
    for value in (distance, margin):
        rates = rates.join(folding.quantiles(ranks, list(by), value, {value: folding.upper_middle}), list(by), "left")
    return rates


def middles_and_ranges(df: DataFrame, by: str, values: dict[str, str]) -> DataFrame:
    """Per group, the upper median and the range of each column, under new names."""
    spans = df.groupBy(by).agg(*[F.round((F.max(c) - F.min(c)).cast("double"), 4).alias(f"{n}_range") for n, c in values.items()])
    for name, column in values.items():
        spans = spans.join(folding.quantiles(df, [by], column, {name: folding.upper_middle}), by)
    return spans


def masks_of_children(df: DataFrame, by: str, bits: dict[str, Column], count: str = "children") -> DataFrame:
    """Per parent, the union of each column of bits over its children, how
    many distinct bits that is, and how many children there are."""
    unions = [F.bit_or(c).cast("long").alias(n) for n, c in bits.items()]
    out = df.groupBy(by).agg(*unions, F.count(F.lit(1)).alias(count))
    return out.withColumns({f"{n}_held": F.bit_count(n).cast("long") for n in bits})


def words_after(df: DataFrame, text: Column, dash: str = "—", sides: str = "//") -> DataFrame:
    """word, uses: words after the dash on any side of a type line."""
    side = df.select(F.explode(F.split(text, sides)).alias("side"))
    tail = F.get(F.split("side", dash), F.lit(1))
    word = side.filter(tail.isNotNull()).select(F.explode(F.split(F.trim(tail), " ")).alias("word"))
    return word.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))


def part_keys(entries: DataFrame, whole: str, part: str, line: str) -> DataFrame:
    """Per (whole, part): the digest of the part's own entries, and a key of two
    hashes, the whole's and the part's, that the same entries give again."""
    wholes = folding.content_digest(entries, [whole], line).withColumnRenamed("digest", "_whole")
    parts = folding.content_digest(entries, [whole, part], line)
    head = lambda c: F.substring(c, 8, 16)
    return parts.join(wholes, whole).select(whole, part, "digest", F.concat(head("_whole"), F.lit("-"), head("digest")).alias("part_key"))


def stamped(digest: Column, moment: str) -> Column:
    """A digest that covers a moment too, so two alike at two times differ."""
    return F.concat(F.lit("sha256-"), F.sha2(F.concat(F.lit(moment), digest), 256))


def tally(df: DataFrame, tags: Column, hit: Column, middles: dict[str, str]) -> DataFrame:
    """Rows under each tag and under all of them: how many, the share that hit,
    and the upper median of each column under its new name."""
    tagged = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("tag", F.explode(F.concat(F.array(F.lit(ALL)), tags)))
    out = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("shots"), F.round(F.count_if("_hit") / F.count(F.lit(1)), 9).alias("hit_rate"))
    for name, column in middles.items():
        out = out.join(folding.quantiles(tagged, ["tag"], column, {name: folding.upper_middle}), "tag", "left")
    return out


def sweep(df: DataFrame, settings: Sequence[tuple[str, float, Column]]) -> DataFrame:
    """name, value, reason, n: how many rows each setting refuses, and why. A
    setting is a name, the value swept and the reason it gives a row; they are
    laid on each row and counted at once."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value"), r.alias("reason")) for n, v, r in settings])
    return df.select(F.explode(rows).alias("r")).select("r.*").groupBy("name", "value", "reason").agg(F.count(F.lit(1)).alias("n"))
