"""The published catalog: rows, dictionaries beside them, and a manifest a
version that is written last.

A part is staged, named by what was written and renamed into place, so a live
one is never touched: a build that dies leaves the catalog before it readable,
and the one before that stays for readers that have just begun.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import ADDRESSED_PATTERN
from ..functions.masks import mask_words, words_mask
from ..operators.folding import table_fingerprint
from ..operators.lookups import artwork_rows, distinct_pairs
from ..operators.ranking import common_first, common_first_array, number_by_first_seen, number_dictionary
from ..operators.sizes import maybe_broadcast
from ..session import materialize

#: Words of a dictionary whose sets are kept as bits, and of one whose are kept as places.
MASK_WORDS, PLACE_WORDS = 63, 65_536
#: Manifests that keep their parts.
KEPT = 2
_STAGED, _MANIFESTS = "_staged", "manifests"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list:
    fs, at = _folder(spark, path)
    return list(fs.listStatus(at)) if fs.exists(at) else []


def _put(spark: SparkSession, staged: str, target: str) -> None:
    """Rename what is written whole into place; what is there already stays."""
    fs, to = _folder(spark, target)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    if fs.exists(to):
        fs.delete(source, True)
        return
    fs.mkdirs(to.getParent())
    if not fs.rename(source, to):
        raise OSError(f"{staged} could not be moved to {target}")


def write_part(df: DataFrame, root: str, kind: str, order: Sequence[Column] = ()) -> dict:
    """Write one part under a name its content decides; the same data comes to
    the same name however it was partitioned, and is then already there.

    ``df`` is computed once: the name is taken from the files as written.
    """
    spark = df.sparkSession
    staged = f"{root}/{_STAGED}/{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.parquet(staged)
    seal = table_fingerprint(spark.read.schema(df.schema).parquet(staged)).first()
    name = f"{kind}.{seal['hash']}.parquet"
    _put(spark, staged, f"{root}/{name}")
    return {"name": name, "rows": seal["rows"]}


def manifests(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests under ``root``, oldest first."""
    return sorted(int(s.getPath().getName()) for s in _children(spark, f"{root}/{_MANIFESTS}") if s.getPath().getName().isdigit())


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """The parts it names become the catalog the moment the manifest is renamed
    into place; a manifest that says what the last one says is not written."""
    held = manifests(spark, root)
    if held and read_manifest(spark, root) == manifest:
        return
    staged = f"{root}/{_STAGED}/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(staged)
    _put(spark, staged, f"{root}/{_MANIFESTS}/{(held or [0])[-1] + 1:08d}")


def read_manifest(spark: SparkSession, root: str, back: int = 0) -> dict:
    """The newest manifest, or the one so many before it."""
    held = manifests(spark, root)
    if len(held) <= back:
        raise LookupError(f"no catalog was published under {root}")
    return json.loads(spark.read.text(f"{root}/{_MANIFESTS}/{held[-1 - back]:08d}", wholetext=True).first()["value"])


def _words(spark: SparkSession, root: str, part: dict) -> list[str]:
    return [r["value"] for r in spark.read.parquet(f"{root}/{part['name']}").orderBy("position").collect()]  # MASK_WORDS at most


def _placed(arrays: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """(column, _column): each distinct array with the places of its words, in its own order."""
    each = arrays.select(column, F.posexplode(column).alias("_i", "value"))
    known = each.join(maybe_broadcast(words), "value").groupBy(column).agg(F.array_sort(F.collect_list(F.struct("_i", "position"))).alias("_p"))
    none = F.array().cast(f"array<{words.schema['position'].dataType.simpleString()}>")
    places = F.coalesce(F.col("_p.position"), none).alias(f"_{column}")
    return arrays.join(known, column, "left").select(column, places)


def write_catalog(
    df: DataFrame,
    root: str,
    version: str,
    encode: Sequence[str],
    order: Sequence[Column] = (),
    arrays: Mapping[str, str] = {},
    interned: Mapping[str, Sequence[str]] = {},
    artwork: Mapping | None = None,
) -> dict:
    """Rows with columns as places in dictionaries, published under a manifest.

    ``encode`` columns have commonest-first dictionaries. ``arrays`` columns
    have one over their words, and become ``"places"`` of these or, for sets of
    a few words, a ``"mask"``; a word that is null is in no dictionary and
    dropped. ``interned`` columns are whole values numbered by where they first
    come in the columns named for each. ``artwork`` is what :func:`artwork_part`
    came to. Nothing reads a part before the manifest names it.
    """
    spark = df.sparkSession
    # Read for every dictionary and for the rows; whatever it takes to come by them is done once.
    df = materialize(df, "published")
    parts, coded = {}, df

    def dictionary(column: str, words: DataFrame) -> DataFrame:
        parts[f"dict_{column}"] = write_part(words.select("position", "value"), root, f"dict_{column}")
        # The dictionary as written, so both sides agree on every place.
        return spark.read.parquet(f"{root}/{parts[f'dict_{column}']['name']}")

    for column in encode:
        held = dictionary(column, common_first(df.select(column), column))
        coded = coded.join(maybe_broadcast(held.select(F.col("value").alias(column), F.col("position").alias(f"_{column}"))), column, "left")
    for column, by in interned.items():
        held = dictionary(column, number_by_first_seen(df.select(column, *by), column, by, "position").withColumnRenamed(column, "value"))
        coded = coded.join(maybe_broadcast(held.select(F.col("value").alias(column), F.col("position").alias(f"_{column}"))), column, "left")
    for column, how in arrays.items():
        held = dictionary(column, common_first_array(df.select(column), column))
        size, limit = parts[f"dict_{column}"]["rows"], MASK_WORDS if how == "mask" else PLACE_WORDS
        if size > limit:
            raise ValueError(f"{column} has {size} words; kept as {how}, {limit} at most")
        if how == "mask":
            mask = words_mask(F.col(column), _words(spark, root, parts[f"dict_{column}"])).cast("long")
            coded = coded.withColumn(f"_{column}", F.when(F.col(column).isNotNull(), mask))
            continue
        # Arrays repeat: each different one is looked up once.
        different = materialize(df.select(column).filter(F.col(column).isNotNull()).distinct(), "arrays")
        coded = coded.join(maybe_broadcast(_placed(different, column, held)), column, "left")
    changed = {*encode, *interned, *arrays}
    rows = coded.select(*[F.col(f"_{c}").alias(c) if c in changed else F.col(c) for c in df.columns])
    parts["rows"] = write_part(rows, root, "rows", order)
    manifest = {"version": version, "fields": df.columns, "encoded": [*encode, *interned], "arrays": dict(arrays), "parts": parts}
    if artwork is not None:
        manifest["artwork"] = {**artwork, "version": version}
    write_manifest(spark, root, manifest)
    return manifest


def read_catalog(spark: SparkSession, root: str, fields: Sequence[str], back: int = 0) -> DataFrame:
    """Decoded rows. A reader's fields have to be the file's first ones, and
    the rows as many as the manifest says. ``back`` as in :func:`read_manifest`."""
    manifest = read_manifest(spark, root, back)
    if manifest["fields"][: len(fields)] != list(fields):
        raise ValueError(f"the catalog holds {manifest['fields']}, not {list(fields)}")
    rows = spark.read.parquet(f"{root}/{manifest['parts']['rows']['name']}").select(*fields)
    if rows.count() != manifest["parts"]["rows"]["rows"]:
        raise ValueError("the catalog holds another number of rows than its manifest says")
    changed = [c for c in [*manifest["encoded"], *manifest["arrays"]] if c in fields]
    for column in changed:
        part = manifest["parts"][f"dict_{column}"]
        how = manifest["arrays"].get(column)
        words = spark.read.parquet(f"{root}/{part['name']}")
        if how == "mask":
            rows = rows.withColumn(f"_{column}", F.when(F.col(column).isNotNull(), mask_words(F.col(column), _words(spark, root, part))))
        elif how == "places":
            different = rows.select(column).filter(F.col(column).isNotNull()).distinct()
            named = _placed(different, column, words.select(F.col("position").alias("value"), F.col("value").alias("position")))
            rows = rows.join(maybe_broadcast(named), column, "left")
        else:
            rows = rows.join(maybe_broadcast(words.select(F.col("position").alias(column), F.col("value").alias(f"_{column}"))), column, "left")
    return rows.select(*[F.col(f"_{c}").alias(c) if c in changed else F.col(c) for c in fields])


def artwork_part(prints: DataFrame, store: DataFrame, root: str, front: str = "front", back: str = "back", order: str = "seq", hashes: str = "hashes", width: int = 4, hasher: str = "") -> dict:
    """The artwork index of an export: every artwork's hashes at the number the
    export gave it, and which back goes with which front.

    Fronts are numbered by where they first come in ``order``; a back that is
    no front is numbered past them all, by its id. ``store`` holds (artwork,
    hashes); an artwork it lacks is zeroed and marked absent, as hashes of
    nothing but zeros are hashes too. Pairs are of two different artworks, each
    once, and a reader made with another ``hasher`` should refuse the part.
    """
    fronts = materialize(number_by_first_seen(prints, front, [order], "number").select(F.col(front).alias("artwork"), "number"), "fronts")
    n_fronts = fronts.count()
    two = prints.filter(F.col(front).isNotNull() & F.col(back).isNotNull() & (F.col(front) != F.col(back)))
    pairs = materialize(distinct_pairs(two.select(F.col(front).alias("front"), F.col(back).alias("back")), fronts.select(F.col("artwork").alias("front"))), "pairs")
    others = pairs.select(F.col("back").alias("artwork")).distinct().join(fronts, "artwork", "left_anti")
    others = number_dictionary(others, [F.asc("artwork")], "number").withColumn("number", F.col("number") - 1 + n_fronts)
    numbered = materialize(fronts.unionByName(others), "numbered")
    rows = artwork_rows(numbered, store.select(F.col("artwork"), F.col(hashes)), "artwork", hashes, width)
    made = write_part(rows.select("number", "artwork", "present", F.col(hashes).alias("hashes")), root, "artwork", [F.asc("number")])

    def number(side: str) -> DataFrame:
        return numbered.select(F.col("artwork").alias(side), F.col("number").alias(f"{side}_number"))

    beside = pairs.join(number("back"), "back").join(number("front"), "front").select("back_number", "front_number")
    backs = write_part(beside, root, "backs", [F.asc("back_number"), F.asc("front_number")])
    spark = prints.sparkSession
    absent = spark.read.parquet(f"{root}/{made['name']}").filter("NOT present").count()
    return {"hasher": hasher, "hashes": width, "rows": made["rows"], "fronts": n_fronts, "absent": absent, "backs": backs["rows"], "parts": {"artwork": made, "backs": backs}}


def read_artwork(spark: SparkSession, root: str, hasher: str = "") -> tuple[DataFrame, DataFrame]:
    """(artworks, backs) of the newest catalog; refused where another hasher filled it."""
    held = read_manifest(spark, root).get("artwork")
    if held is None:
        raise LookupError("the catalog has no artwork part")
    if held["hasher"] != hasher:
        raise ValueError(f"the artwork part was hashed by {held['hasher']}, not {hasher}")
    return tuple(spark.read.parquet(f"{root}/{held['parts'][k]['name']}") for k in ("artwork", "backs"))


def _named(manifest: dict) -> set[str]:
    return {p["name"] for m in (manifest, manifest.get("artwork") or {}) for p in m.get("parts", {}).values()}


def sweep(spark: SparkSession, root: str, settled: float, keep: int = KEPT) -> list[str]:
    """Delete the parts no kept manifest names, manifests past ``keep`` and
    stages, all of them older than ``settled`` seconds. The names deleted."""
    now = time.time() * 1000
    held = manifests(spark, root)
    named = set().union(*(_named(read_manifest(spark, root, back)) for back in range(min(keep, len(held)))))
    listing = [(s.getPath().getName(), (now - s.getModificationTime()) / 1000) for s in _children(spark, root)]
    kinds = "name string, age double"
    old = retention_sweep(spark.createDataFrame(listing, kinds), spark.createDataFrame([(n, 0.0) for n in named], kinds), "name", "age", settled)
    gone = [r.name for r in old.collect()]  # a few names a version
    gone += [f"{_MANIFESTS}/{n:08d}" for n in held[:-keep]]
    gone += [f"{_STAGED}/{s.getPath().getName()}" for s in _children(spark, f"{root}/{_STAGED}") if now - s.getModificationTime() >= settled * 1000]
    for name in gone:
        fs, at = _folder(spark, f"{root}/{name}")
        fs.delete(at, True)
    return sorted(gone)


def retention_sweep(listing: DataFrame, keep: DataFrame, name: str, age: str, settled: float) -> DataFrame:
    """What may go: a name of our own making, named by no manifest kept, and
    standing long enough. An unknown age counts as new."""
    ours = F.col(name).rlike(ADDRESSED_PATTERN) & F.coalesce(F.col(age) >= settled, F.lit(False))
    return listing.filter(ours).join(keep.select(name).distinct(), name, "left_anti")


def already_present(parts: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Each part marked held or to send; an unchanged manifest follows from
    there being nothing to send."""
    there = listing.select(name).distinct().withColumn("held", F.lit(True))
    return parts.join(there, name, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def same_parts(one: DataFrame, other: DataFrame, name: str) -> bool:
    a, b = one.select(name), other.select(name)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
