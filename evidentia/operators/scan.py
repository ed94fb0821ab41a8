"""One scan: signals of all collections to routed pieces, and the rows that need somebody's eye."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import paths as _paths  # noqa: F401  (registers its adapter)
from evidentia.operators import resolve
from evidentia.operators.candidates import ADAPTERS, Sides, pick_adapter
from evidentia.sources.files import marked_ignored
from evidentia.sources.scratch import stored

#: What a collection's default is worth; where other readings of the field exist it isn't used.
DEFAULT_WEIGHT = 0.60


@dataclass
class Scan:
    """candidates (piece_id, field, value, source, weight, seq, note, adapter); pieces (one row each, routed); problems (file_key, reason)."""

    candidates: DataFrame
    pieces: DataFrame
    problems: DataFrame


def adapters_of(signals: DataFrame, collections: DataFrame, sides: Sides) -> DataFrame:
    """collection_id, adapter: the one the collection names, else the one its files look like."""
    picked = pick_adapter(signals, sides).withColumnRenamed("adapter", "picked")
    return collections.select("collection_id", "adapter").join(picked, "collection_id", "full").select("collection_id", F.coalesce("adapter", "picked").alias("adapter"))


def candidates_of(signals: DataFrame, chosen: DataFrame, sides: Sides) -> DataFrame:
    """What the adapter of each file's collection says, by (file_key, page_start).

    Every adapter reads the files of its own collections alone, by a semi-join on the collection: where signals are stored by
    collection, Spark prunes the scan of each to its partitions.
    """
    parts = [ADAPTERS[name](signals.join(chosen.where(F.col("adapter") == name), "collection_id", "left_semi"), sides) for name in sorted(ADAPTERS)]
    return reduce(DataFrame.unionByName, parts)


def with_defaults(candidates: DataFrame, collections: DataFrame) -> DataFrame:
    """`candidates` with the defaults (map of field to value) of their collection for the fields that nothing is said about."""
    pieces = candidates.groupBy("collection_id", "file_key", "page_start").agg(F.max("page_end").alias("page_end"), F.collect_set("field").alias("fields"), F.min("adapter").alias("adapter"))
    said = collections.where("defaults IS NOT NULL").select("collection_id", F.explode("defaults").alias("field", "value")).where("trim(value) <> ''")
    missing = pieces.join(said, "collection_id").where(~F.array_contains("fields", F.col("field")))
    return candidates.unionByName(missing.select("collection_id", "file_key", "page_start", "page_end", "field", "value", F.lit("collection_default").alias("source"), F.lit(DEFAULT_WEIGHT).alias("weight"), F.lit(None).cast("string").alias("note"), "adapter", F.lit(1000).cast("long").alias("seq")))


def scan(signals: DataFrame, collections: DataFrame, sides: Sides | None = None, ignore: dict[str, str] | None = None) -> Scan:
    """Signals (see `schema.SIGNALS`) of any number of collections to routed pieces, nothing stored.

    collections: collection_id, adapter (null: by the look of its files), auto_accept, review_floor (null: the defaults), defaults (map, may be null).
    A file whose path matches a pattern of `ignore` (pattern -> reason) or that could not be read is a problem and makes no piece; so is one that no
    adapter has a word on, a candidate of an unknown field or weight, and a collection that names an adapter that isn't there.  An empty table gives empty
    tables.  Files that repeat a path are one file: their readings are pooled.
    """
    sides = sides or Sides()
    key = F.concat_ws("/", F.col("collection_id").cast("string"), "rel_path")
    marked = marked_ignored(signals, ignore or {})
    clean = marked.where("skipped IS NULL").drop("skipped")
    chosen = adapters_of(clean, collections, sides)
    # signals are parsed once: what was read from them is written, and all that follows reads it
    chosen = stored(chosen, "adapters")
    said = stored(candidates_of(clean, chosen, sides), "said")
    known = clean.select(key.alias("file_key")).distinct()
    # a file's key begins with its collection
    said = with_defaults(said.withColumn("collection_id", F.substring_index("file_key", "/", 1).try_cast("long")), collections)
    good, bad = resolve.valid(said.withColumn("piece_id", F.concat("file_key", F.lit("#"), F.col("page_start").cast("string"))))
    ids = good.groupBy("piece_id").agg(F.min("collection_id").alias("collection_id"), F.min("file_key").alias("file_key"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min("adapter").alias("adapter"))
    limits = ids.join(collections.select("collection_id", "auto_accept", "review_floor"), "collection_id", "left")
    fields = stored(resolve.resolve_fields(good), "fields")
    routed = resolve.resolve_pieces_of(fields, limits.select("piece_id", "auto_accept", "review_floor"))
    pieces = ids.join(routed, "piece_id").join(resolve.denormalise(fields), "piece_id")
    skipped = marked.where("skipped IS NOT NULL").select(key.alias("file_key"), F.col("skipped").alias("reason"))
    absent = clean.join(chosen.where(~F.col("adapter").isin(*ADAPTERS)), "collection_id").select(key.alias("file_key"), F.concat(F.lit("no adapter "), "adapter").alias("reason"))
    silent = known.join(said.select("file_key"), "file_key", "left_anti").join(absent, "file_key", "left_anti").select("file_key", F.lit("nothing recognised").alias("reason"))
    refused = bad.select("file_key", F.concat_ws(": ", "reason", "field").alias("reason"))
    kept = good.select("piece_id", "field", "value", "source", "weight", "seq", "note", "adapter")
    return Scan(kept, pieces, skipped.unionByName(absent).unionByName(silent).unionByName(refused))
