"""File inventories, signals tables, exports and catalogue sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.schema import SIGNALS


def inventory(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """rel_path, size, mtime, sha256 of the files below `root` whose suffix matches in any case.

    The files' contents are read by the executors; nothing is listed or hashed on the driver but names.
    Spark's reader passes over files without any byte: they give no row.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    return found.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The signals of files from JSON lines, in which page numbers are strings: JSON has no other keys."""
    read = spark.read.schema(SIGNALS.replace("map<int,string>", "map<string,string>")).json(path)
    return read.withColumn("page_text", F.transform_keys("page_text", lambda k, _: k.cast("int")))


def has_text_layer(page_text: Column) -> Column:
    """Whether some page has more than 40 characters of text."""
    return F.coalesce(F.exists(F.map_values(page_text), lambda t: F.length(F.trim(t)) > 40), F.lit(False))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; * also crosses slashes."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "/_ " else "\\" + c) for c in glob) + "$"


def marked_ignored(rows: DataFrame, globs: dict[str, str], path: str = "rel_path") -> DataFrame:
    """`rows` with `skipped`, the reason why a path is ignored or a file unreadable; rows stay.  globs: pattern -> reason."""
    name = F.substring_index(F.col(path), "/", -1)
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error")) if "error" in rows.columns else F.lit(None).cast("string")
    for glob, why in globs.items():
        hit = F.rlike(F.col(path), F.lit(glob_regex(glob))) | F.rlike(name, F.lit(glob_regex(glob)))
        reason = F.coalesce(reason, F.when(hit, why))
    return rows.withColumn("skipped", reason)


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`key`, status: new, changed (size, hash, or a time more than a second apart), same, or missing."""
    o = old.select(*key, F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("sha256").alias("o_hash"), F.lit(True).alias("was"))
    n = new.select(*key, "size", "mtime", "sha256", F.lit(True).alias("now"))
    differs = (F.col("size") != F.col("o_size")) | (F.abs(F.col("mtime") - F.col("o_mtime")) > 1) | F.coalesce(F.col("sha256") != F.col("o_hash"), F.lit(False))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(differs, "changed").otherwise("same")
    return o.join(n, key, "full").select(*key, status.alias("status"))


def nested_export(pieces: DataFrame, fields: DataFrame) -> DataFrame:
    """file_id with its pieces, each with its resolved fields, ready for `write.json`.

    What there is of sources and alternatives of a field, and of confidence, notes and printed pages of a piece, is exported with them.
    """
    some = lambda df, *names: [c for c in names if c in df.columns]
    per_piece = fields.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "confidence", "conflict", *some(fields, "sources", "alternatives")))).alias("fields"))
    joined = pieces.join(per_piece, "piece_id", "left")
    return joined.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "page_end", "piece_id", "fields", *some(pieces, "confidence", "notes", "printed_start", "printed_end")))).alias("pieces"))


def authority_dump(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, title, place, claims and relations of a JSON-lines dump of authority records."""
    schema = "entry_id string, title string, credits string, place int, claims map<string,array<string>>, relations array<struct<kind:string,direction:string,other_id:string>>"
    return spark.read.schema(schema).json(path)


def write_catalogue(pieces: DataFrame, path: str) -> None:
    """Overwrites the partitions of the collections that `pieces` has, and no others."""
    pieces.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_id").parquet(path)
