"""Batches of changes applied to tables.

Parquet has no MERGE, so each operator returns the new table; on a table format the same plan is a MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["piece_id", "field", "source", "value"]
PIECE_FIELD = ["piece_id", "field"]


def upsert_candidates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one key become one: the greatest weight, the newest note and adapter that aren't null.  Applying a batch twice changes nothing."""
    both = stored.unionByName(new, allowMissingColumns=True)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return both.groupBy(*KEY).agg(F.max("weight").alias("weight"), newest("note"), newest("adapter"), F.min("seq").alias("seq"), F.max("accepted").alias("accepted"))


def apply_decisions(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision (piece_id, field, value, source, seq) on a field is its only accepted candidate, with weight 1."""
    last = Window.partitionBy(*PIECE_FIELD).orderBy(F.col("seq").desc(), F.col("value"))
    chosen = decisions.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")
    touched = chosen.select(*PIECE_FIELD, F.lit(True).alias("touched"))
    cleared = stored.join(touched, PIECE_FIELD, "left").withColumn("accepted", F.when(F.col("touched"), False).otherwise(F.col("accepted"))).drop("touched")
    same = cleared.join(chosen.select(*KEY), KEY, "left_anti")
    return same.unionByName(chosen.select(*KEY, F.lit(1.0).alias("weight"), "seq", F.lit(True).alias("accepted")), allowMissingColumns=True)


def changed_only(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """Decisions whose value isn't what the piece (piece_id, field, value) shows already."""
    s = shown.select(*PIECE_FIELD, F.col("value").alias("shown"))
    return decisions.join(s, PIECE_FIELD, "left").where(~F.col("value").eqNullSafe(F.col("shown"))).drop("shown")


def retract(stored: DataFrame, retractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): candidates of (piece_id, field, source[, value]) go unless accepted; a null value means all.

    outcome has n, the rows withdrawn, for every retraction; 0 is an error for the caller to report.
    """
    r = retractions.select("piece_id", "field", "source", F.col("value").alias("only"))
    keys = ["piece_id", "field", "source"]
    wholly = r.where("only IS NULL").select(*keys).distinct()
    single = r.where("only IS NOT NULL").select(*keys, F.col("only").alias("value")).distinct()
    open_, kept = stored.where("NOT coalesce(accepted, false)"), stored.where("coalesce(accepted, false)")
    left = open_.join(wholly, keys, "left_anti").join(single, [*keys, "value"], "left_anti")
    whole_n = open_.groupBy(*keys).agg(F.count("*").alias("all_n"))
    value_n = open_.groupBy(*keys, F.col("value").alias("only")).agg(F.count("*").alias("one_n"))
    counted = r.join(whole_n, keys, "left").join(value_n, [*keys, "only"], "left")
    n = F.when(F.col("only").isNull(), F.col("all_n")).otherwise(F.col("one_n"))
    outcome = counted.select(*keys, F.col("only").alias("value"), F.coalesce(n, F.lit(0)).alias("n"))
    return left.unionByName(kept), outcome


def retire(stored: DataFrame, run: DataFrame, adapter: Column | str) -> DataFrame:
    """What an adapter no longer says: its unaccepted candidates that its new run lacks.  Others' rows are out of reach."""
    mine = stored.where((F.col("adapter") == adapter) & ~F.coalesce("accepted", F.lit(False)))
    spoken = run.select("piece_id").distinct()
    return mine.join(spoken, "piece_id", "left_semi").join(run.select(*KEY).distinct(), KEY, "left_anti")


def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select(*KEY), KEY, "left_anti")


def drop_removed(proposed: DataFrame, removed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed pieces (file_id, page_start) less the deleted ones, unless the piece is there after all."""
    key = ["file_id", "page_start"]
    standing = existing.select(*key).distinct()
    dead = removed.select(*key).distinct().join(standing, key, "left_anti")
    return proposed.join(dead, key, "left_anti")


def upsert_pieces(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """By (file_id, page_start): new ones enter, of known ones page_end follows unless a person confirmed it."""
    p = proposed.select("file_id", "page_start", F.col("page_end").alias("new_end"))
    both = existing.join(p, ["file_id", "page_start"], "full")
    end = F.when(F.coalesce("pages_confirmed", F.lit(False)), F.col("page_end")).otherwise(F.coalesce("new_end", "page_end"))
    return both.withColumn("page_end", end).withColumn("pages_confirmed", F.coalesce("pages_confirmed", F.lit(False))).drop("new_end")


def boundaries(marks: DataFrame) -> DataFrame:
    """file_id, page_start, page_end, title from marks (file_id, page_start, title, page_count, seq).

    Marks outside the file go, of two on a page the later counts, page 1 is a boundary always; a range ends before
    the next one starts, the last with the file.
    """
    files = marks.groupBy("file_id").agg(F.max("page_count").alias("page_count"))
    inside = marks.where("page_start BETWEEN 1 AND page_count").groupBy("file_id", "page_start").agg(F.max_by("title", "seq").alias("title"))
    firsts = files.join(inside.where("page_start = 1").select("file_id"), "file_id", "left_anti").select("file_id", F.lit(1).cast(inside.schema["page_start"].dataType).alias("page_start"), F.lit(None).cast("string").alias("title"))
    all_ = inside.unionByName(firsts).join(files, "file_id")
    following = F.lead("page_start").over(Window.partitionBy("file_id").orderBy("page_start"))
    return all_.withColumn("page_end", F.greatest(F.coalesce(following - 1, F.col("page_count")), F.col("page_start"))).select("file_id", "page_start", "page_end", "title")


def resplit(existing: DataFrame, cut: DataFrame) -> DataFrame:
    """file_id, page_start, status of a new cut against existing pieces (with `held`: reviewed or decided by a person).

    created, updated, unchanged, removed, or kept where a person has decided on a piece that the cut lacks.
    """
    e = existing.select("file_id", "page_start", F.col("page_end").alias("old_end"), "held")
    both = e.join(cut.select("file_id", "page_start", F.col("page_end").alias("new_end")), ["file_id", "page_start"], "full")
    status = F.when(F.col("old_end").isNull(), "created").when(F.col("new_end").isNull() & F.col("held"), "kept").when(F.col("new_end").isNull(), "removed").when(F.col("old_end") != F.col("new_end"), "updated").otherwise("unchanged")
    return both.withColumn("status", status)


def rename_authority(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """`column` through a mapping (old, new) of one row an old name."""
    return rows.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(*rows.columns)


def merge_aliases(authority: DataFrame, mapping: DataFrame) -> DataFrame:
    """Authority rows (name, aliases) after a merge: the survivor takes the others' names and aliases."""
    moved = authority.join(mapping.select(F.col("old").alias("name"), "new"), "name", "left")
    all_ = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("new").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    named = moved.select(F.coalesce("new", "name").alias("name"), F.explode_outer(all_).alias("alias"))
    return named.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("alias") != F.col("name"), F.col("alias")))).alias("aliases"))


def append_positions(items: DataFrame, adds: DataFrame) -> DataFrame:
    """New shelf items after the last position of their shelf; adding what is there does nothing."""
    new = adds.join(items, ["shelf_id", "piece_id"], "left_anti").groupBy("shelf_id", "piece_id").agg(F.min("seq").alias("seq"))
    ends = items.groupBy("shelf_id").agg(F.max("position").alias("last"))
    nth = F.row_number().over(Window.partitionBy("shelf_id").orderBy("seq", "piece_id"))
    placed = new.join(ends, "shelf_id", "left").withColumn("position", F.coalesce("last", F.lit(0)) + nth)
    return items.select("shelf_id", "piece_id", "position").unionByName(placed.select("shelf_id", "piece_id", F.col("position").cast(items.schema["position"].dataType).alias("position")))


def reorder(items: DataFrame, listed: DataFrame) -> DataFrame:
    """Positions 1..n: the pieces listed (shelf_id, piece_ids) in their order, then the others by id."""
    at = listed.select("shelf_id", F.posexplode("piece_ids").alias("nth", "piece_id")).groupBy("shelf_id", "piece_id").agg(F.min("nth").alias("nth"))
    order = Window.partitionBy("shelf_id").orderBy(F.col("nth").asc_nulls_last(), "piece_id")
    return items.select("shelf_id", "piece_id").join(at, ["shelf_id", "piece_id"], "left").withColumn("position", F.row_number().over(order)).drop("nth")


def replace_layers(layers: DataFrame, sent: DataFrame) -> DataFrame:
    """Annotation layers by (file_id, user_id, page), the user may be null; the last one sent counts, an empty one deletes."""
    key = ["file_id", "user_id", "page"]
    cols = [*key, "strokes", "seq"]
    last = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    both = layers.select(*cols).unionByName(sent.select(*cols))
    return both.withColumn("nth", F.row_number().over(last)).where((F.col("nth") == 1) & (F.size("strokes") > 0)).drop("nth")


def clean_strokes(strokes: Column, most_points: int = 5000, most: int = 2000) -> Column:
    """Points clamped to the page, strokes without points or of a width outside (0, 0.2] dropped, both counts bounded."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    points = lambda s: F.slice(F.transform(F.filter(s["points"], lambda p: F.size(p) >= 2), lambda p: F.array(unit(p[0]), unit(p[1]))), 1, most_points)
    made = F.transform(strokes, lambda s: F.struct(s["tool"].alias("tool"), s["color"].alias("color"), s["width"].alias("width"), points(s).alias("points")))
    return F.slice(F.filter(made, lambda s: (F.size(s["points"]) > 0) & (s["width"] > 0) & (s["width"] <= 0.2)), 1, most)


def inherit(candidates: DataFrame, pieces: DataFrame, fields: tuple[str, ...] = ("composer", "instrumentation", "form", "arranger", "publisher")) -> DataFrame:
    """For pieces without a word on a field: what the other pieces of their file say, each (field, value) once, best weight.

    The distinct sayings of a file are gathered first; pieces meet those, not each other.
    """
    of_file = candidates.where(F.col("field").isin(*fields)).join(pieces.select("piece_id", "file_id"), "piece_id")
    said = of_file.groupBy("file_id", "field", "value").agg(F.max("weight").alias("weight"))
    known = of_file.select("piece_id", "field").distinct()
    return pieces.select("piece_id", "file_id").join(said, "file_id").join(known, ["piece_id", "field"], "left_anti").select("piece_id", "field", "value", "weight")
