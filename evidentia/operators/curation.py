"""What a curator works with: lists and orders, the queue, decisions in bulk, approvals, and backfills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.catalog import folder, holds, top_per_group
from evidentia.operators.corrections import apply_decisions
from evidentia.operators.resolve import recompute, reviewed_route, valid
from evidentia.schema import REQUIRED_FIELDS


# --- lists and orders


def work_list(rows: DataFrame, looked_up: str, matched: str, retry: bool = False, names: DataFrame | None = None, key: str = "name", limit: int | None = None) -> DataFrame:
    """Rows still to be looked up: never yet, or with `retry` those looked up without a match; or just the named ones."""
    if names is not None:
        return rows.join(names.select(key).distinct(), key, "left_semi")
    todo = F.col(looked_up).isNull() | F.lit(retry) & F.col(matched).isNull()
    out = rows.where(todo)
    return out.orderBy(key).limit(limit) if limit is not None else out


def composer_list(composers: DataFrame, period: str | None = None, part: str | None = None) -> DataFrame:
    """Authority records of a period whose name contains a part, in any case, by sort name."""
    out = composers if period is None else composers.where(F.col("period") == period)
    out = out if part is None else out.where(holds(F.col("canonical_name"), part))
    return out.orderBy(F.col("sort_name").asc_nulls_last(), "canonical_name")


def telling_notes(notes: Column, benign: Sequence[str]) -> Column:
    """Notes without those that ask for nothing."""
    return F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda n: ~n.isin(*benign))


def order(name: str, tie: str = "piece_id") -> list[Column]:
    """title, uncertain (least certain first), recent (latest change first), folder (path, then page), movement."""
    keys = {
        "title": [F.col("title").asc_nulls_last()], "uncertain": [F.col("confidence").asc_nulls_first()], "recent": [F.col("updated_at").desc_nulls_last()],
        "folder": [F.col("rel_path").asc(), F.col("page_start").asc()], "movement": [F.col("movement").asc_nulls_last()],
    }
    return [*keys[name], F.col(tie).asc()]


def natural_key(system: str = "catalog_system", number: str = "catalog_number", suffix: str = "catalog_suffix", sub: str = "catalog_sub") -> Column:
    """A struct that sorts catalogue numbers as people do: 9 before 10, 10 before 10a."""
    return F.struct(F.col(system).alias("system"), F.col(number).alias("number"), F.coalesce(F.col(suffix), F.lit("")).alias("suffix"), F.coalesce(F.col(sub), F.lit(0)).alias("sub"))


def of_files(pieces: DataFrame, files: DataFrame, collections: DataFrame) -> DataFrame:
    """Pieces with their file and its collection."""
    return pieces.join(files, "file_id").join(collections, "collection_id")


def with_authorities(pieces: DataFrame, composers: DataFrame, works: DataFrame) -> DataFrame:
    """Pieces with what is known of their composer and work; both may be missing.  One row a name and a work."""
    c = composers.withColumnRenamed("canonical_name", "composer_name")
    return pieces.join(c, "composer_name", "left").join(works, "work_id", "left")


def folder_siblings(pieces: DataFrame, scope: str = "folder") -> DataFrame:
    """piece_id, sibling_id: other pending pieces of the same directory (not below it), or of the same file.

    pieces: piece_id, file_id, rel_path, review_state.
    """
    keyed = pieces.withColumn("key", folder(F.col("rel_path")) if scope == "folder" else F.col("file_id").cast("string"))
    other = keyed.where("review_state = 'pending'").select("key", F.col("piece_id").alias("sibling_id"))
    return keyed.select("key", "piece_id").join(other, "key").where("piece_id <> sibling_id").select("piece_id", "sibling_id")


def shelves_with_counts(shelves: DataFrame, items: DataFrame) -> DataFrame:
    """Shelves with the number of their items, empty ones too; items are counted before they meet the shelves."""
    counted = items.groupBy("shelf_id").agg(F.count("*").alias("items"))
    return shelves.join(counted, "shelf_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def layers_of_pieces(layers: DataFrame, pieces: DataFrame) -> DataFrame:
    """Annotation layers (file_id, page) within a piece's pages, with the page counted from the piece's first."""
    p = pieces.select("file_id", "piece_id", "page_start", "page_end")
    return layers.join(p, "file_id").where("page BETWEEN page_start AND page_end").withColumn("own_page", F.col("page") - F.col("page_start") + 1)


# --- counts


def work_counts(works: DataFrame) -> DataFrame:
    """One row: works, those with a catalogue number, looked up, and linked to either service."""
    return works.agg(
        F.count("*").alias("total"), F.count("catalog_number").alias("with_catalogue"), F.count("looked_up_at").alias("looked_up"), F.count("first_id").alias("linked_first"), F.count("second_id").alias("linked_second")
    )


def composer_counts(composers: DataFrame) -> DataFrame:
    return composers.agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"), F.count("portrait").alias("with_portrait"))


def scan_counts(marked: DataFrame) -> DataFrame:
    """One row: files seen, skipped, unreadable, catalogued, their pieces, and pieces by route.

    marked: skipped (a reason or null), error, pieces (array of routes).
    """
    unreadable, skipped = F.col("error").isNotNull(), F.col("skipped").isNotNull() & F.col("error").isNull()
    at = lambda r: F.sum(F.size(F.filter("pieces", lambda x: x == r)))
    return marked.agg(
        F.count("*").alias("seen"), F.count_if(skipped).alias("skipped"), F.count_if(unreadable).alias("unreadable"), F.count_if(~skipped & ~unreadable).alias("catalogued"),
        F.sum(F.size("pieces")).alias("pieces"), *[at(r).alias(f"route_{r}") for r in ("accept", "review", "hold")],
    )


def file_confidence(pieces: DataFrame) -> DataFrame:
    """A file is as sure as its least sure piece; 0 without any."""
    return pieces.groupBy("file_id").agg(F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"))


def filing_counts(plan: DataFrame) -> DataFrame:
    """One row over a filing plan: files planned, by action, and the bytes that would be copied."""
    acts = [F.count_if(F.col("action") == a).alias(a) for a in ("copy", "refile", "unchanged", "unreviewed")]
    return plan.agg(F.count("*").alias("planned"), *acts, F.coalesce(F.sum(F.when(F.col("action") == "copy", F.col("size"))), F.lit(0)).alias("bytes"))


# --- the queue


def queue_items(pieces: DataFrame, candidates: DataFrame, files: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Pieces with file facts, all candidates nested (by field, heaviest first), missing required fields, and rivals.

    rivals: for each field shown (piece columns `shown`: map of field to value) the candidates that say something else.  All
    candidates of a piece are gathered by one aggregation, none by a query for each piece.
    """
    said = F.struct("field", (-F.col("weight")).alias("order_"), "value", "source", "weight", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    of_piece = candidates.groupBy("piece_id").agg(F.array_sort(F.collect_list(said)).alias("said"), F.collect_set("field").alias("fields"))
    out = pieces.join(of_piece, "piece_id", "left").join(files, "file_id", "left")
    plain = F.transform(F.coalesce("said", F.array()), lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"), c["source"].alias("source"), c["weight"].alias("weight"), c["accepted"].alias("accepted")))
    rivals = F.filter("candidates", lambda c: ~c["value"].eqNullSafe(F.try_element_at(F.col("shown"), c["field"])))
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce("fields", F.array().cast("array<string>")))
    return out.withColumn("candidates", plain).withColumns({"missing": missing, "rivals": rivals}).drop("said", "fields")


def candidate_report(candidates: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces as a commit would leave them, rows with a problem and its reason); nothing is stored."""
    good, bad = valid(candidates)
    return recompute(good, pieces), bad


def propose(stored: DataFrame, new: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good proposals, rejected ones with a reason: unknown field, bad weight, or unknown piece)."""
    from evidentia.operators.corrections import upsert_candidates

    good, bad = valid(new)
    known = pieces.select("piece_id").distinct()
    unknown = good.join(known, "piece_id", "left_anti").withColumn("reason", F.lit("unknown piece"))
    return upsert_candidates(stored, good.join(known, "piece_id", "left_semi")), bad.unionByName(unknown)


# --- decisions


def decide_folder(pieces: DataFrame, decisions: DataFrame, scope: str = "folder") -> DataFrame:
    """Decisions (piece_id, field, value, source, seq) on a piece made for all its pending siblings too; nothing is approved.

    A piece follows the last decision of a folder that isn't its own: the last of all, or the last of another piece.  So these two of each
    folder and field are all that its pieces are joined to.
    """
    keyed = pieces.withColumn("key", folder(F.col("rel_path")) if scope == "folder" else F.col("file_id").cast("string"))
    # decisions go to their folder first: siblings of pieces that nothing was decided on are never paired
    cols = ["field", "value", "source", "seq"]
    sent = decisions.join(keyed.select("piece_id", "key"), "piece_id").select("key", F.col("piece_id").alias("from_id"), *cols)
    later = [F.col("seq").desc(), F.col("value").asc()]
    of_piece = top_per_group(sent, ["key", "field", "from_id"], later, 1).drop("place")
    sent = top_per_group(of_piece, ["key", "field"], later, 2).drop("place")
    pending = keyed.where("review_state = 'pending'").select("key", "piece_id")
    spread = sent.join(pending, "key").where("piece_id <> from_id").select("piece_id", *cols)
    both = decisions.select("piece_id", *cols).unionByName(spread)
    # a piece that several decisions reach follows the last of them
    last = Window.partitionBy("piece_id", "field").orderBy(F.col("seq").desc(), "value")
    return both.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def approve(pieces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pieces after verdicts (piece_id, state, reviewer, at, seq): the last verdict counts, and the route follows it."""
    last = verdicts.groupBy("piece_id").agg(F.max_by(F.struct("state", "reviewer", "at"), "seq").alias("v"))
    out = pieces.join(last, "piece_id", "left")
    state = F.coalesce("v.state", "review_state")
    return out.withColumns({"review_state": state, "reviewer": F.col("v.reviewer"), "reviewed_at": F.col("v.at"), "route": reviewed_route(F.col("route"), state)}).drop("v")


def upsert_collections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """By source_path: the adapter is refreshed, thresholds are overridden where given, new ones get the defaults."""
    n = new.select("source_path", F.col("adapter").alias("n_adapter"), F.col("auto_accept").alias("n_accept"), F.col("review_floor").alias("n_floor"))
    both = existing.join(n, "source_path", "full")
    return both.select("source_path", F.coalesce("n_adapter", "adapter").alias("adapter"), F.coalesce("n_accept", "auto_accept", F.lit(0.8)).alias("auto_accept"), F.coalesce("n_floor", "review_floor", F.lit(0.5)).alias("review_floor"))


def delete_pieces(pieces: DataFrame, gone: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces without the deleted ones, tombstones with theirs added): a later scan does not bring them back."""
    stones = pieces.join(gone.select("piece_id").distinct(), "piece_id", "left_semi").select("file_id", "page_start", "page_end")
    return pieces.join(gone.select("piece_id").distinct(), "piece_id", "left_anti"), removed.select("file_id", "page_start", "page_end").unionByName(stones).distinct()


def fill_from_work(pieces: DataFrame, works: DataFrame, seq: int) -> DataFrame:
    """Decisions that give pieces of a work its title (the external one before its own), key and form, where the piece has another."""
    w = works.select("work_id", F.coalesce("external_title", "title").alias("w_title"), F.col("music_key").alias("w_key"), F.col("form").alias("w_form"))
    joined = pieces.join(w, "work_id")
    pairs = [("title", "title", "w_title"), ("key", "music_key", "w_key"), ("form", "form", "w_form")]
    said = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).alias("value"), F.col(c).alias("shown")) for f, c, n in pairs])).alias("s")
    rows = joined.select("piece_id", said).select("piece_id", "s.*").where("value IS NOT NULL AND NOT (value <=> shown)")
    return rows.select("piece_id", "field", "value", F.lit("work").alias("source"), F.lit(seq).cast("long").alias("seq"))


def decided(stored: DataFrame, decisions: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate table, pieces) after decisions: the accepted values are set, and the pieces derived anew from all candidates."""
    table = apply_decisions(stored, decisions)
    return table, recompute(table, pieces)


# --- backfills


def to_file_pages(layers: DataFrame, pieces: DataFrame) -> DataFrame:
    """Annotation layers keyed by piece and its own page, moved to file and file page; layers of no piece go."""
    p = pieces.select("piece_id", "file_id", "page_start")
    return layers.join(p, "piece_id").withColumn("page", F.col("page") + F.col("page_start") - 1).drop("piece_id", "page_start")


def attribute_adapters(candidates: DataFrame, pieces: DataFrame, files: DataFrame, collections: DataFrame) -> DataFrame:
    """Unaccepted candidates without an adapter take that of their piece's collection."""
    of = pieces.select("piece_id", "file_id").join(files.select("file_id", "collection_id"), "file_id").join(collections.select("collection_id", F.col("adapter").alias("c_adapter")), "collection_id").select("piece_id", "c_adapter")
    open_ = F.col("adapter").isNull() & ~F.coalesce("accepted", F.lit(False))
    return candidates.join(of, "piece_id", "left").withColumn("adapter", F.when(open_, F.col("c_adapter")).otherwise(F.col("adapter"))).drop("c_adapter")


def backfill_by_id(works: DataFrame, dump: DataFrame, force: bool = False) -> DataFrame:
    """Titles and years of works from an authority dump (entry_id, title, year) by the id they have; known values stay unless forced."""
    d = dump.select(F.col("entry_id").alias("external_id"), F.col("title").alias("d_title"), F.col("year").alias("d_year"))
    pick = (lambda old, new: F.coalesce(new, old)) if force else F.coalesce
    return works.join(d, "external_id", "left").withColumns({"external_title": pick("external_title", "d_title"), "year": pick("year", "d_year")}).drop("d_title", "d_year")


def source_paths(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """file_id, path: the library copy if the inventory has it, else the original if it has that, else null."""
    at = lambda c: inventory.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}"))
    both = files.join(at("managed_path"), "managed_path", "left").join(at("source_path"), "source_path", "left")
    return both.select("file_id", F.when(F.col("has_managed_path"), F.col("managed_path")).when(F.col("has_source_path"), F.col("source_path")).alias("path"))
