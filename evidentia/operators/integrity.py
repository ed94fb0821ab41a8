"""Integrity checks: each returns the rows that break a rule as (check, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What to do about a finding.
REMEDY = {
    "library copy missing": "run the filing plan again", "one file, several rows": "merge the rows", "no readable copy": "restore the file", "range past the end": "cut the file again",
    "work without pieces": "delete the work", "deleted entry is back": "delete it again", "decision not showing": "recompute the piece",
}


def _found(rows: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def missing_copies(files: DataFrame, inventory: DataFrame) -> DataFrame:
    gone = files.where("managed_path IS NOT NULL").join(inventory.select(F.col("path").alias("managed_path")), "managed_path", "left_anti")
    return _found(gone, "library copy missing", F.col("file_id"), F.col("managed_path"))


def shared_paths(files: DataFrame) -> DataFrame:
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    return _found(twice, "one file, several rows", F.col("path"), F.col("n"))


def unreadable(files: DataFrame, inventory: DataFrame, pieces: DataFrame) -> DataFrame:
    at = inventory.select("path")
    lost = files.join(at.withColumnRenamed("path", "managed_path"), "managed_path", "left_anti").join(at.withColumnRenamed("path", "source_path"), "source_path", "left_anti")
    return _found(lost.join(pieces.select("file_id"), "file_id", "left_semi"), "no readable copy", F.col("file_id"), F.col("source_path"))


def past_the_end(pieces: DataFrame, files: DataFrame) -> DataFrame:
    over = pieces.join(files.select("file_id", "page_count"), "file_id").where("page_count > 0 AND page_end > page_count")
    return _found(over, "range past the end", F.col("piece_id"), F.col("page_end"))


def orphan_works(works: DataFrame, pieces: DataFrame) -> DataFrame:
    return _found(works.join(pieces.select("work_id"), "work_id", "left_anti"), "work without pieces", F.col("work_id"), F.lit(None))


def revenants(pieces: DataFrame, removed: DataFrame) -> DataFrame:
    back = pieces.join(removed.select("file_id", "page_start").distinct(), ["file_id", "page_start"], "left_semi")
    return _found(back, "deleted entry is back", F.col("piece_id"), F.col("page_start"))


def hidden_decisions(shown: DataFrame, accepted: DataFrame) -> DataFrame:
    """shown and accepted: piece_id, field, value."""
    both = accepted.join(shown.withColumnRenamed("value", "shown"), ["piece_id", "field"], "left")
    return _found(both.where(~F.col("value").eqNullSafe(F.col("shown"))), "decision not showing", F.col("piece_id"), F.col("field"))


def report(findings: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` findings of each check, a row that counts the rest, and the remedy."""
    ranked = findings.withColumn("nth", F.row_number().over(Window.partitionBy("check").orderBy("subject", "detail")))
    shown = ranked.where(F.col("nth") <= limit).select("check", "nth", "subject", "detail")
    more = findings.groupBy("check").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    rest = more.select("check", F.lit(limit + 1).alias("nth"), F.lit("more").alias("subject"), (F.col("n") - limit).cast("string").alias("detail"))
    remedy = F.create_map(*[F.lit(x) for kv in REMEDY.items() for x in kv])
    return shown.unionByName(rest).withColumn("remedy", F.try_element_at(remedy, F.col("check")))


def verify(files: DataFrame, inventory: DataFrame, pieces: DataFrame, works: DataFrame, removed: DataFrame, shown: DataFrame, accepted: DataFrame, limit: int = 20) -> DataFrame:
    """All seven checks in one report: for each a row 0 with the number of rows it looked at, then its findings as in `report`.

    files: file_id, path, managed_path, source_path, page_count.  inventory: path.  pieces: piece_id, file_id, work_id, page_start, page_end.  works:
    work_id.  removed: file_id, page_start.  shown and accepted: piece_id, field, value.
    """
    findings = [missing_copies(files, inventory), shared_paths(files), unreadable(files, inventory, pieces), past_the_end(pieces, files), orphan_works(works, pieces), revenants(pieces, removed), hidden_decisions(shown, accepted)]
    all_ = findings[0]
    for more in findings[1:]:
        all_ = all_.unionByName(more)
    seen = [files.where("managed_path IS NOT NULL"), files, files, pieces, works, pieces, accepted]
    counts = None
    for check, rows in zip(REMEDY, seen, strict=True):
        one = rows.agg(F.count("*").cast("string").alias("detail")).select(F.lit(check).alias("check"), F.lit(0).alias("nth"), F.lit("checked").alias("subject"), "detail", F.lit(None).cast("string").alias("remedy"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.unionByName(report(all_, limit))
