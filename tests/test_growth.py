"""Work that must grow with the rows, not with the pairs of rows that are alike."""

import os
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import catalog, curation, linking, resolve
from evidentia.sources import scratch

DATA = "/root/testdata/sf0.001"

# --- batch search

PIECE = "piece_id long, title string, composer_name string, catalog_display string, music_key string"


def test_words_are_counted_as_they_are_found(spark):
    pieces = spark.createDataFrame([(1, "Red bolt"), (2, "bolt red"), (3, "blue bolt"), (4, None), (4, ""), (5, "red"), (5, "red")], "piece_id long, title string")
    queries = spark.createDataFrame([(1, "bolt"), (2, "red, RED"), (3, "bolt Red"), (3, "red bolt"), (4, "none"), (5, ""), (6, None)], "query_id long, query string")
    counted = {r.query_id: r.hits for r in catalog.batch_word_counts(pieces, queries).collect()}
    assert counted == {1: 3, 2: 4, 3: 2}
    found = catalog.batch_words(pieces, queries).groupBy("query_id").agg(F.count("*").alias("hits"))
    assert {r.query_id: r.hits for r in found.collect()} == counted


def test_copies_are_counted_without_being_paired(spark):
    many = spark.range(300_000)
    pieces, queries = many.select(F.col("id").alias("piece_id"), F.lit("red bolt").alias("title")), many.select(F.col("id").alias("query_id"), F.lit("bolt").alias("query"))
    assert catalog.batch_word_counts(pieces, queries).agg(F.sum("hits")).first()[0] == 300_000**2


def test_a_query_or_piece_of_several_texts_is_met_by_each(spark):
    pieces = spark.createDataFrame([(1, "a waltz", None, None, None), (2, "a sonata", None, None, None), (3, "a waltz", None, None, None), (3, "a sonata", None, None, None), (None, "a waltz", None, None, None)], PIECE)
    queries = spark.createDataFrame([(1, "waltz"), (1, "sonata"), (2, "sonata"), (3, "Sonata "), (None, "waltz")], "query_id long, query string")
    got = sorted(tuple(r) for r in catalog.batch_search(pieces, queries).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]


def _common(spark, n, like):
    none = [F.lit(None).cast("string").alias(c) for c in ("composer_name", "catalog_display", "music_key")]
    return spark.range(n).select(F.col("id").alias("piece_id"), F.concat(F.lit("common song "), (F.col("id") % like).cast("string")).alias("title"), *none)


def test_no_table_of_hits_is_stored_or_shuffled(spark, tmp_path, monkeypatch):
    """Every query finds every piece: 3,000 x 48 hits, from tables of a few thousand rows at most."""
    monkeypatch.setattr(scratch, "shared_dir", lambda session: str(tmp_path))
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    queries = spark.range(48).select(F.col("id").alias("query_id"), F.concat(F.lit("song  "), F.substr(letters, (F.col("id") % 24 + 1).cast("int"), F.lit(3))).alias("query"))
    found = catalog.batch_search(_common(spark, 3_000, 3_000).withColumn("title", F.concat("title", F.lit(" "), letters)), queries)
    assert found.distinct().count() == found.count() == 3_000 * 48
    assert 3_000 <= max(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) <= 3_000 * 2
    # from the top of the plan down to where queries and pieces meet rows are only written out
    plan = found._jdf.queryExecution().executedPlan().toString()
    met = plan[: plan.index("Join")]
    assert "Generate explode" in met and "Exchange" not in met and "Scan" not in met


def test_lists_of_keys_are_cut_and_parts_of_both_sides_meet_once(spark, monkeypatch):
    for name, most in (("PIECE_KEYS", 3), ("QUERY_KEYS", 2), ("LOT", 4), ("SLOT", 2), ("TESTS", 5)):
        monkeypatch.setattr(catalog, name, most)
    queries = spark.createDataFrame([(i, ["common", "SONG", "walzer song", "song  common", "song 1"][i % 5]) for i in range(25)], "query_id long, query string")
    pieces = _common(spark, 60, 4).withColumn("title", F.when(F.col("piece_id") % 2 == 0, F.concat("title", F.lit(" valse waltz"))).otherwise(F.col("title")))
    got = sorted(tuple(r) for r in catalog.batch_search(pieces, queries).collect())
    ones = {1: lambda p: True, 0: lambda p: True, 2: lambda p: p % 2 == 0, 3: lambda p: True, 4: lambda p: p % 4 == 1}
    assert got == [(q, p) for q in range(25) for p in range(60) if ones[q % 5](p)]
    monkeypatch.setattr(catalog, "_small", lambda df, most=0: False)
    assert sorted(tuple(r) for r in catalog.batch_search(pieces, queries).collect()) == got


def test_queries_and_pieces_that_are_alike_are_met_once(spark):
    rows = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 1), (3, "x", 1), (3, "x", 1), (4, "y", 1), (None, "x", 1)], "id long, a string, b int")
    forms, members = catalog._alike(rows, "id", ["a", "b"], "test")
    assert sorted((r.like, r.a) for r in forms.collect()) == [(1, "x"), (3, "x"), (3, "y"), (4, "y")]
    assert sorted((r.id, r.like) for r in members.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


# --- siblings, decisions of folders, citations


def test_siblings_of_repeated_pieces_and_of_several_files(spark):
    rows = [(1, p, p) for p in range(1, 7)] + [(1, 2, 2), (2, 3, 0), (2, 9, 7), (3, 11, 1), (None, 12, 1), (None, 13, 1)]
    got = {}
    for r in catalog.siblings(spark.createDataFrame(rows, "file_id int, piece_id int, page_start int"), 3).collect():
        got.setdefault(r.piece_id, []).append(r.sibling_id)
    assert {p: sorted(s) for p, s in got.items()} == {1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4], 4: [1, 2, 3], 5: [1, 2, 3], 6: [1, 2, 3], 9: [3]}


def test_siblings_of_a_large_file(spark):
    pieces = spark.range(3000).select((F.col("id") % 2).alias("file_id"), F.col("id").alias("piece_id"), F.col("id").alias("page_start"))
    wide = catalog.siblings(pieces).groupBy("piece_id").agg(F.count("*").alias("n"), F.min("sibling_id").alias("least")).where("piece_id IN (0, 1, 2, 2999)").collect()
    assert {(r.piece_id, r.n, r.least) for r in wide} == {(0, 50, 2), (1, 50, 3), (2, 50, 0), (2999, 50, 1)}


def test_a_folder_of_many_decisions_is_not_paired(spark):
    n = 60_000
    pieces = spark.range(n).select(F.col("id").alias("piece_id"), F.lit(1).alias("file_id"), F.lit("a/b.pdf").alias("rel_path"), F.when(F.col("id") % 5 == 0, "accepted").otherwise("pending").alias("review_state"))
    made = spark.range(n).where("id % 2 = 0").select(F.col("id").alias("piece_id"), F.lit("title").alias("field"), F.col("id").cast("string").alias("value"), F.lit("user").alias("source"), F.col("id").alias("seq"))
    got = {r.piece_id: r.value for r in curation.decide_folder(pieces, made).select("piece_id", "value").collect()}
    last = n - 2
    want = {i: str(last) if i == last or i % 5 else str(i) for i in range(n) if i % 2 == 0 or i % 5}
    assert got == want


def test_the_last_decision_of_another_piece_counts(spark):
    pieces = spark.createDataFrame([(i, 1, "a/x.pdf", "pending") for i in range(4)], "piece_id int, file_id int, rel_path string, review_state string")
    made = spark.createDataFrame([(0, "title", "late", "u", 9), (0, "title", "later", "u", 10), (1, "title", "b", "u", 5), (1, "key", "c", "u", None), (2, "key", "d", "u", 1)], "piece_id int, field string, value string, source string, seq int")
    got = {(r.piece_id, r.field): r.value for r in curation.decide_folder(pieces, made).collect()}
    assert got == {(i, "title"): "later" for i in range(4)} | {(i, "key"): "d" for i in range(4)}


def test_works_and_entries_of_one_citation_are_not_paired(spark):
    n = 40_000
    works = spark.range(n).select(F.col("id").alias("work_id"), F.lit("Ada Linde").alias("composer_name"), F.lit("Op").alias("system"), F.lit(7).alias("number"), F.lit("").alias("suffix"))
    entries = spark.range(n).select((F.col("id") + 5).alias("entry_id"), F.lit("Work, Op. 7 (Ada Linde)").alias("title"), F.lit(None).cast("string").alias("credits"), F.when(F.col("id") == 8, 1).otherwise(F.when(F.col("id") > 8, 2)).alias("place"))
    got = linking.cited(works, entries)
    assert [tuple(r) for r in got.groupBy("entry_id").count().collect()] == [(13, n)]


# --- evidence resolution


def test_fields_weighed_in_rows_equal_those_of_aggregations(spark):
    rng = random.Random(11)
    words = ["prelude", "fugue", "in", "g", "Prelude", "no", "x"]
    rows = [(p, f, rng.choice([None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(9))]), rng.choice(["a", "b", "c", None]), rng.choice([0.2, 0.5, 0.7, 1.0]), rng.randrange(10**6)) for p in range(60) for f in ("title", "form") for _ in range(rng.randrange(7))]
    said = spark.createDataFrame(rows, "piece_id int, field string, value string, source string, weight double, seq long")
    plain = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    got, want = resolve.resolve_fields(said), resolve.resolve_fields(said, by_index=True)
    assert plain(got) == plain(want) and got.count() > 80


def test_spellings_are_sorted_once(spark):
    """Rows of a field are not regrouped once they are together: an aggregation over sources, values and ranks each sorted them anew."""
    said = spark.createDataFrame([(1, "form", "a", "s", 0.5, 1)], "piece_id int, field string, value string, source string, weight double, seq long")
    plan = resolve.resolve_fields(said)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Window") == 0 and plan.count("Sort [") <= 2 and plan.count("Exchange") <= 3


def test_values_are_folded_once_and_after_equal_ones_met(spark):
    """A filter on the folded key was moved to the scan, where every row was folded for it once more."""
    said = spark.createDataFrame([(1, "form", "a", "s", 0.5, 1)], "piece_id int, field string, value string, source string, weight double, seq long")
    plan = resolve.best_per_source(said)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    empty = spark.createDataFrame([(1, "form", v, "s", 0.5, 1) for v in ("", "...", " ", None)], said.schema)
    assert resolve.best_per_source(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_events_are_read_for_their_candidates_once(spark):
    from evidentia.plans import more

    plan = more.recomputed(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # what is left are the pieces, which two joins read
    assert sum("Relation" in line and "event_id#" in line for line in plan.splitlines()) <= 2
