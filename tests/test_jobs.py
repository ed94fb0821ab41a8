"""Batch search, path codes, lead-sheet order, the scan, and merging by an index, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions.folding import fold_name
from evidentia.operators import candidates, catalog, paths, resolve
from evidentia.operators.candidates import Sides
from evidentia.operators.scan import scan
from evidentia.schema import SIGNALS

# --- batch search

PIECE = "piece_id long, title string, composer_name string, catalog_display string, music_key string"


def test_batch_search_finds_what_single_searches_find(spark):
    rng = random.Random(6)
    words = ["Waltz", "valse", "Étude", "in D", "op", "No. 12", "sharp", "#", "a", "K.", "minor", "100%", "re_st"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(rng.randrange(4)) or None, rng.choice(["Ada Linde", "B. Holt", None]), rng.choice([None, "Op. 12 no. 3", "K. 8", "BWV 100"]), rng.choice(["D minor", "C major", None])) for i in range(120)]
    pieces = spark.createDataFrame([*rows, rows[3]], PIECE)
    asked = ["waltz", "Etude", "d", "op12", "op.12no3", "walzer linde", "é", "100%", "_", "#", "1", "in d minor", "ada holt", "zzz", "a b c d e f g h ignored", "k8", "t", "", "  ", "o"]
    queries = spark.createDataFrame([*enumerate(asked), (99, None)], "query_id long, query string")
    got = {(r.query_id, r.piece_id) for r in catalog.batch_search(pieces, queries).collect()}
    want = {(i, r.piece_id) for i, q in enumerate(asked) if q.strip() for r in pieces.where(catalog.search_predicate(q)).collect()}
    assert got == want and len(want) > 100
    assert catalog.batch_search(pieces.where("false"), queries).count() == 0


def test_a_frequent_gram_is_parted(spark, monkeypatch):
    monkeypatch.setattr(catalog, "LOT", 7)
    pieces = spark.range(60).select(F.col("id").alias("piece_id"), F.lit("common song").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("composer_name", "catalog_display", "music_key")])
    queries = spark.createDataFrame([(1, "common"), (2, "song")], "query_id long, query string")
    assert catalog.batch_search(pieces, queries).count() == 120


# --- path codes

CODES = [
    ("composer", "linde", "Ada Linde"), ("composer", "scarl", "Domenico Scarlatti"), ("form", "studies", "Etude"), ("form", "twoparts", "Invention"), ("form", "con_g", "Concerto"), ("form", "scenes", "Scenes"),
    ("work", "con_g", "Concerto in G"), ("work", "scenes", ""), ("instrument", "4h", "piano four hands"), ("work_stem", "prchofg", "Prelude, Choral and Fugue"),
    ("prefix", "et", "Etude"), ("prefix", "etud", "Etude"), ("prefix", "pre", "Prelude"), ("prefix", "pre&fug", "Prelude and Fugue"), ("prefix", "b2part", "Invention"), ("prefix", "hr", "Rhapsody"), ("prefix", "sn", "Sonata"), ("prefix", "sn", "Sonata"),
    ("tag", "lz_", ""), ("tag", "lz", ""), ("tag", "bt", ""),
]


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(CODES, "kind string, code string, value string")


def signals(spark, *files):
    """(collection, path[, pages, docinfo, error])"""
    rows = [(c, p, 1, 0.0, (more[0] if more else 3), "h", (more[1] if len(more) > 1 else {}), None, None, (more[2] if len(more) > 2 else None)) for c, p, *more in files]
    return spark.createDataFrame(rows, SIGNALS)


def test_codes_of_stems_and_folders(spark, codes):
    told = {
        "linde/studies/et10_1.pdf": {"form": {"Etude"}, "title": {"Etude, Op. 10 no. 1"}, "catalog": {"Op. 10 no. 1"}},
        "linde/studies/lz_hr12.pdf": {"form": {"Etude", "Rhapsody"}, "title": {"Etude, Op. 12"}},
        "linde/x/pre&fug8.pdf": {"form": {"Prelude and Fugue"}, "title": {"Prelude and Fugue, no. 8"}},
        "linde/x/prefuge.pdf": {"form": {"Prelude"}, "title": {"Prelude"}},
        "linde/twoparts/b2part10.pdf": {"form": {"Invention"}, "title": {"Invention, no. 10"}},
        "linde/x/btsn101.pdf": {"form": {"Sonata"}, "title": {"Sonata, Op. 101"}},
        "scarl/x/sn3_5.pdf": {"form": {"Sonata"}, "title": {"Sonata, no. 5"}},
        "linde/con_g/cong2.pdf": {"form": {"Concerto"}, "title": {"Concerto in G"}, "movement": {"2"}},
        "linde/con_g/congx1_a.pdf": {"form": {"Concerto"}, "title": {"Concerto in G"}},
        "linde/scenes/sc16_3.pdf": {"form": {"Scenes"}, "title": {"Scenes"}, "movement": {"3"}},
        "linde/prchofg2.pdf": {"title": {"Prelude, Choral and Fugue"}, "movement": {"2"}, "form": set()},
        "linde/Opus 68/et3.pdf": {"form": {"Etude"}, "title": {"Etude, Op. 68 no. 3"}, "catalog": {"Op. 68 no. 3"}},
        "linde/4h/evening_song.pdf": {"title": {"Evening Song"}, "instrumentation": {"piano four hands"}, "form": set()},
        "linde/bsnindex.pdf": {"title": set()}, "nobody/studies/ab.pdf": {"form": {"Etude"}, "title": {"Etude"}, "composer": set()},
    }
    got: dict = {}
    for r in paths.path_adapter(signals(spark, *[(1, p) for p in told]), Sides(codes=codes)).collect():
        got.setdefault(r.file_key[2:], {}).setdefault(r.field, set()).add(r.value)
    for path, fields in told.items():
        assert {f: got.get(path, {}).get(f, set()) for f in fields} == fields, path
        assert ("composer" in got.get(path, {})) == (path[0] != "n")
    weights = {(r.file_key[2:], r.value): r.weight for r in paths.path_adapter(signals(spark, (1, "linde/studies/et10_1.pdf"), (1, "linde/x/et10_1.pdf")), Sides(codes=codes)).where("field = 'title'").collect()}
    assert set(weights.values()) == {0.72, 0.62}  # two forms that agree, and one alone
    assert paths.path_adapter(signals(spark, (1, "linde/studies/et1.pdf")), Sides()).where("field <> 'title'").count() == 0


# --- lead sheets and the scan


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("Ada Linde",)], "canonical string").select(fold_name(F.col("canonical")).alias("alias"), "canonical")


def test_a_known_name_in_the_second_half_settles_the_order(spark, aliases):
    s = signals(spark, (1, "900 - Evening Air - Ada Linde.pdf"), (1, "901 - Ada Linde - Evening Air.pdf"), (1, "902 - Somebody - Evening Air.pdf"), (1, "903 - all my life.pdf"))
    got = {(r.file_key[2:5], r.field): (r.value, r.note) for r in candidates.sheet_adapter(s, Sides(aliases=aliases)).collect()}
    assert got["900", "composer"] == ("Ada Linde", None) and got["900", "title"] == ("Evening Air", None)
    assert got["901", "composer"][0] == "Ada Linde" and "guess" in got["901", "composer"][1]
    assert got["902", "composer"][0] == "Somebody" and got["903", "title"][0] == "All My Life" and ("903", "composer") not in got


def test_scan_routes_every_shape_and_tells_problems(spark, codes, aliases):
    s = signals(
        spark, (1, "a.pdf", 4, {"Subject": "Linde: Gavotte, Op. 3, P1 of 4"}), (1, "b.pdf", 4, {}, "no trailer"), (1, "drafts/c.pdf", 4, {"Subject": "Linde: Air, Op. 4"}),
        (2, "12 - Evening Air - Ada Linde.pdf"), (3, "linde/studies/et10_1.pdf"), (3, "linde/index.pdf"), (4, "x.pdf"), (3, "linde/studies/et10_1.pdf"),
    )
    collections = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, {"form": "Song"}), (3, None, 0.7, 0.5, {"form": "Other", "instrumentation": "solo piano"}), (4, "nowhere", None, None, None)], "collection_id long, adapter string, auto_accept double, review_floor double, defaults map<string,string>")
    found = scan(s, collections, Sides(codes=codes, aliases=aliases), {"drafts/*": "a draft"})
    got = {r.piece_id: (r.route, r.confidence, r.composer_name, r.title, r.form, r.instrumentation, r.adapter) for r in found.pieces.collect()}
    assert got == {
        "1/a.pdf#1": ("accept", 0.85, "Linde", "Gavotte", None, None, "subject"), "2/12 - Evening Air - Ada Linde.pdf#1": ("review", 0.55, "Ada Linde", "Evening Air", "Song", None, "sheets"),
        "3/linde/studies/et10_1.pdf#1": ("accept", 0.7, "Ada Linde", "Etude, Op. 10 no. 1", "Etude", "solo piano", "paths"), "3/linde/index.pdf#1": ("hold", 0.0, "Ada Linde", None, "Other", "solo piano", "paths"),
    }
    assert sorted((r.file_key, r.reason) for r in found.problems.collect()) == [("1/b.pdf", "unreadable: no trailer"), ("1/drafts/c.pdf", "a draft"), ("4/x.pdf", "no adapter nowhere")]
    empty = scan(s.where("false"), collections, Sides(codes=codes))
    assert empty.pieces.count() == 0 and empty.problems.count() == 0


# --- merging spellings


def roots(df, by_index):
    return sorted(tuple(r) for r in resolve.merge_spellings(df, by_index).select("piece_id", "field", "key", "source", "root").collect())


def test_the_index_merges_as_rows_do(spark):
    rng = random.Random(2)
    words = ["a", "of", "suite", "air", "in", "g", "minor", "minor", "piano"]
    rows = [(p, f, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), f"s{rng.randrange(3)}", 0.5) for p in range(12) for f in ("title", "key") for _ in range(rng.randrange(1, 25))]
    rows = [(*r, r[2], i) for i, r in enumerate({r[:4]: r for r in rows}.values())]
    best = spark.createDataFrame(rows, "piece_id long, field string, key string, source string, weight double, value string, seq long")
    assert roots(best, True) == roots(best, False)


def test_a_hundred_spellings_and_thousands_of_values(spark):
    chain = [(1, "title", " ".join(f"word{j}" for j in range(i + 1)), f"s{i}", 0.01, i) for i in range(100)]
    many = [(2, "title", f"value{i} of{i % 7}", "s", 0.5, i) for i in range(4000)] + [(2, "title", "value17 of3 whole", "t", 0.4, 9000)]
    df = spark.createDataFrame(chain + many, "piece_id long, field string, value string, source string, weight double, seq long")
    got = {r.piece_id: r for r in resolve.resolve_fields(df, by_index=True).collect()}
    assert got[1].value == chain[-1][2] and len(got[1].sources) == 100 and not got[1].conflict
    assert got[2].value == "value17 of3 whole" and got[2].sources == ["s", "t"] and got[2].conflict
    assert resolve.resolve_fields(df.where("piece_id = 1")).first().value == chain[-1][2]


def test_stems_are_read_without_joining_the_codes_of_folders_again(spark):
    signals = spark.createDataFrame([], SIGNALS)
    codes = spark.createDataFrame([], "kind string, code string, value string")
    # four kinds of folders, the forms of stems by prefix behind a tag and from the start, works by stem, and the two joins that add them
    assert paths.readings(signals, codes)._jdf.queryExecution().analyzed().toString().count("Join ") == 9
