"""Inventories, signals tables, dumps, catalogue sinks and the drop folder, on small folders made here."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from evidentia.operators.linking import match_entities
from evidentia.sources import files
from evidentia.streaming import feeds


def folder(root, **contents):
    for name, data in contents.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return f"file:{root}"


def test_inventory_takes_the_suffix_in_any_case_and_every_depth_and_no_empty_file(spark, tmp_path):
    root = folder(tmp_path / "lib", one_dot_pdf=b"alpha", deep__er__two_dot_PDF=b"beta!", empty_dot_pdf=b"", note_dot_txt=b"no")
    got = {r["rel_path"]: (r["size"], r["sha256"]) for r in files.inventory(spark, root).collect()}
    assert got == {"one.pdf": (5, hashlib.sha256(b"alpha").hexdigest()), "deep/er/two.PDF": (5, hashlib.sha256(b"beta!").hexdigest())}


def test_signals_keep_errors_and_tell_text_layers(spark, tmp_path):
    rows = [
        {"rel_path": "a.pdf", "page_count": 2, "page_text": {"0": " " * 50, "1": "x" * 41}},
        {"rel_path": "b.pdf", "page_count": 1, "page_text": {"0": "x" * 40}},
        {"rel_path": "c.pdf", "error": "no trailer"},
    ]
    (tmp_path / "signals.json").write_text("\n".join(map(json.dumps, rows)))
    read = files.read_signals(spark, f"file:{tmp_path}/signals.json")
    got = {r["rel_path"]: (r["layer"], r["error"]) for r in read.select("rel_path", files.has_text_layer(F.col("page_text")).alias("layer"), "error").collect()}
    assert got == {"a.pdf": (True, None), "b.pdf": (False, None), "c.pdf": (False, "no trailer")}


def test_authority_dump_reads_claims_and_relations(spark, tmp_path):
    row = {"entry_id": "e1", "title": "Suite", "place": 3, "claims": {"kind": ["human"]}, "relations": [{"kind": "parts", "direction": "backward", "other_id": "e0"}]}
    (tmp_path / "dump.json").write_text(json.dumps(row))
    got = files.authority_dump(spark, f"file:{tmp_path}/dump.json").first()
    assert (got["entry_id"], got["credits"], got["claims"], got["relations"][0]["other_id"]) == ("e1", None, {"kind": ["human"]}, "e0")


def test_writing_a_collection_leaves_the_others(spark, tmp_path):
    path = f"file:{tmp_path}/catalogue"
    schema = "piece_id long, title string, collection_id long"
    files.write_catalogue(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], schema), path)
    files.write_catalogue(spark.createDataFrame([(4, "d", 2)], schema), path)
    got = sorted((r["piece_id"], r["collection_id"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1), (2, 1), (4, 2)]


def test_drop_folder_hands_over_each_file_once(spark, tmp_path):
    root = folder(tmp_path / "drop", one_dot_pdf=b"1", skipped_dot_txt=b"2")
    seen = []

    def handle(batch, _):
        seen.extend(r["rel_path"] for r in batch.collect())

    def run():
        assert feeds.drop_folder(spark, root, f"file:{tmp_path}/ck", handle).awaitTermination(60)

    run()
    folder(tmp_path / "drop", two_dot_Pdf=b"3")
    run()
    run()
    assert sorted(map(os.path.basename, seen)) == ["one.pdf", "two.Pdf"]


def test_entities_match_on_similar_labels_of_an_allowed_kind(spark):
    names = spark.createDataFrame([("Johanna Lindqvist",), ("Nobody Known",)], "name string")
    entities = spark.createDataFrame(
        [("q1", "Johanna Lindqvist", ["painter"], 0), ("q2", "Lindqvist", ["composer"], 1), ("q3", "Johanna M. Lindqvist", ["composer"], 2), ("q4", "Christopher-Bartholomew Lindqvist", ["composer"], 0)],
        "entity_id string, label string, kinds array<string>, place int",
    )
    got = [(r["name"], r["entity_id"]) for r in match_entities(names, entities, ["composer"]).collect()]
    assert got == [("Johanna Lindqvist", "q2")]
