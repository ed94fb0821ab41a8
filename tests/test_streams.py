"""Bucketed tables, the ledger, the feeds and the drop folder: late, repeated and out-of-order batches give the tables of one batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import ledger
from evidentia.operators.candidates import Sides
from evidentia.schema import EVENT
from evidentia.sources.buckets import Buckets
from evidentia.streaming import feeds


def names(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_an_update_leaves_other_buckets_alone(spark, tmp_path):
    table = Buckets(spark, f"file:{tmp_path}/t", "piece_id long, title string", n=8).create(spark.range(100).select(F.col("id").alias("piece_id"), F.lit("a").alias("title")))
    assert table.read().count() == 100
    before = names(tmp_path / "t")
    change = spark.createDataFrame([(3, "b"), (200, "new")], "piece_id long, title string")
    touched = table.update(change, lambda old: old.join(change, "piece_id", "left_anti").unionByName(change))
    after = names(tmp_path / "t")
    inside = lambda f: int(f.split("bucket=")[1].split("/")[0]) in touched
    assert {f for f in before if not inside(f)} == {f for f in after if not inside(f)} and not any(inside(f) for f in before & after)
    got = {r.piece_id: r.title for r in table.read().collect()}
    assert len(got) == 101 and got[3] == "b" and got[200] == "new" and got[4] == "a"
    # a bucket that loses all rows is empty afterwards
    mine = table.read([touched[0]])
    table.update(mine, lambda old: old.where("false"))
    assert table.read([touched[0]]).count() == 0 and table.update(change.where("false"), lambda old: old) == []


def made(rng, n, ids=range(6)):
    kinds = ["propose"] * 6 + ["retract", "decide"]
    return [(seq, rng.choice(kinds), rng.choice(ids), rng.choice(["title", "composer"]), rng.choice(["x", "y", "z"]), rng.choice("ab"), rng.choice([0.3, 0.5, 0.9]), None) for seq in range(n)]


def plain(events):
    """The candidate table, event by event in the order of seq."""
    live, decided = {}, {}
    for seq, kind, piece, field, value, source, weight, _ in sorted(set(events)):
        key = (piece, field, source, value)
        if kind == "propose":
            live.setdefault(key, []).append((seq, weight))
        elif kind == "decide":
            decided[piece, field] = (seq, source, value)
        else:
            for k in [k for k in live if k[:3] == key[:3] and value in (None, k[3])]:
                del live[k]
    out = {k: (max(w for _, w in v), False) for k, v in live.items()}
    return out | {(p, f, s, v): (1.0, True) for (p, f), (_, s, v) in decided.items()}


def table_of(df):
    return {(r.piece_id, r.field, r.source, r.value): (r.weight, r.accepted) for r in ledger.candidates(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_one_ledger(spark, seed):
    rng = random.Random(seed)
    events = made(rng, 160)
    events[20:24] = [(seq, "retract", p, f, None, s, None, None) for seq, _, p, f, _, s, *_ in events[20:24]]
    df = lambda rows: spark.createDataFrame(rows, EVENT)
    shuffled = rng.sample(events, len(events))
    two = ledger.reduced(ledger.reduced(df(shuffled[:90])).unionByName(df(shuffled[60:] + shuffled[:5])))
    one = ledger.reduced(df(events))
    assert table_of(one) == table_of(two) == plain(events)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_curation_feed_touches_its_pieces_only(spark, tmp_path):
    base = spark.createDataFrame([(i, "pending", None, None, None) for i in range(40)], "piece_id long, review_state string, ingest_notes array<string>, auto_accept double, review_floor double")
    store = feeds.Store(spark, f"file:{tmp_path}/store", buckets=8).create(base)
    ev = lambda *rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"file:{tmp_path}/events")
    run = lambda: feeds.curation_feed(spark, f"file:{tmp_path}/events", store, f"file:{tmp_path}/ck").awaitTermination(120)
    ev((5, "propose", 1, "title", "Air", "a", 0.9, None), (6, "propose", 1, "composer", "Linde", "a", 0.9, None), (7, "decide", 2, "title", "Song", "u", 1.0, None))
    assert run()
    state = lambda: {r.piece_id: (r.title, r.composer_name, r.route) for r in store.pieces.read().where("title IS NOT NULL OR composer_name IS NOT NULL").collect()}
    assert state() == {1: ("Air", "Linde", "accept"), 2: ("Song", None, "hold")} and store.pieces.read().count() == 40
    before = names(tmp_path / "store")
    ev((3, "decide", 2, "title", "Too late", "u", 1.0, None), (8, "retract", 1, "composer", None, "a", None, None), (6, "propose", 1, "composer", "Linde", "a", 0.9, None))
    assert run() and run()
    assert state() == {1: ("Air", None, "hold"), 2: ("Song", None, "hold")}
    assert len(before & names(tmp_path / "store")) >= len(before) // 2
    # the same batch again changes nothing
    rows = sorted(map(repr, store.ledger.read().collect()))
    store.apply(spark.read.parquet(f"file:{tmp_path}/events"))
    assert sorted(map(repr, store.ledger.read().collect())) == rows and state() == {1: ("Air", None, "hold"), 2: ("Song", None, "hold")}


def test_dropped_signals_end_as_routed_pieces_and_marked_files(spark, tmp_path):
    collections = spark.createDataFrame([(1, "subject", None, None, None)], "collection_id long, adapter string, auto_accept double, review_floor double, defaults map<string,string>")
    store = feeds.Store(spark, f"file:{tmp_path}/store", "string", 4).create()
    (tmp_path / "drop").mkdir()

    def drop(name, *rows):
        (tmp_path / f".{name}").write_text("\n".join(json.dumps({"collection_id": 1, "page_count": 4, "sha256": "h", **r}) for r in rows))
        os.rename(tmp_path / f".{name}", tmp_path / "drop" / name)
        assert feeds.ingest(spark, f"file:{tmp_path}/drop", store, f"file:{tmp_path}/ck", collections, Sides()).awaitTermination(180)

    drop("one.json", {"rel_path": "a.pdf", "docinfo": {"Subject": "Linde: Gavotte, Op. 3, P1 of 4"}}, {"rel_path": "b.pdf", "error": "no trailer"})
    pieces = lambda: {r.piece_id: (r.composer_name, r.title, r.route) for r in store.pieces.read().collect()}
    assert pieces() == {"1/a.pdf#1": ("Linde", "Gavotte", "accept")}
    assert {r.file_key: r.status for r in store.files.read().collect()} == {"1/a.pdf": "done", "1/b.pdf": "unreadable: no trailer"}
    # the file has changed: what it no longer says goes, a decision stays
    store.apply(spark.createDataFrame([(1, "decide", "1/a.pdf#1", "composer", "Ada Linde", "u", 1.0, None)], store.ledger.schema))
    drop("two.json", {"rel_path": "a.pdf", "docinfo": {"Subject": "Linde: Air, Op. 4, P1 of 4"}})
    assert pieces() == {"1/a.pdf#1": ("Ada Linde", "Air", "accept")}
    again = spark.read.schema("collection_id long, rel_path string").json(f"file:{tmp_path}/drop/two.json")
    assert again.count() == 1 and store.files.read().where("batch = 1").count() == 1


def test_depth_follows_each_batch(spark, tmp_path):
    schema = "piece_id long, route string, review_state string, seq long"
    path, last = f"{tmp_path}/states", {}
    batches = [
        [(1, "hold", "pending", 1), (2, "review", "pending", 2), (3, "hold", "pending", 3)],
        [(1, "accept", "pending", 5), (1, "review", "pending", 4), (2, "review", "pending", 6), (4, "hold", "pending", 7)],
        [(3, "hold", "accepted", 8), (1, "hold", "pending", 2), (4, None, None, 9), (4, "hold", "pending", 7)],
    ]
    for n, rows in enumerate(batches, 1):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file:{path}")
        assert feeds.depth_feed(spark.readStream.schema(schema).parquet(f"file:{path}"), f"file:{tmp_path}/depth", f"file:{tmp_path}/ck").awaitTermination(120)
        for piece, route, state, seq in rows:
            if seq > last.get(piece, (None, None, -1))[2]:
                last[piece] = (route, state, seq)
        want: dict = {}
        for route, state, _ in last.values():
            if route is not None:
                want[route, state] = want.get((route, state), 0) + 1
        assert {(r.route, r.review_state): r.depth for r in spark.read.parquet(f"file:{tmp_path}/depth/v{n}").collect()} == want
