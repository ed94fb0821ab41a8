"""Streams: drop folders, a curation feed, and the depth of the review queue.

Each micro-batch rewrites only the buckets of the pieces it touches, and is a fold that gives the same tables when it is repeated: after a
failure Spark hands over the same batch again under the same number, and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators import corrections as K
from evidentia.operators import ledger as L
from evidentia.operators.candidates import Sides
from evidentia.operators.resolve import recompute
from evidentia.operators.scan import scan
from evidentia.schema import EVENT, PIECE, SIGNALS, TAKEN
from evidentia.sources.buckets import BUCKETS, Buckets


def drop_folder(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*.[pP][dD][fF]") -> StreamingQuery:
    """Hands every new file below `root` to `handle` once, in micro-batches of (rel_path, size, mtime, sha256).

    A batch is repeated after a failure, so `handle` must be idempotent for a batch id.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_events(stored: DataFrame, events: DataFrame) -> DataFrame:
    """The candidate table after a batch of events: proposals, then decisions, then retractions.

    A retraction never takes an accepted value.  An event older than what the table knows of its key changes nothing.
    """
    new = events.where("kind = 'propose'").select("piece_id", "field", "value", "source", "weight", "note", "seq", F.lit("curator").alias("adapter"), F.lit(False).alias("accepted"))
    table = K.upsert_candidates(stored, new)
    newest = stored.where("accepted").select("piece_id", "field", F.col("seq").alias("decided_at"))
    decided = events.where("kind = 'decide'").join(newest, ["piece_id", "field"], "left").where("decided_at IS NULL OR seq > decided_at")
    table = K.apply_decisions(table, decided.select("piece_id", "field", "value", "source", "seq"))
    return K.retract(table, events.where("kind = 'retract'").select("piece_id", "field", "source", "value"))[0]


@dataclass
class Store:
    """The bucketed tables that streams keep below `root`: the ledger of events, the pieces, and the files taken in.  id_type: long or string."""

    spark: SparkSession
    root: str
    id_type: str = "long"
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.ledger = Buckets(self.spark, f"{self.root}/ledger", EVENT.replace("piece_id long", f"piece_id {self.id_type}"), n=self.buckets)
        self.pieces = Buckets(self.spark, f"{self.root}/pieces", PIECE.format(id=self.id_type), n=self.buckets)
        self.files = Buckets(self.spark, f"{self.root}/files", TAKEN, key="file_key", n=self.buckets)

    def create(self, pieces: DataFrame | None = None) -> Store:
        """Writes empty tables; `pieces` (piece_id, review_state, ingest_notes, auto_accept, review_floor) are there from the start, all underived."""
        for table in (self.ledger, self.files):
            table.create()
        self.pieces.create(None if pieces is None else pieces.unionByName(self.spark.createDataFrame([], self.pieces.schema), allowMissingColumns=True))
        return self

    def apply(self, events: DataFrame) -> None:
        """Takes in events and derives their pieces anew, and no others; events of unknown pieces wait in the ledger.

        Events may come late, repeated and in any order: the tables are those of all events in one batch.
        """
        self.ledger.update(events, lambda old: L.reduced(old.unionByName(events.select(*old.columns))))
        self.derive(events.select("piece_id"))

    def derive(self, touched: DataFrame) -> None:
        """Derives the pieces of `touched` (piece_id) anew from the ledger."""
        ids = touched.where("piece_id IS NOT NULL").distinct()
        given = ["piece_id", "review_state", "ingest_notes", "auto_accept", "review_floor"]

        def fold(old: DataFrame) -> DataFrame:
            mine = old.join(ids, "piece_id", "left_semi").select(*given)
            said = L.candidates(self.ledger.read(self.ledger.touched(ids)).join(ids, "piece_id", "left_semi"))
            new = recompute(said, mine).drop("review_state").join(mine, "piece_id")
            return old.join(ids, "piece_id", "left_anti").unionByName(new.select(*old.columns))

        self.pieces.update(ids, fold)


def curation_feed(spark: SparkSession, events_path: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Applies event files to a store, batch by batch."""
    feed = spark.readStream.schema(store.ledger.schema).parquet(events_path)

    def handle(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        store.apply(batch)
        batch.unpersist()

    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Sequence numbers of one batch of files: its number times this, and the place of a reading.
PLACES = 1 << 20


def take_in(store: Store, signals: DataFrame, batch: int, collections: DataFrame, sides: Sides | None = None, ignore: dict[str, str] | None = None) -> None:
    """Signals of new or changed files to routed pieces of a store with string ids; every file ends in its table, done or with a reason.

    What an earlier run said of a piece and this one no longer does is retracted; decisions stay.  A batch that is repeated changes nothing.
    """
    found = scan(signals, collections, sides, ignore)
    said = found.candidates.select(F.lit(batch).cast("long").alias("batch"), "*")
    said = said.select((F.col("batch") * PLACES + 1 + F.col("seq")).alias("seq"), F.lit("propose").alias("kind"), "piece_id", "field", "value", "source", "weight", "note")
    limits = found.pieces.select("piece_id", "file_key", "collection_id").join(collections.select("collection_id", "auto_accept", "review_floor"), "collection_id", "left")
    ids = limits.select("piece_id")
    before = L.candidates(store.ledger.read(store.ledger.touched(ids)).join(ids, "piece_id", "left_semi")).where("NOT accepted AND source <> 'curator'")
    gone = before.join(said.select(*L.KEY), L.KEY, "left_anti").where(F.col("seq") < batch * PLACES)
    nothing = F.lit(None)
    gone = gone.select(F.lit(batch * PLACES).cast("long").alias("seq"), F.lit("retract").alias("kind"), "piece_id", "field", "value", "source", nothing.cast("double").alias("weight"), nothing.cast("string").alias("note"))
    events = said.unionByName(gone).persist()

    def with_new(old: DataFrame) -> DataFrame:
        fresh = limits.join(old, "piece_id", "left_anti").select("piece_id", F.lit("pending").alias("review_state"), F.array().cast("array<string>").alias("ingest_notes"), "auto_accept", "review_floor")
        return old.unionByName(fresh, allowMissingColumns=True)

    store.ledger.update(events, lambda old: L.reduced(old.unionByName(events.select(*old.columns))))
    store.pieces.update(ids, with_new)
    store.derive(ids)
    events.unpersist()
    key = F.concat_ws("/", F.col("collection_id").cast("string"), "rel_path")
    why = found.problems.groupBy("file_key").agg(F.min("reason").alias("reason"))
    marks = signals.groupBy(key.alias("file_key")).agg(F.max("sha256").alias("sha256")).join(why, "file_key", "left")
    marks = marks.select("file_key", "sha256", F.lit(batch).cast("long").alias("batch"), F.coalesce("reason", F.lit("done")).alias("status"))
    store.files.update(marks, lambda old: old.join(marks, "file_key", "left_anti").unionByName(marks))


def ingest(spark: SparkSession, signals_path: str, store: Store, checkpoint: str, collections: DataFrame, sides: Sides | None = None, ignore: dict[str, str] | None = None) -> StreamingQuery:
    """Takes in files of signals (JSON lines) that are dropped into a folder, each once; see `take_in`."""
    texts = spark.readStream.schema(SIGNALS.replace("map<int,string>", "map<string,string>")).json(signals_path)
    rows = texts.withColumn("page_text", F.transform_keys("page_text", lambda k, _: k.cast("int")))

    def handle(batch: DataFrame, n: int) -> None:
        take_in(store, batch, n, collections, sides, ignore)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth_changes(states: DataFrame) -> DataFrame:
    """route, review_state, delta of a stream of pieces' states (piece_id, route, review_state, seq).

    The last state of each piece is kept by Spark; where a later one (by seq) differs, the old place of the queue loses one and the new one gains one.  A
    state that comes late or again changes nothing.  A null route means that the piece is gone.
    """

    def moved(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None, None)
        route, review, seq = known
        for rows in batches:
            row = rows.sort_values("seq").iloc[-1]
            if seq is None or row["seq"] > seq:
                route, review, seq = row["route"], row["review_state"], int(row["seq"])
        state.update((route, review, seq))
        out = [] if known[:2] == (route, review) else [(r, s, d) for r, s, d in ((*known[:2], -1), (route, review, 1)) if r is not None]
        yield pd.DataFrame(out, columns=["route", "review_state", "delta"])

    return states.select("piece_id", "route", "review_state", "seq").groupBy("piece_id").applyInPandasWithState(moved, "route string, review_state string, delta long", "route string, review_state string, seq long", "update", GroupStateTimeout.NoTimeout)


def depth_feed(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the depth of the queue by route and review state: batch n adds its changes to version n of a table of a few rows and writes version n + 1."""
    spark = states.sparkSession

    def handle(changes: DataFrame, n: int) -> None:
        added = queue_depth(changes)
        if n:
            added = queue_depth(spark.read.parquet(f"{path}/v{n}").withColumnRenamed("depth", "delta").unionByName(added.withColumnRenamed("depth", "delta")))
        added.where("depth <> 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{n + 1}")

    return depth_changes(states).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_depth(changes: DataFrame) -> DataFrame:
    """Running counts by route and state of a stream of (piece_id, route, review_state, delta)."""
    return changes.groupBy("route", "review_state").agg(F.sum("delta").alias("depth"))
