"""Curation events reduced to what still counts, whatever the order and the batches they came in.

A ledger has the columns of an event (seq, kind, piece_id, field, value, source, weight, note).  Reducing it is a fold over sets: events that come
late, twice, or in another order give the same ledger, and so the same candidates.

propose   stands unless it is retracted later (by seq); of the proposals of a value only those that no later one outweighs are kept, for a late
          retraction may take the later ones' elders but never them
retract   of (piece, field, source, value), a null value meaning all values: the last one counts
decide    on (piece, field): the last one counts, of equal seq the least value; no retraction takes it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["piece_id", "field", "source", "value"]
COLUMNS = ["seq", "kind", *KEY, "weight", "note"]


def standing(proposals: DataFrame, retractions: DataFrame) -> DataFrame:
    """Proposals that no retraction of theirs came after."""
    ends = retractions.groupBy(*KEY).agg(F.max("seq").alias("ended"))
    one = ends.where("value IS NOT NULL")
    every = ends.where("value IS NULL").select(*KEY[:3], F.col("ended").alias("all_ended"))
    both = proposals.join(one, KEY, "left").join(every, KEY[:3], "left")
    return both.where("seq > coalesce(greatest(ended, all_ended), seq - 1)").drop("ended", "all_ended")


def reduced(events: DataFrame) -> DataFrame:
    """The ledger of events, or of a ledger and further events; rows of other kinds and without a piece are dropped."""
    known = events.where("piece_id IS NOT NULL").select(*COLUMNS)
    # equal proposals meet before any shuffle, so one that is made very often is one row
    proposals = known.where("kind = 'propose'").groupBy("kind", *KEY, "weight").agg(F.max("seq").alias("seq"), F.max_by("note", "seq").alias("note"))
    retractions = known.where("kind = 'retract'").groupBy("kind", *KEY).agg(F.max("seq").alias("seq"))
    later = Window.partitionBy(*KEY).orderBy(F.col("seq").desc(), F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = standing(proposals, retractions).withColumn("later", F.max("weight").over(later)).where("later IS NULL OR weight > later").drop("later")
    last = F.min_by(F.struct("source", "value", "weight", "note", "seq"), F.struct(-F.col("seq"), F.col("value"), F.col("source"))).alias("d")
    decisions = known.where("kind = 'decide'").groupBy("kind", "piece_id", "field").agg(last).select("kind", "piece_id", "field", "d.*")
    none = {"weight": F.lit(None).cast("double"), "note": F.lit(None).cast("string")}
    return kept.select(*COLUMNS).unionByName(retractions.withColumns(none).select(*COLUMNS)).unionByName(decisions.select(*COLUMNS))


def candidates(ledger: DataFrame) -> DataFrame:
    """The candidate table of a reduced ledger: one row a (piece, field, source, value), decided ones accepted with weight 1."""
    open_ = ledger.where("kind = 'propose'").groupBy(*KEY).agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"), F.max_by("note", "seq").alias("note"))
    decided = ledger.where("kind = 'decide'").select(*KEY, F.lit(1.0).alias("weight"), "seq", "note", F.lit(True).alias("accepted"))
    rest = open_.join(decided.select(*KEY), KEY, "left_anti").withColumn("accepted", F.lit(False))
    return rest.unionByName(decided)
