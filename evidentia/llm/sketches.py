"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A text's sketch is the sorted set of its word-shingle hashes that lie below 1/`FRACTION` of the hash
range.  Membership depends on the hash alone, so the shared part of two sketches estimates resemblance and
containment of texts of very unequal length without bias.  A text of at most `SMALL` distinct shingles keeps all of
them, so that short texts are compared exactly; `whole` says so, and a comparison with a scaled sketch, or a union that
grows beyond `SMALL`, drops to the hashes below the threshold.  So the union of two sketches is the sketch of the union.

Words are lower-cased (A-Z) runs of characters other than the six ASCII spaces; fewer words than `SHINGLE` make one
shingle; only texts without words have an empty whole sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored, table

SHINGLE, FRACTION, SMALL = 5, 4, 64
#: Hashes are signed 64-bit; those below this are retained.
BOUND = -(1 << 63) + (1 << 64) // FRACTION
#: Rows with a null id come last in descending order, under this id.
NULL_ID = -(1 << 63)


def sketch(text: Column, size: int = SHINGLE) -> Column:
    """struct<whole, hashes>: the retained shingle hashes, sorted.  Null and wordless texts give an empty array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # a shingle's hash is that of its words' hashes; shorter texts hash what they have
    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))

    return retained(bound(hashed, shingles))


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once: as the variable of a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _made(whole: bool, hashes: Column) -> Column:
    return F.struct(F.lit(whole).alias("whole"), hashes.alias("hashes"))


def below(hashes: Column) -> Column:
    return F.filter(hashes, lambda h: h < F.lit(BOUND))


def retained(hashes: Column) -> Column:
    """The sketch of a text's hashes."""

    def some(all_: Column) -> Column:
        return bound(F.array_distinct(below(all_)), lambda low: F.when(F.size(low) > SMALL, _made(False, F.array_sort(low))).otherwise(bound(F.array_distinct(all_), lambda d: few(d, low))))

    def few(distinct: Column, low: Column) -> Column:
        return F.when(F.size(distinct) <= SMALL, _made(True, F.array_sort(distinct))).otherwise(_made(False, F.array_sort(low)))

    return bound(hashes, some)


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""

    def kept(union: Column) -> Column:
        return F.when(a["whole"] & b["whole"] & (F.size(union) <= SMALL), _made(True, union)).otherwise(_made(False, below(union)))

    return bound(F.array_sort(F.array_union(a["hashes"], b["hashes"])), kept)


def scaled(a: Column, b: Column) -> Column:
    """a's hashes as far as b's sketch can have them too."""
    return F.when(b["whole"], a["hashes"]).otherwise(below(a["hashes"]))


def resemblance(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes.  Where neither sketch has one: 1 for two equal sketches, else 0."""

    def ratio(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - shared
        return F.when(union == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(shared / union)

    return bound(scaled(a, b), lambda x: bound(scaled(b, a), lambda y: ratio(x, y)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has too; where a has none to compare, 1 if it is an empty text's, else 0."""

    def ratio(x: Column) -> Column:
        return F.when(F.size(x) == 0, F.when(F.size(a["hashes"]) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x, b["hashes"])) / F.size(x))

    return bound(scaled(a, b), ratio)


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) for each distinct id: the next one in descending order, after the last the first.

    Ids are dealt to ranges; inside a range a window finds the successor, and the ends of the ranges, one row
    for each, are joined to their neighbours.
    """
    parts = ids.distinct().repartitionByRange(F.col("id").desc()).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "ids")
    ends = parts.groupBy("part").agg(F.max("id").alias("top"), F.min("id").alias("end"))
    # over one row for each range
    after = ends.select("part", F.expr("lead(top) OVER (ORDER BY part)").alias("over"), F.expr("max(top) OVER ()").alias("first"))
    inside = "lead(id) OVER (PARTITION BY part ORDER BY id DESC)"
    found = parts.withColumn("inside", F.expr(inside)).join(F.broadcast(after), "part")
    return found.select("id", F.coalesce("inside", "over", "first").alias("next_id"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: its sketch, that of its edited text, and how alike they and the next one's are.

    The next document is that with the next smaller doc_id, after the last the first; a null id is the
    smallest.  Rows that share an id share their next document; of several rows with the next id that with
    the least text counts.  A single document is its own next one.  Null texts are empty; repeated rows come out
    repeated, an empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = next_ids(rows.select("id"))
    # one shuffle of the texts by id serves both joins: both read the same three columns
    dealt = rows.repartition("id")
    asked = rows.select("id", F.char_length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    asked = asked.join(order, "id").select(F.col("id").alias("asker"), F.col("next_id").alias("id"), F.expr("n div 3").alias("most"))
    first_text = F.expr("row_number() OVER (PARTITION BY id ORDER BY text, doc_id) AS nth")
    one = dealt.select("doc_id", "id", "text", first_text).where("nth = 1")
    heads = one.join(asked, "id").select(F.col("asker").alias("id"), F.expr("substring(text, 1, most)").alias("head"), sketch(F.col("text")).alias("next_sketch"))
    both = dealt.join(heads, "id").select("doc_id", "text", "head", "next_sketch", F.char_length("text").cast("long").alias("n_chars"))
    cut = F.expr("CAST(n_chars div 3 AS INT)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("head", F.lit(1), cut))
    made = both.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"), "next_sketch")
    return made


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fingerprints` of the whole table of documents, sketches as hexadecimal text; see there for nulls, ties and repeats."""
    made = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("contained_edited"),
    )
