"""Evidence resolution: candidates to one value and confidence a field, then one confidence and route a piece.

Candidates are rows (piece_id, field, value, source, weight, seq).  Steps:

best     per (piece, field, folded value, source) the best weight; the longest spelling is shown;
merged   spellings with the same words are one value, and a value that a fuller one contains joins it;
scored   the sources of a value reinforce each other by noisy-OR; a close rival is a conflict;
combined a piece is as sure as its weakest required field.

The first step aggregates before any shuffle, so that repeats of one hot piece meet early.  After it all rows of
a piece are brought together once, and every later aggregation and window has piece_id among its keys
and reuses that partitioning.  Spellings that are merged inside one row are scored and ranked there too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.folding import FOLDS, Folds, fold_by_field
from evidentia.functions.music import let
from evidentia.schema import KNOWN_FIELDS, REQUIRED_FIELDS

# Thresholds of the scorer.
AUTO_ACCEPT, REVIEW_FLOOR = 0.80, 0.50
CONFLICT_RATIO, CONFLICT_CAP = 0.55, 0.45
CERTAIN = 0.99
DAMAGED = "�"


def valid(candidates: DataFrame, fields: Sequence[str] = KNOWN_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason): unknown fields and weights outside (0, 1]."""
    reason = F.when(F.col("field").isNull() | ~F.col("field").isin(*fields), "unknown field").when(F.col("weight").isNull() | ~((F.col("weight") > 0) & (F.col("weight") <= 1)), "weight outside (0, 1]")
    judged = candidates.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def noisy_or(weight: Column) -> Column:
    """Aggregate: 1 - product(1 - w), 0.99 at most."""
    return F.least(F.lit(1.0) - F.product(F.lit(1.0) - weight), F.lit(CERTAIN))


def rounded(sure: Column) -> Column:
    """Four decimals, halves up: the little that is added makes the order of a product's factors irrelevant."""
    return F.round(sure + 1e-9, 4)


def best_per_source(candidates: DataFrame, folds: Folds = FOLDS) -> DataFrame:
    """piece_id, field, key, source, weight, value (longest spelling, first of equals) and seq (first seen)."""
    # equal values of a source meet first: numbers alone are aggregated, so Spark hashes instead of sorting, and each value is folded once
    met = candidates.where("value IS NOT NULL").groupBy("piece_id", "field", "value", "source").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))
    keyed = met.repartition("piece_id").withColumn("key", fold_by_field(F.col("field"), F.col("value"), folds))
    spelling = F.max_by("value", F.struct(F.length("value"), -F.col("seq")))
    best = keyed.groupBy("piece_id", "field", "key", "source").agg(F.max("weight").alias("weight"), spelling.alias("value"), F.min("seq").alias("seq"), F.max(F.length("key")).alias("letters"))
    # a filter on the key itself would be moved below the shuffle and fold every value once more there
    return best.where("letters > 0").drop("letters")


def _contains(long_: Column, short: Column) -> Column:
    """Whether the words of `short` open `long_`, or, being four characters or more, are all among its words."""
    opens = F.slice(long_["words"], 1, F.size(short["words"])) == short["words"]
    among = (F.length(short["key"]) >= 4) & (F.size(F.array_except(short["words"], long_["words"])) == 0)
    return (F.size(short["words"]) < F.size(long_["words"])) & (opens | among)


def merge_spellings(best: DataFrame, by_index: bool = False) -> DataFrame:
    """`best` with `root`, the key of the value that each row belongs to.

    Rows whose keys have the same words in any order take the key seen last.  A key then goes to the longest
    key with more words that contains it (of equal lengths the one seen first), and on to where that goes.

    The keys of a field of a piece are compared inside one row.  With `by_index` they meet through an inverted index instead: a key lies only
    in keys that have its rarest word, so it is compared with those alone, and no row ever holds them all.  Both give the same roots; the
    index is for pieces with thousands of values and costs two more joins.
    """
    if by_index:
        return _merged_by_index(best)
    return _merged_lists(best).select("piece_id", "field", F.inline("rows")).select(*best.columns, "root")


def _sorted_words(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def _merged_lists(best: DataFrame) -> DataFrame:
    """piece_id, field, rows: all rows of a field with their root."""
    kept = [c for c in best.columns if c not in ("piece_id", "field")]
    lists = best.groupBy("piece_id", "field").agg(F.collect_list(F.struct(*kept, _sorted_words(F.col("key")).alias("same"))).alias("all"))

    def value(group: Column, key: Column) -> Column:
        """A value of several rows: its key, words, and when it was first seen."""
        return F.struct(key.alias("key"), F.split(key, " ").alias("words"), F.array_min(F.transform(group, lambda r: r["seq"])).alias("seq"))

    def last_key(group: Column) -> Column:
        """The key first seen last: of each key the earliest row counts."""
        first = F.filter(group, lambda r: ~F.exists(group, lambda o: (o["key"] == r["key"]) & (o["seq"] < r["seq"])))
        return F.array_max(F.transform(first, lambda r: F.struct(r["seq"].alias("seq"), r["key"].alias("key"))))["key"]

    def parent(v: Column, values: Column) -> Column:
        ranked = F.array_max(F.transform(F.filter(values, lambda o: _contains(o, v)), lambda o: F.struct(F.length(o["key"]).alias("n"), (-o["seq"]).alias("s"), o["key"].alias("key"))))
        return F.coalesce(ranked["key"], v["key"])

    all_ = F.col("all")
    sames = F.array_distinct(F.transform(all_, lambda r: r["same"]))
    one = (F.size(all_) == 1) | (F.size(F.array_distinct(F.transform(all_, lambda r: r["key"]))) == 1)
    groups = lists.withColumn("values", F.when(~one, F.transform(sames, lambda s: let(F.filter(all_, lambda r: r["same"] == s), lambda g: F.struct(s.alias("same"), value(g, last_key(g)).alias("v"))))))
    values = F.transform("values", lambda x: x["v"])
    ups = groups.withColumn("ups", F.when(F.size("values") > 1, F.map_from_entries(F.transform(values, lambda v: F.struct(v["key"].alias("key"), parent(v, values).alias("up"))))))
    # each turn replaces every parent by its own parent: as many turns as double up to the number of values
    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size("values"))).cast("int"))
    roots = ups.withColumn("up_of", F.when(F.col("ups").isNotNull(), F.aggregate(turns, F.col("ups"), lambda m, _: F.transform_values(m, lambda k, up: F.try_element_at(m, up)))))
    survivor = lambda same: F.get(F.filter("values", lambda x: x["same"] == same), F.lit(0))["v"]["key"]
    root = lambda r: F.when(one, r["key"]).otherwise(let(survivor(r["same"]), lambda k: F.coalesce(F.try_element_at("up_of", k), k)))
    alone = F.transform("all", lambda r: F.struct(*[r[c].alias(c) for c in kept], r["key"].alias("root")))
    merged = F.transform("all", lambda r: F.struct(*[r[c].alias(c) for c in kept], root(r).alias("root")))
    return roots.select("piece_id", "field", F.when(F.size("all") == 1, alone).otherwise(merged).alias("rows"))


def _merged_by_index(best: DataFrame) -> DataFrame:
    """The same by joins.

    A key that contains another one through all its words is contained in whatever contains it, and longer keys come first, so chains have
    at most two links unless keys repeat words; three links are followed.
    """
    field = ["piece_id", "field"]
    seen = best.withColumn("first", F.min("seq").over(Window.partitionBy(*field, "key"))).withColumn("same", _sorted_words(F.col("key")))
    pooled = seen.withColumn("survivor", F.max(F.struct("first", "key")).over(Window.partitionBy(*field, "same"))["key"])
    values = pooled.groupBy(*field, F.col("survivor").alias("key")).agg(F.min("seq").alias("seq")).withColumn("words", F.split("key", " "))
    index = values.select(*field, F.struct("key", "words", "seq").alias("o"), F.explode(F.array_distinct("words")).alias("word"))
    often = index.withColumn("n", F.count("*").over(Window.partitionBy(*field, "word")))
    leads = often.groupBy(*field, F.col("o").alias("v")).agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    fuller = leads.join(index, [*field, "word"]).where(_contains(F.col("o"), F.col("v")))
    ups = fuller.groupBy(*field, F.col("v.key").alias("survivor")).agg(F.max(F.struct(F.length("o.key").alias("n"), (-F.col("o.seq")).alias("s"), F.col("o.key").alias("key")))["key"].alias("up"))
    for n in range(2):
        further = ups.select(*field, F.col("survivor").alias("up"), F.col("up").alias("next"))
        rooted = (rooted if n else ups).join(further, [*field, "up"], "left").withColumn("up", F.coalesce("next", "up")).select(*field, "survivor", "up")
    out = pooled.join(rooted, [*field, "survivor"], "left")
    return out.select(*best.columns, F.coalesce("up", "survivor").alias("root"))


def _fields_of_lists(lists: DataFrame) -> DataFrame:
    """piece_id, field, value, score, rival, sources, alternatives, all worked out inside the row that holds a field's spellings."""
    rows = F.col("rows")

    def scored(group: Column) -> Column:
        """A value of several rows, in the order of ranks: the best score first, then what was seen first."""
        said = F.array_sort(F.array_distinct(F.transform(group, lambda r: r["source"])))
        weights = F.array_compact(F.transform(said, lambda s: F.array_max(F.transform(F.filter(group, lambda r: r["source"].eqNullSafe(s)), lambda r: r["weight"]))))
        doubt = F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(1.0), lambda d, w: d * (F.lit(1.0) - w)))
        shown = F.array_max(F.transform(group, lambda r: F.struct(F.length(r["value"]).alias("n"), (r["key"] == r["root"]).alias("own"), (-r["seq"]).alias("s"), r["value"].alias("value"))))
        score = F.least(F.lit(1.0) - doubt, F.lit(CERTAIN))
        return F.struct((-score).alias("below"), F.array_min(F.transform(group, lambda r: r["seq"])).alias("seq"), score.alias("score"), shown["value"].alias("value"), F.array_compact(said).alias("sources"))

    only = rows[0]
    single = F.array(F.struct(F.lit(0.0).alias("below"), only["seq"].alias("seq"), F.least(F.lit(1.0) - (F.lit(1.0) - only["weight"]), F.lit(CERTAIN)).alias("score"), only["value"].alias("value"), F.array_compact(F.array(only["source"])).alias("sources")))
    several = F.transform(F.array_distinct(F.transform(rows, lambda r: r["root"])), lambda k: let(F.filter(rows, lambda r: r["root"] == k), scored))
    ranked = lists.select("piece_id", "field", F.slice(F.when(F.size(rows) == 1, single).otherwise(F.array_sort(several)), 1, 4).alias("ranked"))
    row = lambda v, i: F.struct((i + 1).alias("rank"), v["value"].alias("value"), rounded(v["score"]).alias("score"), v["sources"].alias("sources"))
    others = F.filter(F.transform("ranked", row), lambda v: v["rank"] > 1)
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return ranked.select("piece_id", "field", first["value"].alias("value"), first["score"].alias("score"), second["score"].alias("rival"), first["sources"].alias("sources"), others.alias("alternatives"))


def _fields_of_rows(rooted: DataFrame, merged: bool) -> DataFrame:
    """The same by aggregations, for pieces of any number of values."""
    shown = F.struct(F.length("value").alias("n"), (F.col("key") == F.col("root")).alias("own"), (-F.col("seq")).alias("s"), F.col("value").alias("value"))
    if merged:
        sources = rooted.groupBy("piece_id", "field", "root", "source").agg(F.max("weight").alias("weight"), F.max(shown).alias("shown"), F.min("seq").alias("seq"))
    else:
        # one row a key and source already
        sources = rooted.withColumn("shown", shown)
    values = sources.groupBy("piece_id", "field", "root").agg(noisy_or(F.col("weight")).alias("score"), F.max("shown").alias("shown"), F.min("seq").alias("seq"), F.array_sort(F.collect_set("source")).alias("sources"))
    order = Window.partitionBy("piece_id", "field").orderBy(F.col("score").desc(), "seq")
    ranked = values.withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    row = F.struct("rank", F.col("shown.value").alias("value"), rounded(F.col("score")).alias("score"), "sources")
    return ranked.groupBy("piece_id", "field").agg(
        F.max(F.when(F.col("rank") == 1, F.col("shown.value"))).alias("value"),
        pick("score", 1).alias("score"),
        pick("score", 2).alias("rival"),
        F.max(F.when(F.col("rank") == 1, F.col("sources"))).alias("sources"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, row))).alias("alternatives"),
    )


def resolve_fields(candidates: DataFrame, folds: Folds = FOLDS, merge: bool = True, by_index: bool = False) -> DataFrame:
    """One row per (piece_id, field): value, confidence, conflict, sources, alternatives (up to three).

    Null and empty values have no say.  Rows that repeat a source count once, with their best weight.  Equal scores
    are ordered by what was seen first.  `merge` off compares folded values as they are; `by_index` is for pieces of thousands of values.
    """
    best = best_per_source(candidates, folds)
    if merge and not by_index:
        fields = _fields_of_lists(_merged_lists(best))
    else:
        fields = _fields_of_rows(merge_spellings(best, by_index) if merge else best.withColumn("root", F.col("key")), merge)
    conflict = F.coalesce(F.col("rival") >= F.col("score") * CONFLICT_RATIO, F.lit(False))
    sure = F.when(conflict, F.least("score", F.lit(CONFLICT_CAP))).otherwise(F.col("score"))
    return fields.select("piece_id", "field", "value", rounded(sure).alias("confidence"), conflict.alias("conflict"), "sources", "alternatives")


def combine(fields: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """One row per piece: confidence, conflicted (sorted field names), missing, notes."""
    need = [F.coalesce(F.max(F.when(F.col("field") == r, F.col("confidence"))), F.lit(0.0)) for r in required]
    weakest = F.least(*need) if len(need) > 1 else need[0]
    damaged = F.array_sort(F.collect_set(F.when(F.col("field").isin(*required) & F.contains("value", F.lit(DAMAGED)), F.col("field"))))
    pieces = fields.groupBy("piece_id").agg(
        weakest.alias("weakest"), F.array_sort(F.collect_set(F.when(F.col("conflict"), F.col("field")))).alias("conflicted"), damaged.alias("damaged"),
        F.array_except(F.array(*map(F.lit, required)), F.collect_set("field")).alias("missing"),
    )
    sure = F.when(F.size("conflicted") > 0, F.least("weakest", F.lit(CONFLICT_CAP))).otherwise(F.col("weakest"))
    sure = F.when(F.size("damaged") > 0, F.least(sure, F.lit(AUTO_ACCEPT - 0.05))).otherwise(sure)
    notes = F.array_compact(F.array(
        F.when(F.size("conflicted") > 0, F.concat(F.lit("signals disagree on "), F.array_join("conflicted", ", "))),
        F.when(F.size("damaged") > 0, F.concat(F.lit("unreadable characters in "), F.array_join("damaged", ", "))),
    ))
    return pieces.select("piece_id", rounded(sure).alias("confidence"), "conflicted", "missing", notes.alias("notes"))


def route(confidence: Column, auto_accept: Column | float = AUTO_ACCEPT, review_floor: Column | float = REVIEW_FLOOR) -> Column:
    return F.when(confidence >= auto_accept, "accept").when(confidence >= review_floor, "review").otherwise("hold")


def reviewed_route(routed: Column, state: Column) -> Column:
    """A person's approval or rejection stands above the computed route."""
    return F.when(state == "accepted", "accept").when(state == "rejected", "hold").otherwise(routed)


def resolve_pieces(candidates: DataFrame, thresholds: DataFrame | None = None, required: Sequence[str] = REQUIRED_FIELDS, folds: Folds = FOLDS, merge: bool = True) -> DataFrame:
    """Candidates to routed pieces.  `thresholds`: piece_id, auto_accept, review_floor, nulls meaning the defaults."""
    return resolve_pieces_of(resolve_fields(candidates, folds, merge), thresholds, required)


def resolve_pieces_of(fields: DataFrame, thresholds: DataFrame | None = None, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Resolved fields to routed pieces, as `resolve_pieces`."""
    pieces = combine(fields, required)
    if thresholds is None:
        return pieces.withColumn("route", route(F.col("confidence")))
    joined = pieces.join(thresholds, "piece_id", "left")
    own = route(F.col("confidence"), F.coalesce("auto_accept", F.lit(AUTO_ACCEPT)), F.coalesce("review_floor", F.lit(REVIEW_FLOOR)))
    return joined.withColumn("route", own).drop("auto_accept", "review_floor")


# Resolved fields and the columns of a piece they fill.
COLUMN_OF = {
    "composer": "composer_name", "title": "title", "work_title": "work_title", "movement": "movement", "movement_title": "movement_title", "catalog": "catalog_display", "key": "music_key",
    "form": "form", "instrumentation": "instrumentation", "arranger": "arranger", "publisher": "publisher", "edition": "edition",
}


def denormalise(fields: DataFrame, columns: dict[str, str] = COLUMN_OF) -> DataFrame:
    """One row per piece with a column for each field; a field without a value is null, `movement` an integer."""
    aggs = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for f, c in columns.items()]
    out = fields.groupBy("piece_id").agg(*aggs)
    return out.withColumn("movement", F.col("movement").try_cast("int")) if "movement" in out.columns else out


def with_decisions(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted values (piece_id, field, value) stand in for what was resolved, with confidence 1 and no conflict."""
    both = fields.join(decisions.select("piece_id", "field", F.col("value").alias("decided")), ["piece_id", "field"], "full")
    has = F.col("decided").isNotNull()
    return both.select(
        "piece_id", "field", F.coalesce("decided", "value").alias("value"), F.when(has, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(~has & F.col("conflict"), F.lit(False)).alias("conflict"), F.when(has, F.array(F.lit("decision"))).otherwise(F.col("sources")).alias("sources"), "alternatives",
    )


def recompute(candidates: DataFrame, pieces: DataFrame) -> DataFrame:
    """All derived columns of `pieces` anew from stored candidates and decisions.

    `candidates` has `accepted`; weights are clamped to [0.01, 1].  `pieces` has piece_id, review_state,
    ingest_notes, auto_accept and review_floor.  Pieces without candidates end on hold with nulls.
    """
    decided = candidates.where("accepted").groupBy("piece_id", "field").agg(F.max_by("value", "seq").alias("value"))
    weighed = candidates.where("NOT coalesce(accepted, false)").withColumn("weight", F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("weight"))))
    fields = with_decisions(resolve_fields(weighed), decided)
    wide, sums = denormalise(fields), combine(fields)
    out = pieces.join(wide, "piece_id", "left").join(sums, "piece_id", "left")
    sure = F.coalesce("confidence", F.lit(0.0))
    routed = route(sure, F.coalesce("auto_accept", F.lit(AUTO_ACCEPT)), F.coalesce("review_floor", F.lit(REVIEW_FLOOR)))
    none = F.array().cast("array<string>")
    return out.select("piece_id", "review_state", *COLUMN_OF.values(), sure.alias("confidence"), reviewed_route(routed, F.col("review_state")).alias("route"), F.concat(F.coalesce("ingest_notes", none), F.coalesce("notes", none)).alias("notes"))
