"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, language, source.  A token budget flows down it.  At each node it is shared among
the children in proportion to their weights; a child that cannot use its share (its texts, read at most
`epochs` times, have fewer tokens) gets all it can use and the rest goes to its siblings, again by weight.
A node's capacity is the sum of its children's, so that a shortage leaves a node only when all below it
are full: siblings before ancestors.  Shares are integers: `rest * weight div weights`.

Each leaf then takes a token prefix of its texts in a seeded order, epoch after epoch, each epoch in an order of
its own.  The prefix is found without sorting a leaf in one task: texts fall to `BINS` bins by their order
key, bin totals are summed along the bins, and only the bin where the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, stored, table, unused

LEVELS = ["domain", "lang", "source"]
BINS_HEX = 3  # hex digits of the order key that name a bin: 16 ** 3 bins
SEED = 17


def n_tokens(text: Column) -> Column:
    """Words of a text; null and empty have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column, *more: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), *(F.col(c).cast("string") for c in more)))


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `got` to nodes that have `weight`, `cap` and their parent's `budget`.

    Children are filled in the order of capacity to weight: a child is full if its proportional share of what
    the fuller ones before it left is no less than its capacity.  Weights are positive integers.
    """
    order = "PARTITION BY " + ", ".join(parent) + " ORDER BY cap / weight, weight, name" if parent else "ORDER BY cap / weight, weight, name"
    whole = "PARTITION BY " + ", ".join(parent) if parent else ""
    before = nodes.withColumn("caps_before", F.expr(f"coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    before = before.withColumn("weight_left", F.expr(f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
    # decimals: rest * weight overflows a long at 100 TB
    full = "CAST(budget - caps_before AS DECIMAL(38,0)) * weight >= CAST(cap AS DECIMAL(38,0)) * weight_left"
    marked = before.withColumn("full", F.expr(full))
    rest = f"greatest(budget - coalesce(sum(CASE WHEN full THEN cap END) OVER ({whole}), 0L), 0L)"
    left = f"sum(CASE WHEN full THEN 0L ELSE weight END) OVER ({whole})"
    dealt = marked.withColumn("rest", F.expr(rest)).withColumn("left", F.expr(left))
    got = F.expr("CASE WHEN full THEN cap ELSE CAST(CAST(rest AS DECIMAL(38,0)) * weight div left AS BIGINT) END")
    return dealt.withColumn("got", got).drop("caps_before", "weight_left", "full", "rest", "left")


def budgets(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, got of each leaf; `leaves` has one row a leaf with its weights and tokens.

    Weight columns: w_domain, w_lang, w_source (positive integers).  `budget` is a column over all leaves' tokens.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = leaves.groupBy("domain").agg(F.max("w_domain").alias("weight"), F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = domains.agg(budget.alias("budget"))  # one row
    top = share_out(domains.join(F.broadcast(total)).withColumn("name", F.col("domain")), []).select("domain", F.col("got").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.max("w_lang").alias("weight"), F.sum("cap").alias("cap")).join(top, "domain")
    mid = share_out(langs.withColumn("name", F.col("lang")), ["domain"]).select("domain", "lang", F.col("got").alias("budget"))
    ends = leaves.withColumn("weight", F.col("w_source")).withColumn("name", F.col("source")).join(mid, ["domain", "lang"])
    return share_out(ends, ["domain", "lang"]).select(*LEVELS, "tokens", "got")


def places(rows: DataFrame, quota: DataFrame, epochs: int, seed: int = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """Places of rows that fill their leaf's `got`, for each epoch: domain, lang, source, epoch, doc_id, tokens, `n` and `take`.

    A place holds the `n` rows that are equal in leaf, doc_id, tokens and the columns `more`, so a million rows of one id or none weigh
    as one; the leaf has `take` of them, at least 1.  With `start` the number of tokens of the leaf before a row, rows with start < got
    are taken, the last may reach over it.  Places are ordered by a hash of epoch, id and `more`, then by id, tokens and `more`.  Rows without
    tokens are taken where a row at their place would be.  An empty table, or a budget of 0, gives no rows.
    """
    met = rows.groupBy(*LEVELS, "doc_id", "tokens", *more).agg(F.count("*").alias("n"))
    keyed = None
    for epoch in range(epochs):
        # an epoch is looked at only where the budget reaches it
        open_ = quota.where(F.col("got") > F.col("tokens") * epoch).select(*LEVELS, (F.col("got") - F.col("tokens") * epoch).alias("want"))
        part = met.join(open_, LEVELS).withColumn("epoch", F.lit(epoch)).withColumn("key", order_key(seed, F.lit(epoch), F.col("doc_id"), *more))
        keyed = part if keyed is None else keyed.unionByName(part)
    keyed = stored(keyed.withColumn("bin", F.substring("key", 1, BINS_HEX)), "mix")
    where = [*LEVELS, "epoch"]
    bins = keyed.groupBy(*where, "bin", "want").agg(F.sum(F.col("tokens") * F.col("n")).alias("in_bin"))
    before = bins.withColumn("before", F.expr(f"sum(in_bin) OVER (PARTITION BY {', '.join(where)} ORDER BY bin) - in_bin")).where("before < want").select(*where, "bin", "in_bin", "before")
    found = keyed.join(before, [*where, "bin"])
    inside = found.where("before + in_bin < want").withColumn("take", F.col("n"))
    order = ", ".join(["key", "doc_id", "tokens", *more])
    start = f"before + sum(tokens * n) OVER (PARTITION BY {', '.join(where)}, bin ORDER BY {order} ROWS UNBOUNDED PRECEDING) - tokens * n"
    edge = found.where("before + in_bin >= want").withColumn("start", F.expr(start)).where("start < want")
    edge = edge.withColumn("take", F.expr("CASE WHEN tokens = 0 THEN n ELSE least(n, (want - start + tokens - 1) div tokens) END")).drop("start")
    return inside.unionByName(edge).select(*where, "doc_id", "tokens", *more, "n", "take")


#: Copies of a place that are written out in one go.
COPIES = 10_000


def prefix(rows: DataFrame, quota: DataFrame, epochs: int, seed: int = SEED) -> DataFrame:
    """The rows (domain, lang, source, doc_id, tokens) that fill their leaf's `got`, one for each epoch they are read in; see `places`."""
    taken = stored(places(rows, quota, epochs, seed).drop("n"), "taken")
    many = taken.where(F.col("take") > COPIES).withColumn("block", F.explode(F.expr(f"sequence(0L, (take - 1) div {COPIES})")))
    many = many.withColumn("take", F.expr(f"least({COPIES}L, take - block * {COPIES})")).repartition("source", "doc_id", "tokens", "block").drop("block")
    every = taken.where(F.col("take") <= COPIES).unionByName(many)
    return every.withColumn("copy", F.explode(F.expr("sequence(1L, take)"))).select(*LEVELS, "epoch", "doc_id", "tokens")


#: The weights of the query: what a domain, language or source is worth beside its siblings.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2}
OTHER_LANG, EPOCHS = 1, 2
#: Sources fall to domains by their number; sources without one are web.
DOMAIN_OF = "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 = 1 THEN 'books' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 = 2 THEN 'code' ELSE 'web' END"
WEIGHT_OF_SOURCE = "1 + coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0L) % 4"


def _weights(names: str, weights: dict[str, int], other: int) -> Column:
    return F.expr("CASE " + " ".join(f"WHEN {names} = '{k}' THEN {v}L" for k, v in weights.items()) + f" ELSE {other}L END")


def tree_rows(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, tokens, the place in the tree and the columns `more` of every row; null language and source are named `none`."""
    placed = documents.select(*more, "doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), n_tokens(F.col("text")).alias("tokens"))
    return placed.withColumn("domain", F.expr(DOMAIN_OF))


def leaf_weights(rows: DataFrame) -> DataFrame:
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    return leaves.withColumns({"w_domain": _weights("domain", DOMAIN_WEIGHTS, 1), "w_lang": _weights("lang", LANG_WEIGHTS, OTHER_LANG), "w_source": F.expr(WEIGHT_OF_SOURCE)})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's tokens, shared out by weight; one row for each document and epoch taken.

    Null languages and sources are leaves named none, null texts have no tokens; see `places` for null and repeated ids and empty tables.
    """
    rows = stored(tree_rows(table(spark, sf_dir, "documents")), "tree")
    quota = stored(budgets(leaf_weights(rows), F.expr("sum(tokens) div 2"), EPOCHS), "quota")
    taken = prefix(rows, quota, EPOCHS)
    return taken.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


#: The pipeline reads each document once at most, and asks for nine tenths of the tokens.
STAGE_BUDGET, STAGE_EPOCHS = "CAST(sum(tokens) * 9 div 10 AS BIGINT)", 1


def first_rows(rows: DataFrame) -> DataFrame:
    """`nr` of the first `take` rows of each place, where a place has more; `rows`: nr, place, body, take, with nr drawn per partition.

    Rows are numbered inside the partition that drew their nr, and counts of partitions are summed, so no place is sorted in one task.
    """
    at = ["place", "body", "part"]
    rows = rows.withColumn("part", F.shiftright("nr", 33))
    counts = rows.groupBy(*at).agg(F.count("*").alias("m"))
    counts = counts.withColumn("before", F.expr("sum(m) OVER (PARTITION BY place, body ORDER BY part) - m")).drop("m")
    numbered = rows.withColumn("nth", F.expr("row_number() OVER (PARTITION BY place, body, part ORDER BY nr)"))
    return numbered.join(counts, at).where("before + nth <= take").select("nr")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, columns as given; other columns are carried along unread.  An empty table gives none.

    Rows are taken one by one, by a key of their own: of rows that repeat an id, and of rows without one, as many as fit, in the order of a hash
    of id and text; of rows equal in id, text and leaf those that come first.  So a leaf passes its budget by less than one document.
    """
    key = unused(docs, "key")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    tree = tree_rows(rows, F.col(key).alias("nr"), F.xxhash64("text").alias("body"))
    tree = stored(tree.withColumn("place", F.xxhash64(*LEVELS, "doc_id", "tokens")), "tree")
    quota = stored(budgets(leaf_weights(tree), F.expr(STAGE_BUDGET), STAGE_EPOCHS), "quota")
    taken = places(tree, quota, STAGE_EPOCHS, more=("body",)).withColumn("place", F.xxhash64(*LEVELS, "doc_id", "tokens"))
    taken = stored(taken.select("place", "body", "n", "take"), "taken")
    keys = tree.select("nr", "place", "body")
    whole = hot_join(keys, taken.where("take = n").drop("take"), ["place", "body"], how="left_semi").select("nr")
    some = first_rows(hot_join(keys, taken.where("take < n"), ["place", "body"]).select("nr", "place", "body", "take"))
    keep = whole.unionByName(some).withColumnRenamed("nr", key)
    return rows.join(keep, key, "left_semi").select(*docs.columns)


SQL = """
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS tokens,
         coalesce(try_cast(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1) AS BIGINT), 0) AS nr FROM documents
), tree AS (SELECT *, CASE nr % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain FROM rows_),
leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 2 AS cap, any_value(1 + nr % 4) AS w_source,
         CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w_domain
  FROM tree GROUP BY domain, lang, source
), d0 AS (SELECT domain, max(w_domain)::HUGEINT AS weight, sum(cap)::HUGEINT AS cap, (SELECT sum(tokens)::HUGEINT // 2 FROM leaves) AS budget FROM leaves GROUP BY domain),
d1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(weight) OVER (ORDER BY cap / weight, weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM d0),
d2 AS (SELECT *, (budget - cb) * weight >= cap * wl AS full_ FROM d1),
d3 AS (SELECT domain, CASE WHEN full_ THEN cap ELSE greatest(budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0), 0) * weight // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS budget FROM d2),
l0 AS (SELECT domain, lang, max(w_lang)::HUGEINT AS weight, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY domain, lang),
l1 AS (SELECT l0.*, budget, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM l0 JOIN d3 USING (domain)),
l2 AS (SELECT *, (budget - cb) * weight >= cap * wl AS full_ FROM l1),
l3 AS (SELECT domain, lang, CASE WHEN full_ THEN cap ELSE greatest(budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain), 0), 0) * weight // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain) END AS budget FROM l2),
s0 AS (SELECT domain, lang, source, tokens, w_source::HUGEINT AS weight, cap::HUGEINT AS cap, budget FROM leaves JOIN l3 USING (domain, lang)),
s1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s0),
s2 AS (SELECT *, (budget - cb) * weight >= cap * wl AS full_ FROM s1),
s3 AS (SELECT domain, lang, source, tokens AS leaf_tokens, CASE WHEN full_ THEN cap ELSE greatest(budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain, lang), 0), 0) * weight // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain, lang) END AS got FROM s2),
read AS (SELECT tree.*, epoch, got - leaf_tokens * epoch AS want, md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM tree JOIN s3 USING (domain, lang, source) CROSS JOIN (VALUES (0), (1)) e(epoch) WHERE got > leaf_tokens * epoch),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS start FROM read)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens FROM placed WHERE start < want
"""
