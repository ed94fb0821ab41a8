"""Chat formatting by quotation linking.

A message's lines that start with `>` marks are quoted; the number of marks is the quote level.  Lines of one
level that follow each other form a passage.  Passages are normalised (marks off, A-Z lower-cased, line breaks and other runs
of white space to one space), so that a quotation may be wrapped anew, and hashed.  So are the word windows of what
each message says itself, of the lengths that passages of its conversation have, and both are joined: a passage
belongs to the latest earlier message of its conversation that says it, wherever in that message.  A message replies to
the source of most of its passages of the lowest level at which a source is known (of equal counts the latest);
a message that quotes nothing known replies to the message before it.  What remains without the quotes is the chat
format: own text, the turn it answers, and its place in reply order, each answer after its message and threads whole.

A join on (conversation, hash) finds the sources, so a line that everybody says costs nothing unless somebody
quotes it.  No conversation is gathered in one task: the message before, and the order of the replies, come from windows over
`RANGE` turns each and from pointer jumping over (conversation, turn), whose rounds grow with the logarithm of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hot_join, small_batches, stored, table
from .sketches import bound

MARKS = r"^\s*((?:>\s?)+)"
#: Turns of a conversation that one window holds.
RANGE = 4096
KEY = ["conv_id", "turn"]


def level_of(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def normal(text: Column) -> Column:
    """A-Z lower-cased, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"\s+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, norm>> of a text's passages in order; level 0 is what the message says itself."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def cut(ls: Column) -> Column:
        return bound(F.transform(ls, level_of), lambda levels: runs(ls, levels))

    def runs(ls: Column, levels: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(levels) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(levels, i) != F.get(levels, i - 1)))
        return bound(starts, lambda at: F.transform(at, lambda a, k: one(ls, levels, a, F.coalesce(F.get(at, k + 1), F.size(levels)))))

    def one(ls: Column, levels: Column, a: Column, b: Column) -> Column:
        part = F.transform(F.slice(ls, a + 1, b - a), lambda x: F.regexp_replace(x, MARKS, ""))
        return F.struct(F.get(levels, a).alias("level"), normal(F.array_join(part, " ")).alias("norm"))

    return bound(lines, cut)


def following(rows: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """`rows` (distinct in group and column) with `name`, the next greater value of the integer `column` in the group.

    Windows reach over `RANGE` values; the ends of the ranges are joined to the start of the next one.
    """
    by = ", ".join(group)
    ranged = rows.withColumn("range_", F.floor(F.col(column) / RANGE).cast("long"))
    starts = ranged.groupBy(*group, "range_").agg(F.min(column).alias("least"))
    starts = starts.withColumn("over", F.expr(f"lead(least) OVER (PARTITION BY {by} ORDER BY range_)")).select(*group, "range_", "over")
    inside = ranged.withColumn("inside", F.expr(f"lead({column}) OVER (PARTITION BY {by}, range_ ORDER BY {column})"))
    return inside.join(starts, [*group, "range_"]).withColumn(name, F.coalesce("inside", "over")).drop("range_", "inside", "over")


#: Window hashes are sums of word hashes times powers of a base, to three prime moduli of 31 bits: 93 bits in all.
PRIMES = (2**31 - 1, 2**31 - 19, 2**31 - 61)
BASES = (1_103_515_245, 1_664_525_017, 1_442_695_041)


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    found = np.ones(1, dtype=np.int64)
    while len(found) < n:
        found = np.concatenate([found, found * pow(base, len(found), prime) % prime])
    return found[:n]


def window_keys(words: list[str], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that `words` have: (hash, check) of every window of so many words, in time that doesn't grow with the length."""
    raw = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    sums, backs = [], []
    for prime, base in zip(PRIMES, BASES, strict=True):
        terms = (raw % np.uint64(prime)).astype(np.int64) * _powers(base, len(words), prime) % prime
        sums.append(np.concatenate([[0], np.cumsum(terms)]))
        backs.append(_powers(pow(base, -1, prime), len(words), prime))
    for k in sorted(lengths):
        if k <= len(words):
            at = [(total[k:] - total[:-k]) % prime * back[: len(words) - k + 1] % prime for total, back, prime in zip(sums, backs, PRIMES, strict=True)]
            yield (at[0] << 32) | at[1], at[2].astype(np.int32)


def _passage_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, hashes, checks = [], [], []
        for norm in batch.column("norm").to_pylist():
            split = norm.split(" ")
            hash_, check = next(window_keys(split, [len(split)]))
            words.append(len(split))
            hashes.append(hash_[0])
            checks.append(check[0])
        kept = ["conv_id", "turn", "nr", "level"]
        arrays = [*(batch.column(c) for c in kept), pa.array(words, pa.int32()), pa.array(hashes, pa.int64()), pa.array(checks, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "words", "hash", "check"])


#: Words of 64 bits that tell, for a conversation, which window hashes may be asked for; what passes is joined exactly.
SLOTS = 256


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("said", "lengths", "slots", "bits"))
        for i, (said, lengths, slots, bits) in enumerate(zip(*columns, strict=True)):
            asked = np.zeros(SLOTS, dtype=np.uint64)
            asked[slots] = np.array(bits, dtype=np.int64).view(np.uint64)
            for hash_, check in window_keys(said.split(" "), lengths):
                may = np.flatnonzero((asked[hash_ % SLOTS] >> (hash_ // SLOTS % 64).astype(np.uint64)) & np.uint64(1))
                if len(may):
                    same = pa.array(np.full(len(may), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in KEY), pa.array(hash_[may]), pa.array(check[may])], names=[*KEY, "hash", "check"])


def quoted_sources(messages: DataFrame) -> DataFrame:
    """conv_id, turn, nr, level and source (the turn that said it, or null) of every quoted passage that isn't blank."""
    cut = messages.select(*KEY, passages(F.col("text")).alias("ps"))
    all_ = cut.select(*KEY, F.posexplode("ps").alias("nr", "p")).where("p.level > 0 AND p.norm <> ''")
    quoted = all_.select(*KEY, "nr", F.col("p.level").alias("level"), F.col("p.norm").alias("norm"))
    types = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in KEY)
    small_batches(messages.sparkSession)
    quoted = stored(quoted.mapInArrow(_passage_keys, f"{types}, nr int, level int, words int, hash long, check int"), "quoted")
    lengths = quoted.groupBy("conv_id").agg(F.collect_set("words").alias("lengths"))
    # a map of SLOTS x 64 bits of what a conversation asks for, so that windows that nobody quotes are not shuffled
    bit = F.expr(f"shiftleft(1L, CAST(pmod(hash div {SLOTS}, 64) AS INT))")
    slots = quoted.groupBy("conv_id", F.pmod("hash", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.bit_or(bit).alias("bits"))
    asked_bits = slots.groupBy("conv_id").agg(F.collect_list("slot").alias("slots"), F.collect_list("bits").alias("bits"))
    wanted = messages.groupBy("conv_id").agg(F.count("*").alias("n")).join(lengths, "conv_id").join(asked_bits, "conv_id")
    wanted = stored(wanted, "lengths")
    own = F.array_join(F.transform(F.filter("ps", lambda p: p["level"] == 0), lambda p: p["norm"]), " ")
    words = cut.select(*KEY, normal(own).alias("said"))
    windows = hot_join(words, wanted, ["conv_id"]).select(*KEY, "said", "lengths", "slots", "bits").mapInArrow(_window_keys, f"{types}, hash long, check int")
    asked = quoted.select("conv_id", "hash", "check").distinct()
    said = windows.join(asked, ["conv_id", "hash", "check"], "left_semi").distinct()
    marked = quoted.withColumn("said", F.lit(None).cast("long")).drop("words").unionByName(
        said.withColumns({"nr": F.lit(-1), "level": F.lit(0), "said": F.col("turn").cast("long")})
    )
    # strictly earlier turns, so that a message never answers itself
    earlier = F.expr("max(said) OVER (PARTITION BY conv_id, hash, check ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return marked.withColumn("source", earlier).where("level > 0").select(*KEY, "nr", "level", "source")


def reply_order(tree: DataFrame) -> DataFrame:
    """conv_id, turn, place of a forest (conv_id, turn, parent): each message before its answers, those by turn, each with all below it.

    The message after one is its first answer, else the next answer to the nearest message above that has one more.
    Both, and the number of messages after each, are found by pointer jumping: round k reaches 2 ** k messages far, so
    a conversation takes part in as many rounds as its own size asks for, whatever the size of the largest.
    """
    sizes = stored(tree.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    sized = hot_join(tree.select(*KEY, "parent"), sizes, ["conv_id"])
    roots = sized.where("parent IS NULL")
    siblings = following(sized.where("parent IS NOT NULL"), ["conv_id", "parent"], "turn", "sibling")
    siblings = siblings.unionByName(following(roots, ["conv_id"], "turn", "sibling"))
    firsts = tree.where("parent IS NOT NULL").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))

    def climbed(ways: DataFrame) -> DataFrame:
        above = ways.select("conv_id", F.col("turn").alias("up"), F.col("leave").alias("up_leave"), F.col("up").alias("up_up"))
        joined = ways.join(above, ["conv_id", "up"], "left")
        return joined.select(*KEY, "n", F.coalesce("leave", "up_leave").alias("leave"), F.when(F.col("up_leave").isNull(), F.col("up_up")).alias("up"))

    def counted(ranked: DataFrame) -> DataFrame:
        ahead = ranked.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("far"), F.col("left_").alias("more"))
        return ranked.join(ahead, ["conv_id", "to"], "left").select(*KEY, "n", F.col("far").alias("to"), (F.col("left_") + F.coalesce("more", F.lit(0))).alias("left_"))

    ways = siblings.select(*KEY, "n", F.col("sibling").alias("leave"), F.when(F.col("sibling").isNull(), F.col("parent")).alias("up"))
    after = _jumped(ways, climbed, "up", "ways").join(firsts, KEY, "left").select(*KEY, "n", F.coalesce("child", "leave").alias("to"))
    ranked = _jumped(after.withColumn("left_", F.col("to").isNotNull().cast("long")), counted, "to", "ranks")
    return ranked.select(*KEY, (F.col("n") - F.col("left_")).cast("int").alias("place"))


def _jumped(rows: DataFrame, step: Callable[[DataFrame], DataFrame], pointer: str, name: str) -> DataFrame:
    """`rows` after rounds of `step` until no `pointer` is left; those with `n` of at most 2 ** k need k rounds, and take part in no more."""
    live, reach, done = stored(rows, name), 1, []
    while live.where(F.col(pointer).isNotNull()).take(1):
        done.append(live.where(F.col("n") <= reach))
        live = stored(step(live.where(F.col("n") > reach)), name)
        reach *= 2
    return reduce(DataFrame.unionByName, done, live)


def link(messages: DataFrame) -> DataFrame:
    """One row per row of `messages` (conv_id, turn, role, text): the message without quotes and what it replies to.

    Adds own_text, reply_to (a turn, null for the first of a conversation), linked (whether by a quotation),
    n_quoted and n_found (quoted passages, and those whose message is known), max_level, and place (from 1, the reply
    order of the conversation).  Rows that repeat a (conv_id, turn) share all that.  A null conversation or turn is a message by
    itself: place 1, no links.  Null texts say nothing; an empty table gives no rows; other columns are not read.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    sources = stored(quoted_sources(known), "sources")
    votes = sources.where("source IS NOT NULL").groupBy(*KEY, "level", "source").agg(F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "n", "source")).alias("best")
    parent = votes.groupBy(*KEY).agg(best).select(*KEY, F.col("best.source").alias("quoted_turn"))
    counts = sources.groupBy(*KEY).agg(F.count("*").alias("n_quoted"), F.count("source").alias("n_found"), F.max("level").alias("max_level"))
    turns = stored(known.select(*KEY).distinct(), "turns")
    before = following(turns, ["conv_id"], "turn", "next").where("next IS NOT NULL").select("conv_id", F.col("turn").alias("before"), F.col("next").alias("turn"))
    tree = turns.join(before, KEY, "left").join(parent, KEY, "left").join(counts, KEY, "left")
    tree = stored(tree.withColumn("parent", F.coalesce("quoted_turn", "before")), "tree")
    facts = tree.join(reply_order(tree.select(*KEY, "parent")), KEY)
    own = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.rlike(x, F.lit(MARKS))), "\n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return messages.join(facts, KEY, "left").select(
        "conv_id", "turn", "role", F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n")).alias("own_text"),
        F.col("parent").alias("reply_to"), F.col("quoted_turn").isNotNull().alias("linked"),
        zero("n_quoted").cast("long").alias("n_quoted"), zero("n_found").cast("long").alias("n_found"), zero("max_level").cast("int").alias("max_level"),
        F.coalesce("place", F.lit(1)).alias("place"),
    )


def quoting(messages: DataFrame) -> DataFrame:
    """`messages` with quotations of the table's own turns put before their texts, by a fixed rule; the table itself has none.

    A message at turn t of conversation c quotes nothing if t = 0 or (c + t) mod 4 = 0.  Else it quotes at level 1 the first line of turn
    q = (5c + 3t) mod t, wrapped anew after half its words, the second half in capitals with wide spaces; if (c + t)
    mod 4 = 1 it quotes that line backwards, which nobody said.  At level 2, if q > 0, the last line of turn
    r = (c + t) mod q; at level 3, if r > 0, the first line of turn r - 1.
    """
    said = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(*KEY).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    lines = F.split("text", "\n")
    ends = said.select("conv_id", F.col("turn").alias("asked"), F.get(lines, F.lit(0)).alias("head"), F.element_at(lines, -1).alias("tail"))
    # only what a message asks for travels to it: keys go out, single lines come back, and whole texts meet them once
    asks = said.select(*KEY).withColumn("q", F.expr("CASE WHEN turn > 0 AND (conv_id + turn) % 4 <> 0 THEN (5 * conv_id + 3 * turn) % turn END"))
    asks = asks.withColumn("r", F.expr("CASE WHEN q > 0 THEN (conv_id + turn) % q END")).withColumn("s", F.expr("CASE WHEN r > 0 THEN r - 1 END"))
    asks = asks.select(*KEY, F.expr("stack(3, 1, q, 2, r, 3, s) AS (level, asked)")).where("asked IS NOT NULL")
    line = F.when(F.col("level") == 2, F.col("tail")).otherwise(F.col("head"))
    got = asks.join(ends, ["conv_id", "asked"]).select(*KEY, "level", line.alias("line")).groupBy(*KEY)
    got = got.agg(*[F.max(F.when(F.col("level") == k, F.col("line"))).alias(name) for k, name in ((1, "first_q"), (2, "last_r"), (3, "first_s"))])
    rows = messages.join(got, KEY, "left")
    words = F.split("first_q", " ")
    half = F.expr("size(split(first_q, ' ')) div 2")
    wide = F.translate(F.array_join(F.slice(words, half + 1, F.size(words)), "  "), LOWER, UPPER)
    level1 = F.when(F.expr("(conv_id + turn) % 4 = 1"), F.concat(F.lit("> "), F.reverse(F.col("first_q")))).otherwise(F.concat(F.lit("> "), F.array_join(F.slice(words, 1, half), " "), F.lit("\n>  "), wide))
    level2, level3 = F.concat(F.lit(">> "), F.col("last_r")), F.concat(F.lit("> > >"), F.col("first_s"))
    return rows.select("conv_id", "turn", "role", F.concat_ws("\n", level3, level2, level1, "text").alias("text"))


def quotation_links_as_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`link` over the whole table as it stands, whatever it quotes; see there for nulls, repeats and empty tables."""
    return link(table(spark, sf_dir, "conversations"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`link` over the whole table after `quoting`; see both for nulls, repeats and empty tables."""
    return link(stored(quoting(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "quoting"))


_SAID = r"""
WITH RECURSIVE said0 AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), """
_MADE = r"""
ends_ AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS head, string_split(text, chr(10))[-1] AS tail FROM said0),
q0 AS (SELECT *, CASE WHEN turn > 0 AND (conv_id + turn) % 4 <> 0 THEN (5 * conv_id + 3 * turn) % turn END AS q FROM conversations),
q1 AS (SELECT *, CASE WHEN q > 0 THEN (conv_id + turn) % q END AS r FROM q0),
q2 AS (SELECT *, CASE WHEN r > 0 THEN r - 1 END AS s FROM q1),
m AS (
  SELECT q2.conv_id, q2.turn, role, concat_ws(chr(10), '> > >' || c.head, '>> ' || b.tail,
    CASE WHEN (q2.conv_id + q2.turn) % 4 = 1 THEN '> ' || reverse(a.head) ELSE '> ' || array_to_string(w[1:len(w) // 2], ' ') || chr(10) || '>  ' || translate(array_to_string(w[len(w) // 2 + 1:], '  '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END, text) AS text
  FROM q2 LEFT JOIN (SELECT *, string_split(head, ' ') AS w FROM ends_) a ON a.conv_id = q2.conv_id AND a.turn = q LEFT JOIN ends_ b ON b.conv_id = q2.conv_id AND b.turn = r LEFT JOIN ends_ c ON c.conv_id = q2.conv_id AND c.turn = s
), """
_LINKED = r"""
ln AS (
  SELECT conv_id, turn, unnest(range(1, len(parts) + 1)) AS nr, unnest(parts) AS line FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS parts FROM m)
), lv AS (
  SELECT *, length(regexp_extract(line, '^\s*((?:>\s?)+)', 1)) - length(replace(regexp_extract(line, '^\s*((?:>\s?)+)', 1), '>', '')) AS level, regexp_replace(line, '^\s*((?:>\s?)+)', '') AS bare FROM ln
), grp AS (SELECT *, nr - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY nr) AS g FROM lv),
pas AS (SELECT conv_id, turn, level, min(nr) AS nr, trim(regexp_replace(translate(string_agg(bare, ' ' ORDER BY nr), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS norm FROM grp GROUP BY conv_id, turn, level, g),
own AS (SELECT conv_id, turn, ' ' || string_agg(norm, ' ' ORDER BY nr) || ' ' AS said FROM pas WHERE level = 0 AND norm <> '' GROUP BY ALL),
src AS (SELECT p.conv_id, p.turn, p.nr, p.level, max(o.turn) AS source FROM pas p LEFT JOIN own o ON o.conv_id = p.conv_id AND o.turn < p.turn AND contains(o.said, ' ' || p.norm || ' ') WHERE p.level > 0 AND p.norm <> '' GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, source, count(*) AS n FROM src WHERE source IS NOT NULL GROUP BY ALL),
parent AS (SELECT conv_id, turn, source FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
counts AS (SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_found, max(level) AS max_level FROM src GROUP BY ALL),
tree AS (SELECT s.conv_id, s.turn, p.source, coalesce(p.source, lag(s.turn) OVER (PARTITION BY s.conv_id ORDER BY s.turn)) AS reply_to FROM said0 s LEFT JOIN parent p ON p.conv_id = s.conv_id AND p.turn = s.turn),
paths AS (
  SELECT conv_id, turn, [turn] AS path FROM tree WHERE reply_to IS NULL
  UNION ALL SELECT t.conv_id, t.turn, list_append(p.path, t.turn) FROM tree t JOIN paths p ON p.conv_id = t.conv_id AND p.turn = t.reply_to
), placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS place FROM paths)
SELECT m.conv_id, m.turn, m.role,
  trim(regexp_replace(array_to_string(list_filter(string_split(coalesce(m.text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*((?:>\s?)+)')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS own_text,
  t.reply_to, t.source IS NOT NULL AS linked, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_found, 0) AS n_found, CAST(coalesce(max_level, 0) AS INTEGER) AS max_level, CAST(coalesce(place, 1) AS INTEGER) AS place
FROM m LEFT JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN counts c ON c.conv_id = m.conv_id AND c.turn = m.turn LEFT JOIN placed z ON z.conv_id = m.conv_id AND z.turn = m.turn
"""
SQL = _SAID + _MADE + _LINKED
SQL_AS_GIVEN = _SAID + "m AS (SELECT conv_id, turn, role, text FROM conversations), " + _LINKED
