"""Catalogue queries: filters, free-text search, facets, orders, pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.music import SYNONYMS
from evidentia.sources.scratch import stored

MAX_TERMS, MAX_FACET = 8, 200
PAGE, MAX_PAGE = 60, 500
SEARCHED = ("title", "composer_name", "catalog_display", "music_key")
TEXT_FACETS = ["composer_name", "form", "instrumentation", "music_key"]


@dataclass
class Filters:
    """What to narrow a catalogue by; None leaves a filter out."""

    text: dict[str, str] = field(default_factory=dict)  # column -> value, equal or contained
    exact: bool = True
    route: str | None = None
    review_state: str | None = None
    status: str | None = None
    collection_id: int | None = None
    period: str | None = None
    difficulty: tuple[int | None, int | None] = (None, None)
    include_rejected: bool = False
    search: str | None = None


def holds(column: Column, part: str) -> Column:
    """Case-insensitive containment; the part is plain text, % and _ stand for themselves."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def narrow(pieces: DataFrame, f: Filters, composers: DataFrame | None = None) -> DataFrame:
    """Rows of `pieces` that pass the filters.  The period comes from `composers` (canonical_name, period), one row a name."""
    out = pieces
    for column, value in f.text.items():
        out = out.where(F.col(column) == value if f.exact else holds(F.col(column), value))
    for column in ("route", "review_state", "status", "collection_id"):
        if getattr(f, column) is not None:
            out = out.where(F.col(column) == getattr(f, column))
    if f.period is not None:
        out = out.join(composers.where(F.col("period") == f.period).select(F.col("canonical_name").alias("composer_name")), "composer_name", "left_semi")
    low, high = f.difficulty
    if low is not None:
        out = out.where(F.col("difficulty") >= low)
    if high is not None:
        out = out.where(F.col("difficulty") <= high)
    if not f.include_rejected and f.review_state is None:
        out = out.where(F.coalesce(F.col("review_state"), F.lit("")) != "rejected")
    return out.where(search_predicate(f.search)) if f.search else out


def spellings(term: str) -> list[str]:
    """The term, then the other words of its synonym group."""
    for group in SYNONYMS:
        if term.lower() in group:
            return [term, *sorted(w for w in group if w != term.lower())]
    return [term]


def search_predicate(query: str, columns: Sequence[str] = SEARCHED) -> Column:
    """All of the first eight words must be met, each in any searched column or spelling.

    A single letter is a key: the start of the key, or ' in X' in the title.  A catalogue number is met without its
    spaces and dots.  Form is left out: volume titles say too much.
    """
    terms = query.split()[:MAX_TERMS]
    if not terms:
        return F.lit(True)

    def met(term: str) -> Column:
        if len(term) == 1 and term.isalpha():
            return F.coalesce(F.startswith(F.lower("music_key"), F.lit(term.lower())), F.lit(False)) | F.coalesce(holds(F.col("title"), f" in {term}"), F.lit(False))
        tests = [F.coalesce(holds(F.col(c), w), F.lit(False)) for w in spellings(term) for c in columns]
        flat = "".join(ch for ch in term if ch.isalnum()).lower()
        if flat and "catalog_display" in columns:
            tests.append(F.contains(F.translate(F.lower(F.coalesce("catalog_display", F.lit(""))), " .", ""), F.lit(flat)))
        return reduce(lambda a, b: a | b, tests)

    return reduce(lambda a, b: a & b, map(met, terms))


def _title_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def _asked_words(queries: DataFrame) -> DataFrame:
    """query_id, terms (sorted) of the queries that have any word; rows that repeat one another count once."""
    terms = F.array_sort(F.slice(_title_words(F.col("query")), 1, MAX_TERMS))
    return queries.select("query_id", terms.alias("terms")).where(F.size("terms") > 0).distinct()


def _word_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """terms, words, n: the distinct word sets of `index` (words, n) that hold all of each distinct `terms` of `asked`.

    Only words that some query has are kept, and the rarest word of a query leads, so a frequent word makes no rows by itself.
    """
    often = index.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    led = asked.select("terms").distinct().select("terms", F.explode("terms").alias("word")).join(often, "word", "left")
    led = led.groupBy("terms").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), F.col("word"))).alias("word"))
    hits = index.select("words", "n", F.explode("words").alias("word")).join(led, "word")
    return hits.where(F.size(F.array_except("terms", "words")) == 0).select("terms", "words", "n")


def _word_sets(pieces: DataFrame, column: str) -> DataFrame:
    return pieces.select(F.array_sort(_title_words(F.col(column))).alias("words")).groupBy("words").agg(F.count("*").alias("n"))


def batch_words(pieces: DataFrame, queries: DataFrame, column: str = "title") -> DataFrame:
    """(query_id, piece_id) of every hit of a table of queries (query_id, query): all words of a query are words of the column.

    An inverted index join of the distinct word sets of both sides; queries and pieces that have them are joined to what was met.
    """
    asked = _asked_words(queries)
    met = _word_hits(_word_sets(pieces, column), asked).select("terms", "words")
    rows = pieces.select("piece_id", F.array_sort(_title_words(F.col(column))).alias("words"))
    return met.join(rows, "words").join(asked, "terms").select("query_id", "piece_id")


def batch_word_counts(pieces: DataFrame, queries: DataFrame, column: str = "title") -> DataFrame:
    """query_id, hits: how many rows `batch_words` gives for each query that it gives any for.

    Equal word sets are counted before they are met and no hit is written out, so work grows with the rows and with the different
    sets that meet, not with the pairs.
    """
    asked = _asked_words(queries)
    found = _word_hits(_word_sets(pieces, column), asked).groupBy("terms").agg(F.sum("n").alias("hits"))
    return asked.join(found, "terms").groupBy("query_id").agg(F.sum("hits").alias("hits"))


#: Length of the grams of the inverted index, and the rows of pieces and of queries of a gram that meet in one task.
GRAM, LOT, SLOT = 3, 50_000, 1_000
#: Keys that one row of pieces or of queries stands for at most; tests of a row against a row for one task of the meeting.
PIECE_KEYS, QUERY_KEYS, TESTS = 100, 1_000, 2_000_000


def _grams(text: Column, n: int) -> Column:
    """The n-grams of a text, none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))


def _parsed(query: Column) -> Column:
    """The terms of a query: (letter) of a key, or (words, flat), the spellings of a word and its letters and digits alone."""
    synonyms = F.create_map(*[x for group in SYNONYMS for w in group for x in (F.lit(w), F.array(*map(F.lit, group)))])
    terms = F.slice(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), 1, MAX_TERMS)
    none = F.lit(None).cast("string")

    def term(t: Column) -> Column:
        one = F.rlike(t, F.lit(r"^\p{L}$"))
        words = F.when(one, F.array().cast("array<string>")).otherwise(F.coalesce(F.try_element_at(synonyms, t), F.array(t)))
        return F.struct(F.when(one, t).otherwise(none).alias("letter"), words.alias("words"), F.when(one, "").otherwise(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")).alias("flat"))

    return F.transform(terms, term)


def _needles(term: Column) -> Column:
    """What a piece must hold one of to meet a term, as texts: '^d' is the start of a key."""
    letter = F.array(F.concat(F.lit("^"), term["letter"]), F.concat(F.lit(" in "), term["letter"]))
    return F.array_distinct(F.when(term["letter"].isNotNull(), letter).otherwise(F.concat(term["words"], F.when(term["flat"] != "", F.array(term["flat"])).otherwise(F.array().cast("array<string>")))))


def _alike(rows: DataFrame, key: str, columns: Sequence[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(forms, members) of rows (key, columns): what is equal in all columns is worked on once.

    forms: like, columns, several; members: key, like.  A key of one row is like the least such key whose row is equal; a key of several
    different rows is like itself alone, and has several forms.  Rows with a null key are left out.
    """
    said = F.struct(*columns)
    per = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(said).alias("least"), F.max(said).alias("most")), what)
    one = per.where("least = most").select(key, "least.*")
    first = one.groupBy(*columns).agg(F.min(key).alias("like"))
    several = rows.join(per.where("least <> most").select(key), key, "left_semi").distinct().withColumn("like", F.col(key))
    forms = stored(first.withColumn("several", F.lit(False)).unionByName(several.select(*columns, "like", F.lit(True).alias("several"))), what)
    members = one.join(first, list(columns)).select(key, "like").unionByName(several.select(key, "like").distinct())
    return forms, stored(members, what)


def _listed(forms: DataFrame, members: DataFrame, key: str, most: int, what: str) -> DataFrame:
    """`forms` with keys, the members of each in lists of at most `most`: a form of more members has several rows."""
    large = members.groupBy("like").agg(F.count("*").alias("n")).where(F.col("n") > most)
    part = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("n") / F.lit(most))), F.lit(0))
    lists = members.join(large, "like", "left").groupBy("like", part.alias("part")).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    # a part may have a few keys more
    lists = lists.select("like", F.explode(F.transform(F.sequence(F.lit(1), F.size("keys"), F.lit(most)), lambda i: F.slice("keys", i, F.lit(most)))).alias("keys"))
    # dealt anew, since the rows are few and small for the work that is done on each
    return stored(forms.join(lists, "like").repartition(_parts(forms), "keys"), what)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batch_search(pieces: DataFrame, queries: DataFrame, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """(query_id, piece_id) of every piece that `search_predicate` finds for each row of a table of queries (query_id, query).

    Queries of the same terms, and pieces of the same texts, are met once, as rows that hold the lists of their keys.  A pair of rows
    that meets is written out as all pairs of its keys on the spot, one query after the other, so that no table of pairs is
    stored, shuffled or sorted: what lies on the disk grows with pieces and queries, and only the result with their pairs.

    An inverted index of the 1- to 3-grams of all searched columns, of the number without spaces and dots, and of the start of the
    key.  A term is met only by pieces that hold all grams of one of its spellings, so the rarest gram of each spelling stands for it; the
    term whose grams are rarest together leads its query, and only the pieces of those grams are tested, exactly, where they are met.  A piece
    that holds several of them is tested at the first alone.  Grams that no query has never leave the scan, and a gram of very many pieces or
    queries meets them in parts, `LOT` of pieces by `SLOT` of queries.

    Null and empty queries find nothing; a null column holds nothing.  Rows that repeat a piece or a query give a row each
    combination once; the hits of keys that have several different rows, and of no others, are made distinct by a shuffle.  The tables it
    works on are written to the shared folder.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    parsed = queries.select("query_id", _parsed(F.coalesce("query", F.lit(""))).alias("terms")).where(F.size("terms") > 0)
    asked = _listed(*_alike(parsed, "query_id", ["terms"], "asked"), "query_id", QUERY_KEYS, "askers")
    number, key = "catalog_display" in columns, "music_key" in columns
    flat = F.translate("catalog_display", " .", "") if number else F.lit("")
    forms, members = _alike(pieces.select("piece_id", *[low(c).alias(c) for c in columns]), "piece_id", columns, "texts")
    texts = _listed(forms.withColumn("flat", flat), members, "piece_id", PIECE_KEYS, "pieces")
    held = [*map(F.col, columns), F.col("flat")]
    start = F.array(F.concat(F.lit("^"), F.left("music_key", F.lit(1)))) if key else F.array().cast("array<string>")
    grams = F.array_distinct(F.concat(start, *[_grams(t, n) for t in held for n in range(1, GRAM + 1)]))
    postings = texts.select("like", F.explode(grams).alias("gram"))

    # one row a query, term and spelling, with the grams of which all must be there; several rows of a query id are queries of their own
    wanted = asked.select("terms").distinct().select("terms", F.posexplode("terms").alias("nth", "term")).select("terms", "nth", F.posexplode(_needles(F.col("term"))).alias("which", "needle"))
    n = F.length("needle")
    own = F.when(F.startswith("needle", F.lit("^")) & (n == 2), F.array("needle")).when(n >= GRAM, _grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    wanted = stored(wanted.select("terms", "nth", "which", F.explode(F.array_distinct(own)).alias("gram")), "wanted")
    often = postings.join(stored(wanted.select("gram").distinct(), "grams"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("terms", "nth", "which").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("best"))
    cost = rarest.groupBy("terms", "nth").agg(F.sum("best.n").alias("cost"), F.array_sort(F.collect_set("best")).alias("grams"))
    leads = cost.groupBy("terms").agg(F.min_by("grams", F.struct("cost", "nth")).alias("grams")).select("terms", F.filter("grams", lambda g: g["n"] > 0).alias("grams"))
    before = F.transform(F.slice("grams", F.lit(1), F.col("place")), lambda g: g["gram"])
    leads = leads.select("terms", "grams", F.posexplode("grams").alias("place", "g")).select("terms", "g.gram", "g.n", before.alias("before"))
    leads = stored(asked.withColumnsRenamed({"like": "ask", "keys": "askers", "several": "unlike"}).join(leads, "terms"), "leads")

    # a frequent gram is parted: its pieces by their hash, copied to each part of its queries, and the other way round
    met_by = leads.groupBy("gram", "n").agg(F.count("*").alias("asks"))
    wide = stored(met_by.select("gram", F.ceil(F.col("n") / F.lit(LOT)).alias("parts"), F.ceil(F.col("asks") / F.lit(SLOT)).alias("slots"), (F.col("n") * F.col("asks")).alias("tests")), "wide")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    led = leads.join(wide, "gram").select("terms", "gram", "before", "askers", "unlike", F.pmod(F.xxhash64("ask", "askers"), F.col("slots")).alias("slot"), each("parts").alias("lot"))
    lots = texts.withColumn("gram", F.explode(grams))
    if _small(wide):
        lots = lots.join(F.broadcast(wide), "gram")
    else:  # texts join the grams that are left, not all
        lots = lots.select("like", "gram").distinct().join(wide, "gram").join(texts, "like")
    lots = lots.select(*columns, "gram", "keys", "several", F.pmod(F.xxhash64("like", "keys"), F.col("parts")).alias("lot"), each("slots").alias("slot"))
    tasks = max(_parts(pieces), min((wide.agg(F.sum("tests")).first()[0] or 0) // TESTS, 4096))

    def met(t: Column) -> Column:
        holds_ = lambda w: reduce(lambda a, b: a | b, [F.contains(F.col(c), w) for c in columns])
        in_key = (F.startswith(F.col("music_key"), t["letter"]) if key else F.lit(False)) | (F.contains(F.col("title"), F.concat(F.lit(" in "), t["letter"])) if "title" in columns else F.lit(False))
        by_number = (t["flat"] != "") & F.contains(F.col("flat"), t["flat"]) if number else F.lit(False)
        return F.when(t["letter"].isNotNull(), in_key).otherwise(F.exists(t["words"], holds_) | by_number)

    def has(gram: Column) -> Column:
        """Whether the gram is one of the row's `grams`."""
        return reduce(lambda a, b: a | b, [F.contains(c, gram) for c in held] + ([gram == F.concat(F.lit("^"), F.left("music_key", F.lit(1)))] if key else []))

    def meet(led: DataFrame, lots: DataFrame) -> DataFrame:
        on = ["gram", "lot", "slot"]
        # merged, so that a query is read once and runs over the pieces of its part, which are held in memory
        pairs = led.repartition(tasks, *on).hint("merge").join(lots.repartition(tasks, *on).withColumn("flat", flat), on).where(F.forall("terms", met) & ~F.exists("before", has))
        return pairs.select("askers", F.explode("keys").alias("piece_id")).select(F.explode("askers").alias("query_id"), "piece_id")

    hits = meet(led.where("NOT unlike"), lots.where("NOT several"))
    if asked.where("several").take(1) or texts.where("several").take(1):
        hits = hits.unionByName(meet(led.where("unlike"), lots).unionByName(meet(led.where("NOT unlike"), lots.where("several"))).distinct())
    return hits


def facet(pieces: DataFrame, column: str, limit: int = MAX_FACET) -> DataFrame:
    """value, n of a column: not null, not empty, of pieces not rejected; most frequent first, then by value."""
    live = pieces.where((F.coalesce(F.col("review_state"), F.lit("")) != "rejected") & F.col(column).isNotNull() & (F.col(column) != ""))
    return live.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


def all_facets(pieces: DataFrame, columns: Sequence[str], composers: DataFrame | None = None, limit: int = MAX_FACET) -> DataFrame:
    """facet, value, n for all columns from one scan; with `composers`, the period facet counted in pieces."""
    live = pieces.where(F.coalesce(F.col("review_state"), F.lit("")) != "rejected")
    if composers is not None:
        live = live.join(F.broadcast(composers.select(F.col("canonical_name").alias("composer_name"), "period")) if _small(composers) else composers.select(F.col("canonical_name").alias("composer_name"), "period"), "composer_name", "left")
        columns = [*columns, "period"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counted = live.select(pairs).select("p.facet", "p.value").where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def _small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has at most `most` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def collection_stats(pieces: DataFrame, with_files: bool = False) -> DataFrame:
    """Counts by collection, by route and by review state in one scan; kind tells which.  `with_files` adds distinct files."""
    sets = [["collection_id", "route"], ["collection_id", "review_state"], ["collection_id"]]
    kind = F.when(F.grouping("route") == 0, "route").when(F.grouping("review_state") == 0, "state").otherwise("all")
    counted = pieces.groupingSets(sets, "collection_id", "route", "review_state").agg(kind.alias("kind"), F.count("*").alias("n"))
    out = counted.select("collection_id", "kind", F.coalesce("route", "review_state").alias("value"), "n")
    if not with_files:
        return out
    distinct = pieces.select("collection_id", "file_id").distinct().groupBy("collection_id").agg(F.count("*").alias("n"))
    return out.unionByName(distinct.select("collection_id", F.lit("files").alias("kind"), F.lit(None).cast("string").alias("value"), "n"))


def curation_summary(pieces: DataFrame) -> DataFrame:
    """One row: pieces by route and state, and those outstanding (pending, on review or hold)."""
    outstanding = (F.col("review_state") == "pending") & F.col("route").isin("review", "hold")
    counts = [F.count_if(F.col("route") == r).alias(f"route_{r}") for r in ("accept", "review", "hold")] + [F.count_if(F.col("review_state") == s).alias(f"state_{s}") for s in ("pending", "accepted", "rejected")]
    return pieces.agg(*counts, F.count_if(outstanding).alias("outstanding"), F.count("*").alias("total"))


def review_queue(pieces: DataFrame, state: str = "pending", routes: Sequence[str] = ("review", "hold"), collection_id: int | None = None) -> DataFrame:
    out = pieces.where((F.col("review_state") == state) & F.col("route").isin(*routes))
    return out.where(F.col("collection_id") == collection_id) if collection_id is not None else out


def catalogue_order(*, composer: str = "composer_name", tie: str = "piece_id") -> list[Column]:
    """Composer, catalogue system, number and sub-number with nulls last, title, id: 9 comes before 10."""
    return [F.col(composer).asc_nulls_last(), F.col("catalog_system").asc_nulls_last(), F.col("catalog_number").asc_nulls_last(), F.col("catalog_sub").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col(tie).asc()]


def page(ordered: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    size = max(1, min(size, MAX_PAGE))
    return ordered.offset((max(number, 1) - 1) * size).limit(size)


def after(pieces: DataFrame, column: str, last_value, last_id, tie: str = "piece_id") -> DataFrame:
    """Keyset paging: rows after (last_value, last_id) in the order of (column, tie); no offset is read over."""
    return pieces.where((F.col(column) > last_value) | ((F.col(column) == last_value) & (F.col(tie) > last_id)))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def siblings(pieces: DataFrame, most: int = 50) -> DataFrame:
    """piece_id, sibling_id: other pieces of the same file, the first `most` by page.

    The candidates of a file are its first `most` + 1 pieces, whatever the file's size; they travel to its pieces as one list, and each
    piece cuts its own out of it, so pairs are neither shuffled nor sorted.  Only pieces that lie in several files are ranked over all of
    them.  Rows that repeat a piece of a file count once, with their first page.
    """
    own = pieces.groupBy("file_id", "piece_id").agg(F.min("page_start").alias("page_start"))
    first = top_per_group(own, ["file_id"], [F.col("page_start"), F.col("piece_id")], most + 1)
    lists = first.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_start", F.col("piece_id").alias("sibling_id")))).alias("first"))
    others = F.slice(F.filter("first", lambda s: s["sibling_id"] != F.col("piece_id")), 1, most)
    files = own.select("file_id", "piece_id", F.count("*").over(Window.partitionBy("piece_id")).alias("files"))
    rows = files.join(lists, "file_id").select("piece_id", "files", F.explode(others).alias("s")).select("piece_id", "files", "s.page_start", "s.sibling_id")
    several = top_per_group(rows.where("files > 1"), ["piece_id"], [F.col("page_start"), F.col("sibling_id")], most)
    return rows.where("files = 1").select("piece_id", "sibling_id").unionByName(several.select("piece_id", "sibling_id"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)", 1)


def contents_lookup(pieces: DataFrame, contents: DataFrame) -> DataFrame:
    """Pieces with the contents row of their catalogue number; a list of one system answers for that system alone."""
    c = contents.select(F.col("collection_id").alias("c_collection"), F.col("system").alias("c_system"), F.col("number").alias("c_number"), F.col("title").alias("toc_title"), F.col("pages").alias("toc_pages"))
    on = (F.col("collection_id") == F.col("c_collection")) & (F.col("catalog_number") == F.col("c_number")) & (F.col("c_system").isNull() | (F.col("c_system") == F.col("catalog_system")))
    return pieces.join(c, on, "left").drop("c_collection", "c_system", "c_number")


def resolve_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """`names` (name) with canonical: by the folded whole, `Last, First` turned round, or the last word; else the name tidied.

    aliases: (alias, canonical), alias folded and unique.
    """
    from evidentia.functions.folding import fold_name

    a = lambda n: aliases.select(F.col("alias").alias(f"k{n}"), F.col("canonical").alias(f"c{n}"))
    turned = F.when(F.contains("name", F.lit(",")), fold_name(F.concat(F.expr("substring(name, instr(name, ',') + 1)"), F.lit(" "), F.substring_index("name", ",", 1))))
    keyed = names.withColumns({"k1": fold_name(F.col("name")), "k2": turned})
    keyed = keyed.withColumn("k3", F.try_element_at(F.split("k1", " "), F.lit(-1)))
    joined = keyed.join(a(1), "k1", "left").join(a(2), "k2", "left").join(a(3), "k3", "left")
    tidied = F.trim(F.regexp_replace("name", r"\s+", " "))
    return joined.withColumn("canonical", F.coalesce("c1", "c2", "c3", tidied)).withColumn("known", F.coalesce("c1", "c2", "c3").isNotNull()).drop("k1", "k2", "k3", "c1", "c2", "c3")
