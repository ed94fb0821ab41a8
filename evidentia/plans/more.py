"""Further queries beside their SQL: lists, orders, counts, curation, corrections, linking, checks and labels.

The same stand-ins as in `queries`; `url` of a page plays a file's path, `orders` the pieces of a `customer`'s file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import folding, music
from evidentia.operators import candidates as adapters
from evidentia.operators import catalog, corrections, curation, integrity, linking, resolve
from evidentia.plans.queries import CAT, EV, candidate_table, catalogue, composers, events, read, registered, view
from evidentia.plans.queries import EVENTS as EVENTS_SQL
from evidentia.sources import files
from evidentia.sources.scratch import stored
from evidentia.streaming import feeds

# --- lists, orders, joins

WORKS = "SELECT c_custkey AS work_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS looked_up_at, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS first_id, CASE WHEN c_custkey % 6 = 1 THEN c_nationkey END AS second_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS catalog_number FROM customer"


def works(spark, d):
    return view(spark, d, WORKS, "customer")


@registered("b12_work_list", f"WITH w AS ({WORKS}) SELECT work_id FROM w WHERE looked_up_at IS NULL ORDER BY name LIMIT 40")
def work_list(spark, d):
    return curation.work_list(works(spark, d), "looked_up_at", "first_id", limit=40).select("work_id")


@registered("b12_retry_list", f"WITH w AS ({WORKS}) SELECT work_id FROM w WHERE looked_up_at IS NULL OR first_id IS NULL")
def retry_list(spark, d):
    return curation.work_list(works(spark, d), "looked_up_at", "first_id", retry=True).select("work_id")


@registered("b14_composer_list", CAT + "SELECT canonical_name FROM comp WHERE period = 'ASIA' AND contains(lower(canonical_name), 'brand#1')")
def composer_list(spark, d):
    c = composers(spark, d).withColumn("sort_name", F.col("canonical_name"))
    return curation.composer_list(c, "ASIA", "BRAND#1").select("canonical_name")


@registered("b9_synonyms", "SELECT event_id FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'valse' WHEN 1 THEN 'waltz' WHEN 2 THEN 'walzer' ELSE event_type END AS title FROM events) WHERE title IN ('valse', 'waltz', 'walzer')")
def synonyms(spark, d):
    e = view(spark, d, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'valse' WHEN 1 THEN 'waltz' WHEN 2 THEN 'walzer' ELSE event_type END AS title FROM events", "events")
    return e.where(catalog.search_predicate("Waltz", ("title",))).select("event_id")


@registered("b16_telling_notes", "SELECT o_orderkey, array_to_string(list_filter([o_orderpriority, o_orderstatus], lambda x: x NOT IN ('F', '5-LOW')), ',') AS notes FROM orders")
def telling_notes(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.array_join(curation.telling_notes(F.array("o_orderpriority", "o_orderstatus"), ["F", "5-LOW"]), ",").alias("notes"))


@registered("f2_title_order", CAT + "SELECT piece_id, title FROM cat ORDER BY title, piece_id LIMIT 60")
def title_order(spark, d):
    return catalogue(spark, d).orderBy(*curation.order("title")).limit(60).select("piece_id", "title")


@registered("f2_least_certain", "SELECT l_orderkey * 10 + l_linenumber AS piece_id, l_discount AS confidence FROM lineitem ORDER BY l_discount, 1 LIMIT 60")
def least_certain(spark, d):
    p = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("piece_id"), F.col("l_discount").alias("confidence"))
    return p.orderBy(*curation.order("uncertain")).limit(60)


@registered("f2_most_recent", "SELECT o_orderkey AS piece_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60")
def most_recent(spark, d):
    p = read(spark, d, "orders").select(F.col("o_orderkey").alias("piece_id"), F.col("o_orderdate").alias("updated_at"))
    return p.orderBy(*curation.order("recent")).limit(60).select("piece_id")


@registered("f4_folder_order", "SELECT page_id AS piece_id FROM pages ORDER BY url, length(html), page_id LIMIT 60")
def folder_order(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("piece_id"), F.col("url").alias("rel_path"), F.length("html").alias("page_start"))
    return p.orderBy(*curation.order("folder")).limit(60).select("piece_id")


@registered("f5_composer_order", CAT + "SELECT canonical_name, row_number() OVER (ORDER BY reverse(canonical_name), canonical_name) AS place FROM comp ORDER BY 2 LIMIT 30")
def composer_order(spark, d):
    c = curation.composer_list(composers(spark, d).withColumn("sort_name", F.reverse("canonical_name"))).limit(30)
    return c.select("canonical_name", F.expr("row_number() OVER (ORDER BY sort_name, canonical_name)").cast("long").alias("place"))


@registered("f6_movement_order", "SELECT o_orderkey AS piece_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END NULLS LAST, o_orderkey) AS place FROM orders")
def movement_order(spark, d):
    from pyspark.sql import Window

    p = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("piece_id"), F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END").alias("movement"))
    return p.select("piece_id", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*curation.order("movement"))).cast("long").alias("place"))


@registered("f7_natural_key", CAT + "SELECT catalog_system AS system, max(catalog_number) AS number FROM cat GROUP BY 1")
def natural_key(spark, d):
    top = catalogue(spark, d).groupBy("catalog_system").agg(F.max(curation.natural_key()).alias("k"))
    return top.select(F.col("catalog_system").alias("system"), "k.number")


@registered("c2_with_authorities", CAT + "SELECT piece_id, period, c_name AS work FROM cat LEFT JOIN comp ON canonical_name = composer_name LEFT JOIN customer ON c_custkey = piece_id * 3")
def with_authorities(spark, d):
    p = catalogue(spark, d).withColumn("work_id", F.col("piece_id") * 3)
    w = read(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), F.col("c_name").alias("work"))
    return curation.with_authorities(p, composers(spark, d), w).select("piece_id", "period", "work")


PATHS = "SELECT page_id AS piece_id, page_id // 2 AS file_id, url AS rel_path, CASE WHEN page_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS review_state FROM pages"


def path_pieces(spark, d):
    return view(spark, d, PATHS.replace("//", "div"), "pages")


@registered("c11_folder_siblings", f"WITH p AS (SELECT *, regexp_extract(rel_path, '^(.*/)', 1) AS k FROM ({PATHS})) SELECT a.piece_id, b.piece_id AS sibling_id FROM p a JOIN p b ON a.k = b.k AND a.piece_id <> b.piece_id AND b.review_state = 'pending'")
def folder_siblings(spark, d):
    return curation.folder_siblings(path_pieces(spark, d))


@registered("c7_tombstones", "SELECT o_custkey AS file_id, o_orderkey AS page_start FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0")
def tombstones(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page_start"))
    return corrections.drop_removed(o, o.where("page_start % 5 = 0"), o.where("page_start % 10 = 0"))


@registered("c12_contents_lookup", CAT + "SELECT piece_id, n_name AS toc_title FROM cat LEFT JOIN nation ON n_nationkey = catalog_number AND collection_id < 20 AND n_regionkey = collection_id % 5 AND (n_nationkey % 2 = 0 OR catalog_system = 'Op')")
def contents_lookup(spark, d):
    n = read(spark, d, "nation")
    c = catalogue(spark, d).select("collection_id").distinct().where("collection_id < 20")
    c = c.join(n, F.col("n_regionkey") == F.col("collection_id") % 5).select("collection_id", F.expr("CASE WHEN n_nationkey % 2 = 1 THEN 'Op' END").alias("system"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"), F.lit(1).alias("pages"))
    return catalog.contents_lookup(catalogue(spark, d), c).select("piece_id", "toc_title")


@registered("c15_decided_fields", "SELECT p_partkey AS piece_id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS value, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.7 END AS confidence FROM part")
def decided_fields(spark, d):
    p = read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("piece_id"), F.lit("title").alias("field"), F.col("p_name").alias("value"), F.lit("a").alias("source"), F.lit(0.7).alias("weight"), F.lit(0).cast("long").alias("seq"))
    chosen = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("piece_id"), F.lit("title").alias("field"), F.col("p_type").alias("value"))
    return resolve.with_decisions(resolve.resolve_fields(rows, merge=False), chosen).select("piece_id", "value", "confidence")


# --- counts


@registered("d8_work_counts", f"WITH w AS ({WORKS}) SELECT count(*) AS total, count(catalog_number) AS with_catalogue, count(looked_up_at) AS looked_up, count(first_id) AS linked_first, count(second_id) AS linked_second FROM w")
def work_counts(spark, d):
    return curation.work_counts(works(spark, d))


@registered("d9_composer_counts", "SELECT count(*) AS total, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS enriched, count(CASE WHEN s_nationkey > 12 THEN 1 END) AS with_portrait FROM supplier")
def composer_counts(spark, d):
    return curation.composer_counts(view(spark, d, "SELECT CASE WHEN s_acctbal > 0 THEN s_acctbal END AS enriched_at, CASE WHEN s_nationkey > 12 THEN s_name END AS portrait FROM supplier", "supplier"))


@registered(
    "d6_scan_by_route",
    "WITH p AS (SELECT *, length(html) = 0 AS bad, starts_with(url, 'http://') AS plain, CASE WHEN length(html) % 3 = 0 THEN 'accept' WHEN length(html) % 3 = 1 THEN 'review' ELSE 'hold' END AS route FROM pages) SELECT count(*) AS seen, count(*) FILTER (plain AND NOT bad) AS skipped, count(*) FILTER (bad) AS unreadable, count(*) FILTER (NOT plain AND NOT bad) AS catalogued, count(*) AS pieces, count(*) FILTER (route = 'accept') AS route_accept, count(*) FILTER (route = 'review') AS route_review, count(*) FILTER (route = 'hold') AS route_hold FROM p",
)
def scan_by_route(spark, d):
    p = read(spark, d, "pages").select(F.col("url").alias("rel_path"), F.expr("CASE WHEN length(html) = 0 THEN 'empty' END").alias("error"), F.array(F.expr("CASE WHEN length(html) % 3 = 0 THEN 'accept' WHEN length(html) % 3 = 1 THEN 'review' ELSE 'hold' END")).alias("pieces"))
    return curation.scan_counts(files.marked_ignored(p, {"http://*": "plain address"}))


@registered("d17_filing_counts", CAT + "SELECT count(*) AS planned, count(*) FILTER (file_id % 3 = 1) AS copy, count(*) FILTER (file_id % 3 = 2) AS refile, 0 AS unchanged, count(*) FILTER (file_id % 3 = 0) AS unreviewed, coalesce(sum(file_id) FILTER (file_id % 3 = 1), 0)::BIGINT AS bytes FROM (SELECT DISTINCT file_id FROM cat)")
def filing_counts(spark, d):
    return curation.filing_counts(linking.filing_plan(*filed(spark, d)))


def filed(spark, d):
    """Files (with a size that is their number, one in three reviewed and not yet copied) and their pieces."""
    pieces = catalogue(spark, d).withColumn("edition", F.lit(None).cast("string"))
    f = pieces.select("file_id").distinct().select("file_id", F.concat(F.lit("in/"), F.col("file_id").cast("string"), F.lit(".pdf")).alias("rel_path"), F.lit("all").alias("collection"), F.when(F.col("file_id") % 3 != 1, "old/place.pdf").alias("managed_path"), (F.col("file_id") % 3 != 0).alias("reviewed"), F.col("file_id").alias("size"))
    return f, pieces


@registered(
    "l11_target_paths",
    CAT + "SELECT file_id, CASE WHEN count(*) > 1 THEN 'Books/all/in/' || file_id || '.pdf' ELSE any_value(composer_name) || '/' || any_value(title) || coalesce(' (' || any_value(catalog_display) || ')', '') || '/' || file_id || '.pdf' END AS target FROM cat GROUP BY file_id",
)
def target_paths(spark, d):
    return linking.target_paths(*filed(spark, d))


# --- labels


@registered("h20_lifespans", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'b. ' || (1600 + p_size) WHEN p_partkey % 3 = 1 THEN 'd. ' || (1700 + p_size) ELSE (1600 + p_size) || '–' || (1700 + p_size) END AS span FROM part")
def lifespans(spark, d):
    born, died = F.when(F.col("p_partkey") % 3 != 1, 1600 + F.col("p_size")), F.when(F.col("p_partkey") % 3 != 0, 1700 + F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", music.lifespan(born, died).alias("span"))


@registered("h20_catalog_labels", "SELECT p_partkey, 'K. ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' no. 2' ELSE '' END AS label FROM part")
def catalog_labels(spark, d):
    c = F.struct(F.lit("K").alias("system"), F.col("p_size").alias("number"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("").alias("suffix"), F.when(F.col("p_partkey") % 3 == 0, 2).alias("sub"))
    return read(spark, d, "part").select("p_partkey", music.catalog_label(c).alias("label"))


@registered("h23_title_terms", r"SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 3), ',') AS terms FROM part")
def title_terms(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(music.title_terms(F.col("p_name")), ",").alias("terms"))


@registered("h24_surnames", "SELECT p_partkey, list_last(string_split(p_name, ' ')) AS surname FROM part")
def surnames(spark, d):
    return read(spark, d, "part").select("p_partkey", music.surname(F.col("p_name")).alias("surname"))


@registered("h24_credited", "SELECT n_regionkey AS region, array_to_string(list_sort(list(n_name))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' and others' ELSE '' END AS credits FROM nation GROUP BY 1")
def credited(spark, d):
    return read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names")).select("region", music.credited(F.col("names")).alias("credits"))


@registered("h26_tags", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, split_part(p_name, ' ', 1)])), ',') AS tags, greatest(1, least(10, p_size - 15)) AS difficulty FROM part")
def tags(spark, d):
    made = music.clean_tags(F.array(F.concat(F.lit(" "), "p_type"), "p_brand", F.lit(" "), F.substring_index("p_name", " ", 1), "p_brand"))
    return read(spark, d, "part").select("p_partkey", F.array_join(made, ",").alias("tags"), music.clamp(F.col("p_size") - 15, 1, 10).cast("int").alias("difficulty"))


@registered("h18_iso_years", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def iso_years(spark, d):
    return read(spark, d, "orders").select("o_orderkey", music.iso_year(F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"))).cast("long").alias("year"))


@registered("h11_page_ranges", "SELECT l_orderkey, l_linenumber, CASE WHEN q = p THEN 'whole-file' WHEN s = 1 AND q <= p THEN '' ELSE 'printed-range-mismatch' END AS note FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, 1 + l_suppkey % 3 AS s, 1 + l_partkey % 50 AS p FROM lineitem)")
def page_ranges(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    start, count = (1 + F.col("l_suppkey") % 3).cast("int"), (1 + F.col("l_partkey") % 50).cast("int")
    return l.select("l_orderkey", "l_linenumber", music.reconcile_pages(start, start + F.col("l_quantity").cast("int") - 1, count)["note"].alias("note"))


@registered("h12_sheet_names", "SELECT p_partkey, upper(p_brand[1]) || p_brand[2:] AS artist, upper(p_type[1]) || lower(p_type[2:]) AS title, p_size % 9 + 1 AS version FROM part")
def sheet_names(spark, d):
    stem = F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" - "), "p_brand", F.lit(" - "), F.lower("p_type"), F.lit(" (v"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(")"))
    return read(spark, d, "part").select("p_partkey", adapters.sheet_name(stem).alias("s")).select("p_partkey", "s.artist", "s.title", "s.version")


# --- candidates and corrections


@registered(
    "i8_inheritance",
    "WITH c AS (SELECT p_partkey AS piece_id, p_partkey % 40 AS file_id, p_type AS value, 0.3 + p_size / 100.0 AS weight FROM part), k AS (SELECT * FROM c WHERE piece_id % 3 = 0), s AS (SELECT file_id, value, max(weight) AS weight FROM k GROUP BY ALL) SELECT c.piece_id, s.value, round(s.weight, 4) AS weight FROM c JOIN s USING (file_id) WHERE c.piece_id % 3 <> 0",
)
def inheritance(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("piece_id"), (F.col("p_partkey") % 40).alias("file_id"), F.lit("form").alias("field"), F.col("p_type").alias("value"), (0.3 + F.col("p_size") / 100.0).alias("weight"))
    return corrections.inherit(p.where("piece_id % 3 = 0").drop("file_id"), p.select("piece_id", "file_id")).select("piece_id", "value", F.round("weight", 4).alias("weight"))


@registered("j8_reviewed_routes", CAT + "SELECT piece_id, CASE review_state WHEN 'accepted' THEN 'accept' WHEN 'rejected' THEN 'hold' ELSE route END AS route FROM cat")
def reviewed_routes(spark, d):
    return catalogue(spark, d).select("piece_id", resolve.reviewed_route(F.col("route"), F.col("review_state")).alias("route"))


STATES = "SELECT DISTINCT user_id % 500 AS piece_id, CASE WHEN user_id % 500 % 4 = 0 THEN 'accepted' ELSE 'pending' END AS review_state FROM events"


def event_pieces(spark, d):
    return view(spark, d, STATES, "events").withColumns({"ingest_notes": F.array().cast("array<string>"), "auto_accept": F.lit(0.8), "review_floor": F.lit(0.5)})


@registered("j9_recompute", EV + f"SELECT s.piece_id, dec.value AS title, CASE WHEN review_state = 'accepted' THEN 'accept' WHEN dec.value IS NOT NULL THEN 'accept' ELSE 'hold' END AS route FROM ({STATES}) s LEFT JOIN dec ON dec.piece_id = s.piece_id WHERE dec.value IS NOT NULL OR s.piece_id NOT IN (SELECT piece_id FROM up)")
def recomputed(spark, d):
    """Pieces with a decision, or without any candidate, after their columns are derived anew; a title alone is required."""
    # written once: all that follows would else read the events anew
    table = stored(corrections.apply_decisions(candidate_table(spark, d), events(spark, d, "decide").select("piece_id", "field", "value", "source", "seq")), "candidates")
    composer = table.where("accepted").select("piece_id", F.lit("composer").alias("field"), F.lit("x").alias("value"), "source", F.lit(1.0).alias("weight"), "seq", "note", "adapter", "accepted")
    got = resolve.recompute(table.unionByName(composer), event_pieces(spark, d))
    silent = event_pieces(spark, d).join(table.select("piece_id"), "piece_id", "left_anti").select("piece_id")
    told = table.where("accepted").select("piece_id").distinct()
    return got.join(told.unionByName(silent), "piece_id", "left_semi").select("piece_id", "title", "route")


@registered("j10_candidate_report", EV + ", bad AS (SELECT * FROM e WHERE kind = 'propose' AND NOT (weight * 1.3 > 0 AND weight * 1.3 <= 1)) SELECT piece_id, seq, 'weight outside (0, 1]' AS reason FROM bad")
def candidate_report(spark, d):
    rows = events(spark, d, "propose").select("piece_id", "field", "value", "source", (F.col("weight") * 1.3).alias("weight"), "seq", F.lit(None).cast("string").alias("note"), F.lit("c").alias("adapter"), F.lit(False).alias("accepted"))
    _, bad = curation.candidate_report(rows, event_pieces(spark, d))
    return bad.select("piece_id", "seq", "reason")


@registered("j11_queue_items", EV + f", n AS (SELECT piece_id, count(*) AS candidates, count(*) FILTER (value <> '7') AS rivals, arg_max(value, (weight, -value::BIGINT)) AS heaviest FROM up GROUP BY 1) SELECT s.piece_id, coalesce(candidates, 0) AS candidates, coalesce(rivals, 0) AS rivals, CASE WHEN n.piece_id IS NULL THEN 'composer,title' ELSE 'composer' END AS missing FROM ({STATES}) s LEFT JOIN n USING (piece_id)")
def queue_items(spark, d):
    p = event_pieces(spark, d).select("piece_id", F.col("piece_id").alias("file_id"), F.create_map(F.lit("title"), F.lit("7")).alias("shown"))
    f = p.select("file_id").distinct().withColumn("page_count", F.lit(1))
    got = curation.queue_items(p, candidate_table(spark, d), f)
    return got.select("piece_id", F.size("candidates").cast("long").alias("candidates"), F.size("rivals").cast("long").alias("rivals"), F.array_join("missing", ",").alias("missing"))


@registered("k3_proposals", EV + ", bad AS (SELECT piece_id, seq, CASE WHEN weight > 0.8 THEN 'unknown field' ELSE 'unknown piece' END AS reason FROM e WHERE kind = 'propose' AND (weight > 0.8 OR piece_id % 9 = 0)) SELECT piece_id, seq, reason FROM bad")
def proposals(spark, d):
    new = events(spark, d, "propose").select("piece_id", F.when(F.col("weight") > 0.8, "mood").otherwise("title").alias("field"), "value", "source", "weight", "seq", F.lit(None).cast("string").alias("note"), F.lit("c").alias("adapter"), F.lit(False).alias("accepted"))
    _, bad = curation.propose(new.limit(0), new, event_pieces(spark, d).where("piece_id % 9 <> 0"))
    return bad.select("piece_id", "seq", "reason")


FOLDER = f"p AS (SELECT *, regexp_extract(rel_path, '^(.*/)', 1) AS k FROM ({PATHS}))"


@registered(
    "k7_decide_folder",
    f"WITH {FOLDER}, dec AS (SELECT piece_id, k, piece_id AS seq FROM p WHERE piece_id % 10 = 0), r AS (SELECT piece_id, seq FROM dec UNION ALL SELECT p.piece_id, dec.seq FROM p JOIN dec ON p.k = dec.k AND p.piece_id <> dec.piece_id WHERE p.review_state = 'pending') SELECT piece_id, 'v' || max(seq) AS value FROM r GROUP BY 1",
)
def decide_folder(spark, d):
    p = path_pieces(spark, d)
    dec = p.where("piece_id % 10 = 0").select("piece_id", F.lit("title").alias("field"), F.concat(F.lit("v"), F.col("piece_id").cast("string")).alias("value"), F.lit("user").alias("source"), F.col("piece_id").alias("seq"))
    return curation.decide_folder(p, dec).select("piece_id", "value")


VERDICTS = "SELECT p_partkey % 50 AS piece_id, CASE WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS state, p_brand AS reviewer, p_partkey AS seq FROM part WHERE p_partkey % 3 = 0"


@registered(
    "k8_approve",
    CAT + f", v AS (SELECT piece_id, arg_max(state, seq) AS state, arg_max(reviewer, seq) AS reviewer FROM ({VERDICTS}) GROUP BY 1) SELECT c.piece_id, coalesce(v.state, review_state) AS review_state, v.reviewer, CASE coalesce(v.state, review_state) WHEN 'accepted' THEN 'accept' WHEN 'rejected' THEN 'hold' ELSE route END AS route FROM cat c LEFT JOIN v ON v.piece_id = c.piece_id",
)
def approve(spark, d):
    return curation.approve(catalogue(spark, d), view(spark, d, VERDICTS, "part").withColumn("at", F.col("seq"))).select("piece_id", "review_state", "reviewer", "route")


@registered(
    "k9_collection_upsert",
    "SELECT c_name AS source_path, CASE WHEN c_custkey % 2 = 0 THEN 'generic' ELSE 'paths' END AS adapter, CASE WHEN c_custkey % 6 = 0 THEN 0.9 WHEN c_custkey % 5 <> 0 THEN 0.7 ELSE 0.8 END AS auto_accept, CASE WHEN c_custkey % 5 <> 0 THEN 0.4 ELSE 0.5 END AS review_floor FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0",
)
def collection_upsert(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("source_path"), F.lit("paths").alias("adapter"), F.lit(0.7).alias("auto_accept"), F.lit(0.4).alias("review_floor"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("source_path"), F.lit("generic").alias("adapter"), F.expr("CASE WHEN c_custkey % 6 = 0 THEN 0.9D END").alias("auto_accept"), F.lit(None).cast("double").alias("review_floor"))
    return curation.upsert_collections(old, new)


@registered("k10_piece_upsert", "SELECT o_custkey AS file_id, o_orderkey AS page_start, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 <> 0 THEN 2 ELSE 1 END AS page_end FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 <> 0")
def piece_upsert(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page_start"))
    old = o.where("page_start % 2 = 0").withColumns({"page_end": F.lit(1), "pages_confirmed": F.col("page_start") % 3 == 0})
    return corrections.upsert_pieces(old, o.where("page_start % 5 <> 0").withColumn("page_end", F.lit(2))).select("file_id", "page_start", "page_end")


@registered("k11_resplit", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN k % 2 = 1 THEN 'created' WHEN k % 3 = 0 AND k % 4 = 0 THEN 'kept' WHEN k % 3 = 0 THEN 'removed' WHEN k % 10 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0)) GROUP BY 1")
def resplit(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page_start"))
    old = o.where("page_start % 2 = 0").withColumns({"page_end": F.lit(1), "held": F.col("page_start") % 4 == 0})
    cut = o.where("page_start % 3 <> 0").withColumn("page_end", F.when(F.col("page_start") % 10 == 0, 2).otherwise(1))
    return corrections.resplit(old, cut).groupBy("status").agg(F.count("*").alias("n"))


@registered("k12_delete", "SELECT 'left' AS part, o_orderkey AS page_start FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'stone', o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 50 = 1")
def delete(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("piece_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page_start"), F.col("o_orderkey").alias("page_end"))
    left, stones = curation.delete_pieces(o, o.where("piece_id % 7 = 0"), o.where("piece_id % 50 = 1"))
    return left.select(F.lit("left").alias("part"), "page_start").unionByName(stones.select(F.lit("stone").alias("part"), "page_start"))


@registered("k14_layers", "SELECT file_id, user_id, page, seq FROM (SELECT user_id % 20 AS file_id, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS user_id, event_id % 4 AS page, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id % 20, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END, event_id % 4 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def layers(spark, d):
    e = view(spark, d, "SELECT user_id % 20 AS file_id, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS user_id, event_id % 4 AS page, event_id AS seq, CASE WHEN event_type <> 'error' THEN array(event_type) ELSE array() END AS strokes FROM events", "events")
    return corrections.replace_layers(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")).select("file_id", "user_id", "page", "seq")


@registered("k15_file_pages", "SELECT c.conv_id AS file_id, c.turn + 10 * c.conv_id - 1 AS page, md5(text) AS strokes FROM conversations c WHERE c.conv_id % 3 <> 0")
def file_pages(spark, d):
    c = read(spark, d, "conversations")
    pieces = c.select("conv_id").distinct().where("conv_id % 3 <> 0").select(F.col("conv_id").alias("piece_id"), F.col("conv_id").alias("file_id"), (F.col("conv_id") * 10).alias("page_start"))
    return curation.to_file_pages(c.select(F.col("conv_id").alias("piece_id"), F.col("turn").alias("page"), F.md5("text").alias("strokes")), pieces).select("file_id", "page", "strokes")


@registered("k16_attribution", CAT + "SELECT piece_id, CASE WHEN piece_id % 2 = 0 THEN 'subject' WHEN piece_id % 5 = 0 THEN NULL ELSE 'a' || collection_id END AS adapter FROM cat")
def attribution(spark, d):
    p = catalogue(spark, d)
    cands = p.select("piece_id", F.expr("CASE WHEN piece_id % 2 = 0 THEN 'subject' END").alias("adapter"), (F.col("piece_id") % 5 == 0).alias("accepted"))
    f = p.select(F.col("piece_id").alias("file_id"), "collection_id")
    c = p.select("collection_id").distinct().withColumn("adapter", F.concat(F.lit("a"), F.col("collection_id").cast("string")))
    return curation.attribute_adapters(cands, p.withColumn("file_id", F.col("piece_id")), f, c).select("piece_id", "adapter")


@registered("k17_fill_from_work", CAT + "SELECT piece_id, 'title' AS field, c_name AS value FROM cat JOIN customer ON c_custkey = piece_id WHERE c_name <> title UNION ALL SELECT piece_id, 'form', c_mktsegment FROM cat JOIN customer ON c_custkey = piece_id WHERE c_mktsegment <> form")
def fill_from_work(spark, d):
    w = read(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), F.lit(None).cast("string").alias("external_title"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("music_key"), F.col("c_mktsegment").alias("form"))
    return curation.fill_from_work(catalogue(spark, d).withColumn("work_id", F.col("piece_id")), w, 1).select("piece_id", "field", "value")


# --- linking, checks, streams


@registered("l1_composer_sync", "SELECT n_name AS canonical_name, array_to_string(list_sort(list(DISTINCT '.' || n_name)), ',') AS aliases FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY 1")
def composer_sync(spark, d):
    n = read(spark, d, "nation")
    pieces = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("."), "n_name").alias("composer_name"))
    aliases = n.select(folding.fold_name(F.col("n_name")).alias("alias"), F.col("n_name").alias("canonical"))
    seed = n.select(F.col("n_name").alias("canonical"), F.lit(None).cast("int").alias("born"), F.lit(None).cast("int").alias("died"))
    got = linking.composer_sync(pieces, aliases, n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("canonical_name")), seed)
    return got.select("canonical_name", F.array_join("aliases", ",").alias("aliases"))


@registered("l3_skip_reasons", "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'rejected' WHEN p_partkey % 11 = 0 THEN 'no composer' WHEN p_partkey % 5 = 0 AND p_partkey % 13 = 0 THEN 'no title' END AS reason, count(*) AS n FROM part GROUP BY 1")
def skip_reasons(spark, d):
    p = catalogue(spark, d).withColumn("composer_name", F.when(F.col("piece_id") % 11 != 0, F.col("composer_name"))).withColumn("title", F.when(F.col("piece_id") % 13 == 0, "--").otherwise(F.col("title")))
    return linking.link_works(p)[1].groupBy("reason").agg(F.count("*").alias("n"))


@registered("l7_fill_gaps", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE s_acctbal END AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def fill_gaps(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return linking.fill_gaps(c, s, "c_custkey", ["balance"])


@registered("l8_duplicate_authorities", "WITH c AS (SELECT c_name, 'NATION_' || (c_nationkey % 5) AS title FROM customer UNION ALL SELECT n_name, n_name FROM nation WHERE n_nationkey < 3), s AS (SELECT title, min(c_name) AS least, bool_or(c_name = title) AS own FROM c GROUP BY 1) SELECT c_name AS old, CASE WHEN own THEN s.title ELSE least END AS new FROM c JOIN s USING (title) WHERE c_name <> CASE WHEN own THEN s.title ELSE least END")
def duplicate_authorities(spark, d):
    c = read(spark, d, "customer").select(F.col("c_name").alias("canonical_name"), F.concat(F.lit("http://x/NATION_"), (F.col("c_nationkey") % 5).cast("string")).alias("url"))
    n = read(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_name").alias("canonical_name"), F.concat(F.lit("http://x/"), "n_name").alias("url"))
    fixed = c.unionByName(n).withColumn("url", F.replace("url", F.lit("NATION_"), F.lit("NATION%"))).withColumn("canonical_name", F.replace("canonical_name", F.lit("NATION_"), F.lit("NATION%")))
    got = linking.duplicate_authorities(fixed)
    back = lambda c: F.replace(c, F.lit("NATION%"), F.lit("NATION_")).alias(c)
    return got.select(back("old"), back("new"))


@registered("l9_part_parents", "SELECT l_orderkey AS entry_id, min(l_suppkey) AS parent_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1")
def part_parents(spark, d):
    r = view(spark, d, "SELECT l_orderkey AS entry_id, CASE l_returnflag WHEN 'R' THEN 'parts' ELSE 'other' END AS kind, CASE l_linestatus WHEN 'F' THEN 'backward' ELSE 'forward' END AS direction, l_suppkey AS other_id FROM lineitem", "lineitem")
    return linking.part_parents(r)


@registered("l10_backfill", "SELECT c_custkey AS work_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE s_name END AS external_title, s_nationkey AS year FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def backfill(spark, d):
    w = read(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), F.col("c_custkey").alias("external_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("external_title"), F.lit(None).cast("long").alias("year"))
    dump = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entry_id"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("long").alias("year"))
    return curation.backfill_by_id(w, dump).select("work_id", "external_title", "year")


@registered("l13_same_content", "SELECT a.doc_id, min(b.doc_id) AS first FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.n_chars = b.n_chars GROUP BY 1")
def same_content(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("hash"))
    first = t.groupBy("size", "hash").agg(F.min("doc_id").alias("first"))
    both = t.join(first.withColumnRenamed("size", "f_size").withColumnRenamed("hash", "f_hash"), F.col("hash") == F.col("f_hash"))
    return both.where(linking.same_content(F.col("size"), F.col("hash"), F.col("f_size"), F.col("f_hash"))).select("doc_id", "first")


@registered("l14_source_paths", "SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'm' || c_custkey WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS path FROM customer")
def source_paths(spark, d):
    f = read(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('m', c_custkey) END").alias("managed_path"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_path"))
    copies = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("path")).distinct()
    originals = f.where("file_id % 3 = 0").select(F.col("source_path").alias("path"))
    return curation.source_paths(f, copies.unionByName(originals))


@registered("m1_missing_copies", "SELECT CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_copies(spark, d):
    f = read(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('m', c_custkey) END").alias("managed_path"))
    there = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("path"))
    return integrity.missing_copies(f, there).select("subject")


@registered("m3_unreadable", "SELECT CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def unreadable(spark, d):
    f = read(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("managed_path"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_path"))
    there = f.where("file_id % 5 = 0").select(F.col("managed_path").alias("path")).unionByName(f.where("file_id % 3 = 0").select(F.col("source_path").alias("path")))
    return integrity.unreadable(f, there, read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"))).select("subject")


@registered("m7_hidden_decisions", EV + "SELECT CAST(piece_id AS VARCHAR) AS subject FROM dec WHERE piece_id % 4 = 0 OR value <> '3'")
def hidden_decisions(spark, d):
    last = corrections.apply_decisions(candidate_table(spark, d), events(spark, d, "decide").select("piece_id", "field", "value", "source", "seq")).where("accepted").select("piece_id", "field", "value")
    shown = last.where("piece_id % 4 <> 0").select("piece_id", "field", F.lit("3").alias("value"))
    return integrity.hidden_decisions(shown, last).select("subject")


@registered("n2_curation_events", EV + ", left_ AS (SELECT piece_id, source, value FROM up WHERE NOT EXISTS (SELECT 1 FROM e WHERE kind = 'retract' AND e.piece_id = up.piece_id AND e.source = up.source AND e.value = up.value)) SELECT piece_id, source, value, false AS accepted FROM left_ WHERE (piece_id, source, value) NOT IN (SELECT piece_id, source, value FROM dec) UNION ALL SELECT piece_id, source, value, true FROM dec")
def curation_events(spark, d):
    """One micro-batch of proposals, decisions and retractions on an empty table."""
    e = view(spark, d, EVENTS_SQL, "events").withColumns({"weight": F.col("weight").cast("double"), "note": F.lit(None).cast("string")})
    return feeds.apply_events(candidate_table(spark, d).limit(0), e).select("piece_id", "source", "value", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@registered("n3_queue_depth", CAT + "SELECT route, review_state, count(*) AS depth FROM cat GROUP BY ALL")
def queue_depth(spark, d):
    return feeds.queue_depth(catalogue(spark, d).withColumn("delta", F.lit(1)))


@registered("a8_nested_export", CAT + "SELECT file_id, count(*) AS pieces, count(*) * 2 AS fields FROM cat GROUP BY 1")
def nested_export(spark, d):
    p = catalogue(spark, d).withColumn("page_end", F.col("page_start"))
    f = p.select("piece_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.lit(False).alias("conflict")) for n, c in (("title", "title"), ("composer", "composer_name"))])).alias("f")).select("piece_id", "f.*")
    got = files.nested_export(p, f)
    return got.select("file_id", F.size("pieces").cast("long").alias("pieces"), F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + F.size(x["fields"])).alias("fields"))


@registered("g1_candidate_union", "SELECT piece_id, source, max(weight) AS weight FROM (SELECT p_partkey AS piece_id, 'a' AS source, 0.5 AS weight FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END, 0.6 FROM part) GROUP BY ALL")
def candidate_union(spark, d):
    row = lambda s, w, q: read(spark, d, "part").select(F.col("p_partkey").alias("piece_id"), F.lit("title").alias("field"), s.alias("source"), F.col("p_name").alias("value"), F.lit(w).alias("weight"), F.lit(None).cast("string").alias("note"), F.lit("x").alias("adapter"), F.lit(q).cast("long").alias("seq"), F.lit(False).alias("accepted"))
    return corrections.upsert_candidates(row(F.lit("a"), 0.5, 1), row(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), 0.6, 2)).select("piece_id", "source", "weight")


@registered("g5_missing_fields", CAT + "SELECT piece_id, CASE WHEN piece_id % 2 = 0 THEN 'title' ELSE 'composer' END AS missing FROM cat")
def missing_fields(spark, d):
    rows = catalogue(spark, d).select("piece_id", F.expr("CASE WHEN piece_id % 2 = 0 THEN 'composer' ELSE 'title' END").alias("field"), F.col("title").alias("value"), F.lit("a").alias("source"), F.lit(0.5).alias("weight"), F.lit(0).cast("long").alias("seq"))
    return resolve.resolve_pieces(rows, merge=False).select("piece_id", F.array_join("missing", ",").alias("missing"))


@registered("d4_collection_files", CAT + "SELECT collection_id, count(DISTINCT file_id) AS n FROM cat GROUP BY 1")
def collection_files(spark, d):
    return catalog.collection_stats(catalogue(spark, d), with_files=True).where("kind = 'files'").select("collection_id", "n")


@registered("h15_built_titles", "SELECT p_partkey, p_type || CASE WHEN p_partkey % 3 = 0 THEN ', Op. ' || p_size WHEN p_partkey % 3 = 1 THEN ', Op. ' || (p_partkey % 7) || ' no. ' || p_size ELSE '' END AS title FROM part")
def built_titles(spark, d):
    number, group = F.when(F.col("p_partkey") % 3 != 2, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 1, F.col("p_partkey") % 7)
    return read(spark, d, "part").select("p_partkey", adapters.built_title(F.col("p_type"), group, number, F.col("p_brand")).alias("title"))


@registered("i6_collection_defaults", "SELECT c_custkey AS collection_id, n_name AS default_composer, CASE WHEN c_custkey % 3 = 0 THEN 'piano four hands' WHEN c_custkey % 3 = 1 THEN 'solo piano' ELSE 'organ' END AS default_instrumentation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def collection_defaults(spark, d):
    n = read(spark, d, "nation")
    kind = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Piano Duets' WHEN 1 THEN 'Works for Piano' ELSE 'Organ' END")
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("collection_id"), F.concat("n_name", F.lit(" - "), kind).alias("name"))
    return adapters.collection_defaults(c, n.select(folding.fold_name(F.col("n_name")).alias("alias"), F.col("n_name").alias("canonical"))).select("collection_id", "default_composer", "default_instrumentation")
