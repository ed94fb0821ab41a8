"""Queries of whole jobs beside their SQL: coded paths and the scan of several collections.

`part` plays the files: its keys, brands, names and sizes make their paths and subject lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import music
from evidentia.functions.folding import fold_name
from evidentia.operators import corrections, integrity, ledger, linking, paths, resolve
from evidentia.operators.candidates import Sides, generic_adapter, stem, tidy
from evidentia.operators.scan import scan
from evidentia.plans.queries import EV, EVENTS, read, registered, view
from evidentia.schema import SIGNALS
from evidentia.sources import files as sources

# --- coded paths

CODES = """SELECT 'composer' AS kind, lower(p_brand) AS code, p_brand AS value FROM part UNION ALL SELECT * FROM (VALUES
  ('form', 'etudes', 'Etude'), ('form', 'con_amin', 'Concerto'), ('form', 'kreis', 'Kreisleriana'), ('work', 'con_amin', 'Concerto in A minor'), ('work', 'kreis', ''), ('instrument', 'organ', 'organ'),
  ('prefix', 'et', 'Etude'), ('prefix', 'etud', 'Etude'), ('prefix', 'pre', 'Prelude'), ('prefix', 'prefug', 'Prelude and Fugue'), ('prefix', 'sn', 'Sonata'), ('tag', 'lz_', ''), ('tag', 'lz', ''),
  ('work_stem', 'prchofg', 'Prelude, Choral and Fugue')) AS t(kind, code, value)"""
CODED = """SELECT p_partkey, concat(lower(p_brand), '/', CASE p_partkey % 6 WHEN 0 THEN 'etudes/' WHEN 1 THEN 'con_amin/' WHEN 2 THEN concat('Opus', CAST(p_size AS VARCHAR(9)), '/') WHEN 3 THEN 'kreis/' WHEN 4 THEN 'organ/' ELSE '' END,
  CASE p_partkey % 7 WHEN 0 THEN concat('et', CAST(p_size AS VARCHAR(9)), '_', CAST(p_partkey % 9 AS VARCHAR(9))) WHEN 1 THEN concat('lz_pre', CAST(p_size AS VARCHAR(9))) WHEN 2 THEN concat('PreFug', CAST(p_size AS VARCHAR(9))) WHEN 3 THEN split_part(p_name, ' ', 1)
    WHEN 4 THEN concat('lzsn', CAST(p_size AS VARCHAR(9)), '_2') WHEN 5 THEN concat('prchofg', CAST(p_partkey % 9 AS VARCHAR(9))) ELSE concat('x', CAST(p_size AS VARCHAR(9)), 'a') END, '.pdf') AS rel_path FROM part"""
CODED_SQL = f"""codes AS ({CODES}), f AS (SELECT p_partkey, rel_path, split_part(rel_path, '/', 1) AS top, CASE WHEN len(string_split(rel_path, '/')) > 2 THEN lower(split_part(rel_path, '/', 2)) ELSE '' END AS inner_, regexp_extract(rel_path, '([^/]+)[.]pdf$', 1) AS stem FROM ({CODED})),
texts AS (SELECT p_partkey, -length(code) AS turn, ltrim(substr(lower(stem), length(code) + 1), '_-') AS text FROM f JOIN codes ON kind = 'tag' AND starts_with(lower(stem), code) AND length(stem) > length(code) UNION ALL SELECT p_partkey, 1, lower(stem) FROM f),
sf AS (SELECT p_partkey, value AS stem_form FROM texts JOIN codes ON kind = 'prefix' AND starts_with(text, code) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY turn, length(code) DESC) = 1),
r AS (SELECT f.*, co.value AS composer, ff.value AS folder_form, stem_form, i.value AS scoring, coalesce(ff.value, stem_form) AS form, coalesce(nullif(w.value, ''), CASE WHEN w.value = '' THEN coalesce(ff.value, stem_form) END, ws.value) AS one_work,
  regexp_extract(stem, '([0-9]+)_([0-9]+)', 1) AS a, regexp_extract(stem, '([0-9]+)_([0-9]+)', 2) AS b, regexp_extract(regexp_replace(stem, '^[A-Za-z]+', ''), '([0-9]+)[^0-9]*$', 1) AS lone, regexp_extract(inner_, '^opus([0-9]+)$', 1) AS opus, regexp_extract(stem, '([0-9]+)$', 1) AS last
  FROM f LEFT JOIN sf USING (p_partkey) LEFT JOIN (SELECT DISTINCT * FROM codes WHERE kind = 'composer') co ON co.code = top LEFT JOIN codes ff ON ff.kind = 'form' AND ff.code = inner_ LEFT JOIN codes i ON i.kind = 'instrument' AND i.code = inner_
  LEFT JOIN codes w ON w.kind = 'work' AND w.code = inner_ LEFT JOIN codes ws ON ws.kind = 'work_stem' AND starts_with(stem, ws.code)),
n AS (SELECT *, CASE WHEN one_work IS NULL THEN coalesce(nullif(a, ''), nullif(opus, '')) END AS g, CASE WHEN one_work IS NULL THEN coalesce(nullif(b, ''), nullif(lone, '')) END AS nr FROM r),
t AS (SELECT *, CASE WHEN one_work IS NULL THEN form || CASE WHEN g IS NOT NULL AND nr IS NOT NULL THEN ', Op. ' || g || ' no. ' || nr WHEN nr IS NULL THEN '' WHEN form = 'Prelude and Fugue' THEN ', no. ' || nr ELSE ', Op. ' || nr END END AS pattern FROM n),
said AS (SELECT p_partkey, unnest([{{'field': 'composer', 'value': composer, 'source': 'folder_composer', 'weight': 0.7}}, {{'field': 'form', 'value': folder_form, 'source': 'folder_form', 'weight': 0.7}}, {{'field': 'form', 'value': stem_form, 'source': 'filename_form', 'weight': 0.62}},
  {{'field': 'title', 'value': one_work, 'source': 'single_work_folder', 'weight': 0.8}}, {{'field': 'movement', 'value': CASE WHEN one_work IS NOT NULL THEN nullif(last, '') END, 'source': 'filename_movement', 'weight': 0.72}},
  {{'field': 'title', 'value': pattern, 'source': 'path_pattern', 'weight': CASE WHEN folder_form = stem_form THEN 0.72 ELSE 0.62 END}},
  {{'field': 'title', 'value': CASE WHEN one_work IS NULL AND pattern IS NULL AND regexp_matches(stem, '^[a-z]{{4,}}$') THEN upper(stem[1]) || stem[2:] END, 'source': 'filename_name', 'weight': 0.55}},
  {{'field': 'catalog', 'value': 'Op. ' || g || coalesce(' no. ' || nr, ''), 'source': 'path_pattern', 'weight': 0.6}}, {{'field': 'instrumentation', 'value': scoring, 'source': 'folder_instrument', 'weight': 0.68}}], recursive := true) FROM t)"""


def coded_signals(spark, d):
    """Signals of the coded paths: nothing but a path and a page count."""
    rows = view(spark, d, CODED, "part")
    return signals_of(rows, F.lit(2), F.lit(3), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), F.lit(None))


def signals_of(rows, collection, pages, docinfo, error, outline=None):
    """Rows with a path as signals; what isn't given is null."""
    given = {} if outline is None else {"outline": outline}
    given |= {"collection_id": collection, "rel_path": F.col("rel_path"), "page_count": pages, "docinfo": docinfo, "error": error}
    columns = [c.strip().split(" ", 1) for c in _fields(SIGNALS)]
    return rows.select("p_partkey", *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns])


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL schema; commas inside angle brackets part nothing."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@registered("h14_path_codes", f"WITH {CODED_SQL} SELECT '2/' || rel_path AS file_key, field, value, source, CAST(weight AS DOUBLE) AS weight FROM said JOIN f USING (p_partkey) WHERE value IS NOT NULL")
def path_codes(spark, d):
    return paths.path_adapter(coded_signals(spark, d).drop("p_partkey"), Sides(codes=view(spark, d, CODES, "part"))).select("file_key", "field", "value", "source", "weight")


NUMBERED = "SELECT p_partkey, concat('x/', split_part(p_name, ' ', 1), CAST(p_size AS VARCHAR(9)), CASE p_partkey % 3 WHEN 0 THEN concat('_', CAST(p_partkey % 11 AS VARCHAR(9))) WHEN 1 THEN 'b' ELSE '' END, '.pdf') AS rel_path FROM part"


@registered("h14_stem_numbers", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(regexp_extract(rel_path, '([0-9]+)_', 1) AS INTEGER) END AS grp, CASE WHEN p_partkey % 3 = 0 THEN CAST(regexp_extract(rel_path, '_([0-9]+)', 1) AS INTEGER) ELSE CAST(regexp_extract(rel_path, '([0-9]+)', 1) AS INTEGER) END AS number, CAST(nullif(regexp_extract(rel_path, '([0-9]+)[.]pdf$', 1), '') AS INTEGER) AS movement FROM ({NUMBERED})")
def stem_numbers(spark, d):
    s = stem(F.col("rel_path"))
    rows = view(spark, d, NUMBERED, "part").select("p_partkey", paths.stem_numbers(s).alias("n"), paths.movement_of(s).alias("movement"))
    return rows.select("p_partkey", F.col("n.group").alias("grp"), "n.number", "movement")


# --- the scan


def shapes(spark, d):
    """(signals, collections, sides): subject lines in collection 0, lead sheets in 1, some of them title first, coded paths in 2; every fiftieth file broken."""
    part = read(spark, d, "part")
    broken = F.when(F.col("p_partkey") % 50 == 0, "no trailer")
    nothing = F.lit(None).cast("map<string,string>")
    at = lambda n: part.where(F.col("p_partkey") % 3 == n)
    subject = F.create_map(F.lit("Subject"), F.concat("p_brand", F.lit(": "), "p_name", F.lit(", Op. "), F.col("p_size").cast("string"), F.lit(", P1 of 4")))
    zero = at(0).withColumn("rel_path", F.concat(F.when(F.col("p_partkey") % 21 == 0, "drafts/").otherwise(""), F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".pdf")))
    pair = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" - ", "p_brand", "p_type")).otherwise(F.concat_ws(" - ", "p_type", "p_brand"))
    one = at(1).withColumn("rel_path", F.concat(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" - "), pair, F.lit(" v"), F.col("p_partkey").cast("string"), F.lit(".pdf")))
    two = view(spark, d, CODED, "part").where("p_partkey % 3 = 2").withColumn("rel_path", F.regexp_replace("rel_path", r"\.pdf$", ".PDF"))
    signals = signals_of(zero, F.lit(0), F.lit(4), subject, broken).unionByName(signals_of(one, F.lit(1), F.lit(2), nothing, broken)).unionByName(signals_of(two, F.lit(2), F.lit(3), nothing, broken))
    collections = spark.sql("SELECT * FROM VALUES (0L, NULL, 0.9D, NULL, NULL), (1L, NULL, NULL, 0.5D, map('form', 'Song')), (2L, 'paths', 0.7D, 0.6D, map('instrumentation', 'solo piano')) AS t(collection_id, adapter, auto_accept, review_floor, defaults)")
    aliases = part.select(F.col("p_brand").alias("canonical")).distinct().select(fold_name(F.col("canonical")).alias("alias"), "canonical")
    return signals.drop("p_partkey"), collections, Sides(codes=view(spark, d, CODES, "part"), aliases=aliases)


SCAN_SQL = f"""WITH {CODED_SQL},
p0 AS (SELECT 0 AS c, p_partkey, '0/' || CASE WHEN p_partkey % 21 = 0 THEN 'drafts/' ELSE '' END || 'f' || p_partkey || '.pdf' AS file_key, p_brand AS composer, p_name AS title, 0.85 AS conf FROM part WHERE p_partkey % 3 = 0),
p1 AS (SELECT 1 AS c, p_partkey, '1/' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' - ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - ' || p_type ELSE p_type || ' - ' || p_brand END || ' v' || p_partkey || '.pdf' AS file_key, p_brand AS composer,
  upper(p_type[1]) || lower(p_type[2:]) AS title, 0.55 AS conf FROM part WHERE p_partkey % 3 = 1),
per AS (SELECT p_partkey, max(value) FILTER (field = 'composer') AS composer, max(value) FILTER (field = 'title') AS title, min(weight) FILTER (field IN ('composer', 'title') AND value IS NOT NULL) AS w, count(DISTINCT value) FILTER (field = 'form') AS forms FROM said GROUP BY 1),
p2 AS (SELECT 2 AS c, p_partkey, '2/' || regexp_replace(rel_path, '[.]pdf$', '.PDF') AS file_key, composer, title, CASE WHEN title IS NULL THEN 0 WHEN forms > 1 THEN least(w, 0.45) ELSE w END AS conf FROM per JOIN f USING (p_partkey) WHERE p_partkey % 3 = 2),
al AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT DISTINCT file_key, composer, title, conf AS confidence, CASE WHEN conf >= CASE c WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.7 END THEN 'accept' WHEN conf >= CASE c WHEN 2 THEN 0.6 ELSE 0.5 END THEN 'review' ELSE 'hold' END AS route, NULL AS reason FROM al
WHERE p_partkey % 50 <> 0 AND NOT contains(file_key, 'drafts/') UNION ALL SELECT file_key, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 50 = 0 THEN 'unreadable: no trailer' ELSE 'a draft' END FROM al WHERE p_partkey % 50 = 0 OR contains(file_key, 'drafts/')"""


@registered("j10_scan_job", SCAN_SQL)
def scan_job(spark, d):
    """Signals of three shapes to routed pieces and problem rows, in one plan."""
    found = scan(*shapes(spark, d), ignore={"drafts/*": "a draft"})
    none = F.lit(None).cast("string")
    pieces = found.pieces.select("file_key", F.col("composer_name").alias("composer"), "title", "confidence", "route", none.alias("reason"))
    return pieces.unionByName(found.problems.select("file_key", none.alias("composer"), none.alias("title"), F.lit(None).cast("double").alias("confidence"), none.alias("route"), "reason"))


BOOKS = "SELECT conv_id, turn, trim(substring(replace(text, chr(10), ' '), 1, 30)) AS entry, max(turn) OVER (PARTITION BY conv_id) AS pages FROM conversations WHERE turn >= 1"


@registered(
    "i4_outline_pieces",
    f"WITH b AS (SELECT * FROM ({BOOKS}) WHERE length(entry) > 2), n AS (SELECT conv_id, count(*) AS n, max(pages) AS pages FROM b GROUP BY 1), cut AS (SELECT conv_id, turn AS page_start, entry FROM b JOIN n USING (conv_id) WHERE n >= 2 AND n.pages >= 4) "
    "SELECT CONCAT('1/', conv_id, '.pdf') AS file_key, CAST(page_start AS INTEGER) AS page_start, CAST(greatest(coalesce(lead(page_start) OVER (PARTITION BY conv_id ORDER BY page_start) - 1, (SELECT pages FROM n WHERE n.conv_id = cut.conv_id)), page_start) AS INTEGER) AS page_end, md5(entry) AS title FROM cut",
)
def outline_pieces(spark, d):
    """Conversations as books whose outline is the beginning of every turn: two entries and four pages or more make them several pieces."""
    turns = view(spark, d, BOOKS, "conversations")
    books = turns.groupBy("conv_id").agg(F.max("pages").cast("int").alias("page_count"), F.array_sort(F.collect_list(F.struct((F.col("turn") - 1).cast("int").alias("page_index"), F.col("entry").alias("title")))).alias("o"))
    rows = books.select(F.col("conv_id").alias("p_partkey"), F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("rel_path"), "page_count", F.transform("o", lambda x: F.struct(x["title"].alias("title"), x["page_index"].alias("page_index"), F.lit(0).alias("level"))).alias("outline"))
    signals = signals_of(rows, F.lit(1), F.col("page_count"), F.lit(None), F.lit(None), F.col("outline")).drop("p_partkey")
    return generic_adapter(signals).where("source = 'outline' AND field = 'title'").select("file_key", "page_start", "page_end", F.md5("value").alias("title"))


# --- events, chains, look-ups


@registered(
    "n2_ledger",
    EV + ", live AS (SELECT piece_id, field, source, value, max(weight) AS weight FROM e p WHERE kind = 'propose' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.kind = 'retract' AND r.piece_id = p.piece_id AND r.source = p.source AND r.value = p.value AND r.seq > p.seq) GROUP BY ALL) "
    "SELECT piece_id, field, source, value, round(weight, 4) AS weight, false AS accepted FROM live WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.piece_id = live.piece_id AND dec.source = live.source AND dec.value = live.value) UNION ALL SELECT piece_id, field, source, value, 1.0, true FROM dec",
)
def event_ledger(spark, d):
    """The events in two batches, out of order and some of them twice: the candidates are those of all events at once."""
    e = view(spark, d, EVENTS, "events").withColumns({"weight": F.col("weight").cast("double"), "note": F.lit(None).cast("string")})
    late = ledger.reduced(e.where("seq % 3 <> 0"))
    both = ledger.reduced(late.unionByName(e.where("seq % 3 = 0 OR seq % 2 = 0").select(*late.columns)))
    return ledger.candidates(both).select("piece_id", "field", "source", "value", F.round("weight", 4).alias("weight"), "accepted")


PARENTS = "SELECT p_partkey AS entry_id, CASE p_partkey % 40 WHEN 20 THEN p_partkey + 1 WHEN 21 THEN p_partkey - 1 ELSE (p_partkey - p_partkey % 2) / 2 END AS parent_id FROM part WHERE p_partkey % 13 <> 0"


@registered(
    "l9_part_chains",
    f"WITH RECURSIVE p AS (SELECT entry_id, CAST(parent_id AS BIGINT) AS parent_id FROM ({PARENTS})), c AS (SELECT entry_id, parent_id AS root_id, 1 AS depth FROM p UNION ALL SELECT c.entry_id, p.parent_id, depth + 1 FROM c JOIN p ON p.entry_id = c.root_id WHERE depth < 40) "
    "SELECT p.entry_id, r.root_id, r.depth, r.entry_id IS NULL AS cycle FROM p LEFT JOIN (SELECT * FROM c WHERE root_id NOT IN (SELECT entry_id FROM p)) r USING (entry_id)",
)
def part_chains(spark, d):
    return linking.part_chains(view(spark, d, PARENTS, "part").withColumn("parent_id", F.col("parent_id").cast("long")))


LOOKED = """SELECT p_partkey AS work_id, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS composer_name, 'Op' AS system, p_size AS number, '' AS suffix, CASE WHEN p_partkey % 3 = 0 THEN 1800 END AS year, p_partkey % 11 = 0 AS looked_up, p_partkey % 13 = 0 AS confirmed,
  CAST(NULL AS VARCHAR(9)) AS match_note, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS a_id, CASE WHEN p_partkey % 5 = 0 THEN 'known' END AS a_title, CAST(NULL AS BIGINT) AS b_id, CAST(NULL AS VARCHAR(9)) AS b_title FROM part"""
COPIES = "SELECT p_partkey AS work_id, CASE WHEN p_partkey % 2 = 0 THEN 'accepted' ELSE 'pending' END AS review_state, CASE WHEN p_partkey % 7 = 0 THEN 'accept' ELSE 'review' END AS route FROM part"
#: One entry a brand and number; the second service has every other number and no year.
ENTRIES = "SELECT min(p_partkey) AS entry_id, concat('Work, Op. ', CAST(p_size AS VARCHAR(9)), ' (', p_brand, ')') AS title, CAST(NULL AS VARCHAR(9)) AS credits, 1 AS place, 1700 + p_size AS year FROM part WHERE p_size % 4 <> 1 GROUP BY p_size, p_brand"
MORE_ENTRIES = "SELECT min(p_partkey) AS entry_id, concat('Op. ', CAST(p_size AS VARCHAR(9)), ' by ', p_brand) AS title, CAST(NULL AS VARCHAR(9)) AS credits, 1 AS place, CAST(NULL AS INTEGER) AS year FROM part WHERE p_size % 2 = 0 GROUP BY p_size, p_brand"


def looked_up_sql(force: bool) -> str:
    skip = "CASE " + ("" if force else "WHEN looked_up THEN 'already looked up' WHEN confirmed THEN 'confirmed by hand' ") + "WHEN composer_name IS NULL THEN 'no composer' WHEN work_id NOT IN (SELECT work_id FROM k WHERE review_state = 'accepted' OR route = 'accept') THEN 'no accepted copy yet' END"
    gain = lambda s: "x.entry_id IS NOT NULL" if force and s == "x" else "x.entry_id IS NOT NULL AND a_id IS NULL" if s == "x" else "y.entry_id IS NOT NULL"
    years = "coalesce(x.year, w.year)" if force else "coalesce(w.year, x.year)"
    new_year = "x.year IS NOT NULL" + ("" if force else " AND w.year IS NULL")
    return f"""WITH k AS ({COPIES}), w0 AS ({LOOKED}), w AS (SELECT *, {skip} AS skip FROM w0), x AS ({ENTRIES}), y AS ({MORE_ENTRIES}),
j AS (SELECT w.work_id, skip, w.looked_up, CASE WHEN {gain('x')} THEN x.entry_id ELSE a_id END AS a_id, CASE WHEN {gain('x')} THEN x.title ELSE a_title END AS a_title, CASE WHEN {gain('y')} THEN y.entry_id ELSE b_id END AS b_id, {years} AS year,
  concat_ws('; ', CASE WHEN x.entry_id IS NULL THEN 'not in a' END, CASE WHEN y.entry_id IS NULL THEN 'not in b' END) AS missed, concat_ws(', ', CASE WHEN {gain('x')} THEN 'a' END, CASE WHEN {gain('y')} THEN 'b' END, CASE WHEN {new_year} THEN 'year' END) AS changed, number
  FROM w LEFT JOIN x ON skip IS NULL AND x.title = concat('Work, Op. ', number, ' (', composer_name, ')') LEFT JOIN y ON skip IS NULL AND y.title = concat('Op. ', number, ' by ', composer_name))
SELECT work_id, a_id, a_title, b_id, year, looked_up OR skip IS NULL AS looked_up, CASE WHEN skip IS NOT NULL THEN skip WHEN changed <> '' THEN changed WHEN missed <> '' THEN missed ELSE concat('matched on Op. ', number) END AS message FROM j"""


def looked_up(spark, d, force):
    services = {"a": view(spark, d, ENTRIES, "part"), "b": view(spark, d, MORE_ENTRIES, "part")}
    return linking.enrich(view(spark, d, LOOKED, "part"), view(spark, d, COPIES, "part"), services, force).select("work_id", "a_id", "a_title", "b_id", "year", "looked_up", "message")


@registered("l5_enrichment", looked_up_sql(False))
def enrichment(spark, d):
    return looked_up(spark, d, False)


@registered("l5_enrichment_forced", looked_up_sql(True))
def enrichment_forced(spark, d):
    return looked_up(spark, d, True)


@registered("l6_entity_match", None)
def entity_match(spark, d):
    """Every name of a part with its second letter lost, matched to the names of parts; SQL has no such ratio, tests hold it against a plain version."""
    p = read(spark, d, "part")
    names = p.select(F.concat(F.left("p_name", F.lit(1)), F.substr("p_name", F.lit(3))).alias("name"))
    entities = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("place")).select(F.col("place").alias("entity_id"), "label", F.array(F.lit("person")).alias("kinds"), "place")
    return linking.match_entities(names, entities, ["person"])


# --- checks, shelves, filing, export

FILES = "SELECT p_partkey AS file_id, concat('p', CAST(p_partkey % 1990 AS VARCHAR(9))) AS path, CASE WHEN p_partkey % 2 = 0 THEN concat('m', CAST(p_partkey AS VARCHAR(9))) END AS managed_path, concat('s', CAST(p_partkey AS VARCHAR(9))) AS source_path, p_size AS page_count FROM part"
KEPT = "SELECT managed_path AS path FROM f WHERE managed_path IS NOT NULL AND file_id % 6 <> 0 UNION ALL SELECT source_path FROM f WHERE file_id % 9 <> 0"
CUT = "SELECT p_partkey AS piece_id, p_partkey AS file_id, (p_partkey - p_partkey % 2) / 2 AS work_id, 1 AS page_start, p_partkey % 60 AS page_end FROM part WHERE p_partkey % 8 <> 3"
SHOWN = "SELECT p_partkey AS piece_id, 'title' AS field, p_name AS value FROM part"
ACCEPTED = "SELECT p_partkey AS piece_id, 'title' AS field, CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE 'another' END AS value FROM part WHERE p_partkey % 5 = 0"


@registered(
    "m8_all_checks",
    f"""WITH f AS ({FILES}), i AS ({KEPT}), p AS ({CUT}), a AS ({ACCEPTED}), found AS (
SELECT 'library copy missing' AS "check", CAST(file_id AS VARCHAR) AS subject, managed_path AS detail FROM f WHERE managed_path NOT IN (SELECT path FROM i)
UNION ALL SELECT 'one file, several rows', path, CAST(count(*) AS VARCHAR) FROM f GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'no readable copy', CAST(file_id AS VARCHAR), source_path FROM f WHERE coalesce(managed_path, '') NOT IN (SELECT path FROM i) AND source_path NOT IN (SELECT path FROM i) AND file_id IN (SELECT file_id FROM p)
UNION ALL SELECT 'range past the end', CAST(piece_id AS VARCHAR), CAST(page_end AS VARCHAR) FROM p JOIN f USING (file_id) WHERE page_count > 0 AND page_end > page_count
UNION ALL SELECT 'work without pieces', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey NOT IN (SELECT work_id FROM p)
UNION ALL SELECT 'deleted entry is back', CAST(piece_id AS VARCHAR), '1' FROM p WHERE piece_id % 101 = 0
UNION ALL SELECT 'decision not showing', CAST(piece_id AS VARCHAR), 'title' FROM a WHERE value = 'another')
SELECT "check", CAST(nth AS INTEGER) AS nth, subject, detail FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY subject, detail) AS nth FROM found) WHERE nth <= 20
UNION ALL SELECT "check", 21, 'more', CAST(count(*) - 20 AS VARCHAR) FROM found GROUP BY 1 HAVING count(*) > 20
UNION ALL SELECT c, 0, 'checked', CAST(n AS VARCHAR) FROM (SELECT 'library copy missing' AS c, count(managed_path) AS n FROM f UNION ALL SELECT 'one file, several rows', count(*) FROM f UNION ALL SELECT 'no readable copy', count(*) FROM f UNION ALL SELECT 'range past the end', count(*) FROM p
  UNION ALL SELECT 'work without pieces', count(*) FROM part UNION ALL SELECT 'deleted entry is back', count(*) FROM p UNION ALL SELECT 'decision not showing', count(*) FROM a)""",
)
def all_checks(spark, d):
    f = view(spark, d, FILES, "part")
    kept = f.where("managed_path IS NOT NULL AND file_id % 6 <> 0").select(F.col("managed_path").alias("path")).unionAll(f.where("file_id % 9 <> 0").select("source_path"))
    p = view(spark, d, CUT, "part")
    works = read(spark, d, "part").select(F.col("p_partkey").alias("work_id"))
    removed = works.where("work_id % 101 = 0").select(F.col("work_id").alias("file_id"), F.lit(1).alias("page_start"))
    return integrity.verify(f, kept, p, works, removed, view(spark, d, SHOWN, "part"), view(spark, d, ACCEPTED, "part")).select("check", "nth", "subject", "detail")


@registered(
    "e3_append_to_shelves",
    "WITH i AS (SELECT o_custkey AS shelf_id, o_orderkey AS piece_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 2 AS position FROM orders WHERE o_orderstatus = 'F') SELECT shelf_id, piece_id, CAST(position AS INTEGER) AS position FROM i "
    "UNION ALL SELECT o_custkey, o_orderkey, CAST(coalesce((SELECT max(position) FROM i WHERE shelf_id = o_custkey), 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) FROM orders WHERE o_orderstatus <> 'F'",
)
def append_to_shelves(spark, d):
    """Shelves that hold items, with gaps, take all orders of their customer: those there already stay where they are."""
    items = view(spark, d, "SELECT o_custkey AS shelf_id, o_orderkey AS piece_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 2 AS INTEGER) AS position FROM orders WHERE o_orderstatus = 'F'", "orders")
    adds = read(spark, d, "orders").select(F.col("o_custkey").alias("shelf_id"), F.col("o_orderkey").alias("piece_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seq"))
    return corrections.append_positions(items, adds)


FILED = "SELECT p_partkey AS file_id, p_brand AS composer_name, concat(p_name, ' ', CAST(p_partkey AS VARCHAR(9))) AS title FROM part"


@registered(
    "l12_claimed_targets",
    f"WITH f AS ({FILED}), t AS (SELECT file_id, concat(composer_name, '/', title, '/score.pdf') AS target FROM f), m AS (SELECT file_id, target, CASE file_id % 4 WHEN 0 THEN target WHEN 1 THEN coalesce((SELECT o.target FROM t o WHERE o.file_id = t.file_id + 1), 'old') END AS managed FROM t) "
    "SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'unreviewed' WHEN file_id % 4 = 0 THEN 'unchanged' WHEN file_id % 4 = 1 THEN 'refile' WHEN target IN (SELECT managed FROM m WHERE managed IS NOT NULL) THEN 'claimed' ELSE 'copy' END AS action FROM m",
)
def claimed_targets(spark, d):
    """Files whose copy lies at another file's target: that one is claimed."""
    rows = view(spark, d, FILED, "part")
    pieces = rows.select("file_id", F.col("file_id").alias("piece_id"), "composer_name", "title", F.lit(None).cast("string").alias("catalog_display"), F.lit("score").alias("edition"))
    at = F.concat("composer_name", F.lit("/"), "title", F.lit("/score.pdf"))
    after = rows.select((F.col("file_id") - 1).alias("file_id"), at.alias("next"))
    f = rows.join(after, "file_id", "left").select(
        "file_id", F.concat(F.lit("in/"), F.col("file_id").cast("string"), F.lit(".pdf")).alias("rel_path"), F.lit("all").alias("collection"), (F.col("file_id") % 5 != 0).alias("reviewed"), F.lit(1).alias("size"),
        F.when(F.col("file_id") % 4 == 0, at).when(F.col("file_id") % 4 == 1, F.coalesce("next", F.lit("old"))).alias("managed_path"),
    )
    return linking.filing_plan(f, pieces).select("file_id", "action")


@registered("a8_full_export", "SELECT p_partkey AS file_id, p_partkey AS piece_id, p_name AS value, 0.45 AS confidence, true AS conflict, 'a' AS sources, p_type || ' of parts' AS alternative, 'b' AS of_source FROM part")
def full_export(spark, d):
    """Two sources that disagree about a title: the export has the value, its sources, and the other value with its own."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("piece_id"), "p_name", "p_type")
    said = F.explode(F.array(F.struct(F.col("p_name").alias("value"), F.lit("a").alias("source"), F.lit(0.7).alias("weight"), F.lit(0).cast("long").alias("seq")), F.struct(F.concat("p_type", F.lit(" of parts")).alias("value"), F.lit("b").alias("source"), F.lit(0.5).alias("weight"), F.lit(1).cast("long").alias("seq")))).alias("s")
    fields = resolve.resolve_fields(p.select("piece_id", F.lit("title").alias("field"), said).select("piece_id", "field", "s.*"))
    pieces = p.select("piece_id", F.col("piece_id").alias("file_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"))
    out = sources.nested_export(pieces, fields).select("file_id", F.inline("pieces")).select("file_id", "piece_id", F.inline("fields"))
    return out.select("file_id", "piece_id", "value", "confidence", "conflict", F.array_join("sources", ",").alias("sources"), F.col("alternatives")[0]["value"].alias("alternative"), F.array_join(F.col("alternatives")[0]["sources"], ",").alias("of_source"))


# --- texts of several spellings


@registered(
    "h25_clean_strokes",
    "SELECT l_orderkey, CAST(count(*) FILTER (l_tax * 4 - 0.05 > 0 AND l_tax * 4 - 0.05 <= 0.2) AS INTEGER) AS strokes, round(coalesce(sum(greatest(0, least(1, l_quantity / 25.0)) + greatest(0, least(1, l_discount * 20 - 0.3))) FILTER (l_tax * 4 - 0.05 > 0 AND l_tax * 4 - 0.05 <= 0.2), 0), 4) AS ink FROM lineitem GROUP BY 1",
)
def strokes(spark, d):
    """Lines of an order as strokes, some beside the page, some too wide, each with half a point too many."""
    r = read(spark, d, "lineitem")
    num = lambda c: F.col(c).cast("double")
    stroke = F.struct(F.lit("pen").alias("tool"), F.lit("red").alias("color"), (num("l_tax") * 4 - 0.05).alias("width"), F.array(F.array(num("l_quantity") / 25.0, num("l_discount") * 20 - 0.3), F.array(num("l_tax"))).alias("points"))
    clean = r.groupBy("l_orderkey").agg(corrections.clean_strokes(F.collect_list(stroke)).alias("s"))
    ink = F.aggregate(F.flatten(F.flatten(F.transform("s", lambda x: x["points"]))), F.lit(0.0), lambda a, x: a + x)
    return clean.select("l_orderkey", F.size("s").alias("strokes"), F.round(ink, 4).alias("ink"))


def spelled(name: str, cases: list[tuple[str, str | None]], make, sql_type: str = "VARCHAR") -> None:
    """Registers a query over texts made of the names of parts in several spellings; cases: (text, result) as SQL with n for the name."""
    pick = lambda i: "CASE " + " ".join(f"WHEN k % {len(cases)} = {n} THEN {c[i] if c[i] is not None else 'NULL'}" for n, c in enumerate(cases)) + " END"
    source = "SELECT p_partkey AS k, p_size AS z, split_part(p_name, ' ', 1) AS n FROM part"
    registered(name, f"SELECT k, CAST({pick(1)} AS {sql_type}) AS result FROM ({source})")(lambda spark, d: view(spark, d, f"SELECT k, {pick(0)} AS text FROM ({source})", "part").select("k", make(F.col("text")).alias("result")))


def up(word: str) -> str:
    return f"concat(upper(substring({word}, 1, 1)), lower(substring({word}, 2, 99)))"


spelled("h4_keys", [
    ("concat(n, ' in Eb major')", "'E-flat major'"), ("concat(n, ' in f-sharp Minor, no. ', CAST(z AS VARCHAR(9)))", "'F-sharp minor'"), ("concat('Trio (C# min) ', n)", "'C-sharp minor'"), ("concat(n, ' in Am')", None), ("concat('D dur: ', n)", "'D major'"),
    ("concat(n, ' in B flat maj.')", "'B-flat major'"), ("concat(n, ' in G moll')", "'G minor'"), ("concat('nothing ', n, ' here')", None), ("concat(n, ' in Bbm')", "'B-flat minor'"),
], music.key_of)
spelled("h7_stem_numbers", [
    ("concat('k', lpad(CAST(z AS VARCHAR(9)), 4, '0'))", "concat('K', ' ', z, ' stub')"), ("concat('bwv', CAST(z AS VARCHAR(9)), 'a')", "concat('BWV', ' ', z, ' stub')"), ("concat(n, '_op', CAST(z AS VARCHAR(9)))", "concat('Op', ' ', z, ' embedded')"),
    ("concat('op', CAST(z AS VARCHAR(9)), '_', n)", "concat('Op', ' ', z, ' prefix')"), ("'plain'", None),
], lambda c: music.let(music.catalog_of_stem(c), lambda k: F.when(k.isNotNull(), F.concat_ws(" ", k["system"], k["number"].cast("string"), k["kind"]))))
spelled("h10_scorings", [("concat(n, ' for piano four hands')", "'piano four hands'"), ("concat('Works for 2 Pianos: ', n)", "'two pianos'"), ("concat(n, ' for two pianos, four hands')", None), ("n", None)], lambda c: music.scoring_of_heading(c)["scoring"])
spelled("h13_tidied", [
    ("concat('_', n, '_of_the_', n)", f"concat({up('n')}, ' of the ', {up('n')})"), ("upper(concat(n, ' the ', n, n))", f"concat(CASE WHEN length(n) <= 4 THEN upper(n) ELSE {up('n')} END, ' the ', {up('concat(n, n)')})"),
    (f"concat({up('n')}, 'OfTheHeart')", f"concat({up('n')}, ' Of The Heart')"), ("concat('The ', n, ' - ')", "concat('The ', n)"),
], tidy)
spelled("h17_years", [
    ("concat('18', lpad(CAST(z AS VARCHAR(9)), 2, '0'), '-13 in {{Ref|x}}')", "1800 + z"), ("concat('ca. 1844 [[', n, ']]')", "1844"), ("concat('<!-- 1700 -->', n)", None), ("concat('before ', n, ' of 20', lpad(CAST(z AS VARCHAR(9)), 2, '0'))", "CASE WHEN z < 30 THEN 2000 + z END"),
], lambda c: music.composition_year(c)["year"], "INTEGER")
