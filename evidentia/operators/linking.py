"""Entity resolution: names to authority records, pieces to works, works to external entries, files to paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.folding import fold_name, fold_title
from evidentia.functions.music import citations, is_movement, period_of, safe_component, surname
from evidentia.operators.catalog import resolve_alias
from evidentia.sources.scratch import stored

SIMILAR = 72.0


def composer_sync(pieces: DataFrame, aliases: DataFrame, existing: DataFrame, seed: DataFrame) -> DataFrame:
    """New authority rows (canonical_name, aliases, born, died, period) for names that pieces have and `existing` lacks.

    aliases: the spellings met other than the canonical one, sorted.  seed: canonical, born, died.
    """
    names = pieces.select(F.trim("composer_name").alias("name")).where("name <> ''").distinct()
    resolved = resolve_alias(names, aliases)
    grouped = resolved.groupBy(F.col("canonical").alias("canonical_name")).agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"))
    new = grouped.join(existing.select("canonical_name"), "canonical_name", "left_anti")
    dated = new.join(seed.select(F.col("canonical").alias("canonical_name"), "born", "died"), "canonical_name", "left")
    return dated.withColumn("period", period_of(F.col("born"), F.col("died")))


def link_works(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, links): pieces of one composer and catalogue number, or without one of one folded title, are one work.

    The first piece by id names the work; key, form and period come from the first piece that has them.  links:
    piece_id, work_key, method (catalogue or title), reason where a piece can't be linked.
    """
    who = F.col("composer_name")
    by_number = F.col("catalog_system").isNotNull() & F.col("catalog_number").isNotNull()
    folded = fold_title(F.col("title"))
    reason = F.when(F.col("review_state") == "rejected", "rejected").when(who.isNull() | (who == ""), "no composer").when(~by_number & (folded == ""), "no title")
    number = F.concat_ws("|", "catalog_system", F.col("catalog_number").cast("string"), F.coalesce("catalog_suffix", F.lit("")), F.coalesce(F.col("catalog_sub").cast("string"), F.lit("")))
    keyed = pieces.withColumn("reason", reason).withColumn("method", F.when(F.col("reason").isNull(), F.when(by_number, "catalogue").otherwise("title")))
    keyed = keyed.withColumn("work_key", F.when(F.col("method") == "catalogue", F.concat(who, F.lit("|c|"), number)).when(F.col("method") == "title", F.concat(who, F.lit("|t|"), folded)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("piece_id"))).alias(c)
    works = keyed.where("work_key IS NOT NULL").groupBy("work_key").agg(first("composer_name"), first("title"), first("music_key"), first("form"), F.min("piece_id").alias("first_piece"), F.count("*").alias("copies"))
    return works, keyed.select("piece_id", "work_key", "method", "reason")


def cited(works: DataFrame, external: DataFrame) -> DataFrame:
    """work_id, entry_id of the external title that cites a work's exact number and names its composer.

    works: work_id, composer_name, system, number, suffix.  external: entry_id, title, credits, place.  Citations
    are taken out of the titles first and the words of title and credits beside them, so the match is an equi join on
    (system, number, suffix, last word of the composer's name), never a scan of titles for each work, nor of all works
    that share a number.  A work without a composer is met by every entry of its number.  Entries that aren't movements come first, then those of a better place.

    The order of entries does not depend on the work, so the best entry of each key is picked before works are joined: many works
    and many entries of one key are never paired.
    """
    named = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "credits")), r"[\s(),;:/\[\]]+"))
    found = external.select("entry_id", "title", "place", F.explode(citations(F.col("title"))).alias("c"), named.alias("named"))
    found = found.select("entry_id", "title", "place", F.col("c.system").alias("system"), F.col("c.number").alias("number"), F.col("c.suffix").alias("suffix"), F.explode(F.array_append("named", F.lit(""))).alias("last"))
    wanted = works.select("work_id", F.lower(surname(F.col("composer_name"))).alias("last"), F.lower("system").alias("system"), "number", F.lower(F.coalesce("suffix", F.lit(""))).alias("suffix"))
    key = ["system", "number", "suffix", "last"]
    order = F.struct(is_movement(F.col("title")).cast("int"), F.col("place").isNull(), F.col("place"), F.col("entry_id"), F.col("title"))
    best = found.groupBy(*key).agg(F.min_by(F.struct("entry_id", "title"), order).alias("best"), F.min(order).alias("order"))
    # a work that stands there several times takes the best of what all its rows cite
    met = wanted.distinct().join(best, key).groupBy("work_id").agg(F.min_by("best", "order").alias("best"))
    return met.select("work_id", "best.entry_id", "best.title")


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: how alike two texts are, by the insertions and deletions between them; Spark counts substitutions as one change."""

    def ratio(x: str, y: str) -> float:
        row = np.arange(len(y) + 1)
        columns, other = np.arange(len(y) + 1), np.array([ord(c) for c in y])
        for i, c in enumerate(x, 1):
            # from above a deletion, from the corner a match; insertions run along the row: the least of (value - place) so far
            new = row + 1
            new[1:] = np.minimum(new[1:], np.where(other == ord(c), row[:-1], i + len(y) + 1))
            row = np.minimum.accumulate(new - columns) + columns
        return 100.0 * (1 - row[-1] / max(len(x) + len(y), 1))

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def _words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\W+"), lambda w: w != "")))


#: Names and entities of a block that meet in one task, about.
BLOCK_LOT = 20_000


def match_entities(names: DataFrame, entities: DataFrame, allowed: list[str]) -> DataFrame:
    """name, entity_id, label: the first entity by place (then id) that is of an allowed kind and whose label is similar to the name.

    Similar is a token-set ratio of 72 or more: names whose words are all in the other's are alike; else the shared words, and they
    with the rest of either side, are compared by insertions and deletions.  Pairs come from blocks: the first and the last three letters of each word, so a
    changed letter at one end of a word leaves the other.  Names without any three-letter end in common aren't compared.  Most pairs are decided by
    columns: containment, lengths, and Spark's edit distance, which is never more than that of insertions and deletions, rule out
    what cannot reach 72; only the rest go to Python.  A block of very many entities is parted.  Null and wordless names match nothing.
    """
    ends = lambda w: F.array_distinct(F.flatten(F.transform(w, lambda x: F.array(F.concat(F.lit("<"), F.left(x, F.lit(3))), F.concat(F.lit(">"), F.right(x, F.lit(3)))))))
    n = names.select("name").where("name IS NOT NULL").distinct().withColumn("p", _words(F.col("name")))
    e = entities.where(F.arrays_overlap("kinds", F.array(*map(F.lit, allowed)))).select("entity_id", "label", "place", _words(F.col("label")).alias("q"))
    blocked = e.select("entity_id", F.explode(ends("q")).alias("block"))
    parts = F.ceil(F.col("n") / F.lit(BLOCK_LOT))
    sizes = blocked.groupBy("block").agg(F.count("*").alias("n"))
    asked = n.select("name", F.explode(ends("p")).alias("block")).join(sizes, "block").select("name", "block", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("lot"))
    lots = blocked.join(sizes, "block").select("entity_id", "block", F.pmod(F.xxhash64("entity_id"), parts).alias("lot"))
    pairs = asked.join(lots, ["block", "lot"]).select("name", "entity_id").distinct()
    text = lambda *w: F.trim(F.concat_ws(" ", *[F.array_join(x, " ") for x in w]))
    both, only_p, only_q = F.array_intersect("p", "q"), F.array_except("p", "q"), F.array_except("q", "p")
    met = pairs.join(n, "name").join(e, "entity_id").withColumns({"both": text(both), "left": text(both, only_p), "right": text(both, only_q), "shared": F.size(both), "apart": F.least(F.size(only_p), F.size(only_q))})
    size, left, right = F.length("both"), F.length("left"), F.length("right")
    # the shared words open either side: what is between them is known without a distance
    opens = F.when(F.col("shared") > 0, 200.0 * size / (size + F.least(left, right))).otherwise(0.0)
    most = 100.0 * (1 - F.greatest(F.abs(left - right), F.levenshtein("left", "right")) / (left + right))
    sure = ((F.col("shared") > 0) & (F.col("apart") == 0)) | (opens >= SIMILAR)
    decided = met.where(sure).select("name", "entity_id", "label", "place")
    near = met.where(~sure & (most >= SIMILAR)).where(edit_ratio("left", "right") >= SIMILAR).select("name", "entity_id", "label", "place")
    best = Window.partitionBy("name").orderBy("place", "entity_id")
    return decided.unionByName(near).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("name", "entity_id", "label")


def fill_gaps(rows: DataFrame, facts: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Known values stay, gaps are filled from `facts` (one row a key); `force` lets facts win."""
    f = facts.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    order = (lambda c: F.coalesce(f"__{c}", c)) if force else (lambda c: F.coalesce(c, f"__{c}"))
    return rows.join(f, key, "left").withColumns({c: order(c) for c in columns}).drop(*[f"__{c}" for c in columns])


def duplicate_authorities(composers: DataFrame) -> DataFrame:
    """old -> new of composers that share an article url: the one named as the article survives, else the least name."""
    title = F.regexp_replace(F.regexp_replace("url", r"^.*/", ""), "_", " ")
    best = Window.partitionBy("url").orderBy((F.col("canonical_name") == title).desc(), "canonical_name")
    ranked = composers.where("url IS NOT NULL").withColumn("new", F.first("canonical_name").over(best))
    return ranked.where("canonical_name <> new").select(F.col("canonical_name").alias("old"), "new")


def part_parents(relations: DataFrame) -> DataFrame:
    """entry_id, parent_id through backward 'parts' relations (entry_id, kind, direction, other_id)."""
    return relations.where("kind = 'parts' AND direction = 'backward'").groupBy("entry_id").agg(F.min("other_id").alias("parent_id"))


def part_chains(parents: DataFrame) -> DataFrame:
    """entry_id, root_id, depth, cycle of every part (entry_id, parent_id): the entry at the top of its chain and the steps to it.

    Pointer jumping: in each turn every part takes the pointer of the part it points to, so chains of 2 ** n steps take n turns.  Parts in a cycle, or
    below one, have neither root nor depth and are marked.  An entry of several parents follows the least; null ids have no place in a chain.
    """
    state = parents.where("entry_id IS NOT NULL AND parent_id IS NOT NULL").groupBy("entry_id").agg(F.min("parent_id").alias("root_id")).withColumns({"depth": F.lit(1).cast("long"), "open": F.lit(True)})
    state = stored(state, "chains")
    before, left = None, state.count()
    while left and left != before:
        above = state.select(F.col("entry_id").alias("root_id"), F.col("root_id").alias("next"), F.col("depth").alias("more"), F.col("open").alias("next_open"))
        both = state.where("open").join(above, "root_id", "left")
        # a pointer to what is no part has arrived; one to a finished part arrives with it
        moved = both.select("entry_id", F.coalesce("next", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("next_open", F.lit(False)).alias("open"))
        state = stored(state.where("NOT open").unionByName(moved), "chains")
        # outside cycles the open part nearest to its root points to what is closed, and closes: a turn that closes none has cycles left alone
        before, left = left, state.where("open").count()
    return state.select("entry_id", F.when(~F.col("open"), F.col("root_id")).alias("root_id"), F.when(~F.col("open"), F.col("depth")).alias("depth"), F.col("open").alias("cycle"))


def enrich(works: DataFrame, pieces: DataFrame, services: dict[str, DataFrame], force: bool = False) -> DataFrame:
    """`works` after one pass over external catalogues, with `message`: what was found, what not, or why a work was left alone.

    works: work_id, composer_name, system, number, suffix, year, looked_up, confirmed, match_note, and for each service <name>_id and <name>_title.  services:
    name -> entries (entry_id, title, credits, place, year), matched as by `cited`.  Only works with an accepted copy are looked up: a link makes a guess a
    citation.  Works looked up before or confirmed by hand are left alone, and known values stay, unless `force`.  The year is that of the first service that
    has one.
    """
    accepted = pieces.where("review_state = 'accepted' OR route = 'accept'").select("work_id").distinct().withColumn("settled", F.lit(True))
    out = works.join(accepted, "work_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    skip = F.when(true("looked_up") & F.lit(not force), "already looked up").when(true("confirmed") & F.lit(not force), "confirmed by hand").when(F.coalesce("composer_name", F.lit("")) == "", "no composer").when(~true("settled"), "no accepted copy yet")
    out = out.withColumn("skip", skip)
    todo = out.where("skip IS NULL").select("work_id", "composer_name", "system", "number", "suffix")
    for name, entries in services.items():
        hits = cited(todo, entries).join(entries.select("entry_id", "year"), "entry_id")
        out = out.join(hits.select("work_id", F.col("entry_id").alias(f"new_{name}_id"), F.col("title").alias(f"new_{name}_title"), F.col("year").alias(f"new_{name}_year")), "work_id", "left")
    pick = (lambda new, old: F.coalesce(new, old)) if force else (lambda new, old: F.coalesce(old, new))
    found = {name: F.col(f"new_{name}_id").isNotNull() for name in services}
    year = F.coalesce(*[F.col(f"new_{name}_year") for name in services])
    gained = {name: found[name] & (F.lit(force) | F.col(f"{name}_id").isNull()) for name in services} | {"year": year.isNotNull() & (F.lit(force) | F.col("year").isNull())}
    missed = F.array_join(F.array_compact(F.array(*[F.when(~found[name], F.lit(f"not in {name}")) for name in services])), "; ")
    note = F.when(missed != "", missed).otherwise(F.concat(F.lit("matched on "), "system", F.lit(". "), F.col("number").cast("string")))
    changed = F.array_join(F.array_compact(F.array(*[F.when(g, F.lit(name)) for name, g in gained.items()])), ", ")
    fresh = F.col("skip").isNull()
    columns = {c: F.col(c) for c in works.columns}
    for name in services:
        # id and title of a service come from one entry
        for part in ("id", "title"):
            columns[f"{name}_{part}"] = F.when(gained[name], F.col(f"new_{name}_{part}")).otherwise(F.col(f"{name}_{part}"))
    columns |= {"year": pick(year, F.col("year")), "match_note": F.when(fresh, note).otherwise(F.col("match_note")), "looked_up": F.when(fresh, True).otherwise(F.col("looked_up"))}
    return out.select(*[c.alias(name) for name, c in columns.items()], F.when(~fresh, F.col("skip")).when(changed != "", changed).otherwise(note).alias("message"))


def target_paths(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """file_id, target of every file (file_id, rel_path, collection): books keep their path, unnamed ones are parked."""
    many = pieces.groupBy("file_id").agg(F.count("*").alias("n"), F.min_by(F.struct("composer_name", "title", "catalog_display", "edition"), "piece_id").alias("p"))
    f = files.join(many, "file_id", "left")
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    folder = F.concat(F.col("p.title"), F.coalesce(F.concat(F.lit(" ("), F.col("p.catalog_display"), F.lit(")")), F.lit("")))
    shelf = safe_component(F.col("collection"))
    filed = F.concat_ws("/", safe_component(F.col("p.composer_name"), "Unfiled"), safe_component(folder, "Untitled"), F.concat(safe_component(F.coalesce("p.edition", stem), "score"), F.when(suffix == "", ".pdf").otherwise(suffix)))
    target = F.when(F.col("n") > 1, F.concat_ws("/", F.lit("Books"), shelf, "rel_path")).when(F.col("p.title").isNull() | (F.col("p.title") == ""), F.concat_ws("/", F.lit("Unfiled"), shelf, name)).otherwise(filed)
    return f.select("file_id", target.alias("target"))


def unique_names(rows: DataFrame, column: str = "target", by: str = "file_id") -> DataFrame:
    """Colliding paths get ' (2)', ' (3)' and so on before their suffix, in the order of `by`."""
    nth = F.row_number().over(Window.partitionBy(column).orderBy(by))
    numbered = rows.withColumn("nth", nth)
    renamed = F.when(F.col("nth") == 1, F.col(column)).otherwise(F.concat(F.regexp_replace(column, r"\.[^./]*$", ""), F.lit(" ("), F.col("nth").cast("string"), F.lit(")"), F.regexp_extract(column, r"(\.[^./]*)$", 1)))
    return numbered.withColumn(column, renamed).drop("nth")


def filing_plan(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """file_id, target, size, action of every file (with managed_path and reviewed): a plan, nothing is moved.

    claimed: another file's copy is at the target already, so this one's copy will need a name of its own beside it.
    """
    planned = unique_names(target_paths(files, pieces))
    held = files.where("managed_path IS NOT NULL").groupBy(F.col("managed_path").alias("target")).agg(F.min("file_id").alias("holder"), F.max("file_id").alias("other"))
    both = files.select("file_id", "managed_path", "reviewed", "size").join(planned, "file_id").join(held, "target", "left")
    claimed = F.coalesce((F.col("holder") != F.col("file_id")) | (F.col("other") != F.col("file_id")), F.lit(False))
    action = F.when(~F.col("reviewed"), "unreviewed").when(F.col("managed_path").isNull() & claimed, "claimed").when(F.col("managed_path").isNull(), "copy").when(F.col("managed_path") == F.col("target"), "unchanged").otherwise("refile")
    return both.select("file_id", "target", "size", action.alias("action"))


def same_content(a_size: Column, a_hash: Column, b_size: Column, b_hash: Column) -> Column:
    """Equal size and hash; the size alone where a hash is missing."""
    return (a_size == b_size) & F.coalesce(a_hash == b_hash, F.lit(True))
