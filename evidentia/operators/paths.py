"""Coded paths: what folders and file stems say by a table of codes.

codes: (kind, code, value), codes in lower case.  Kinds:

composer    first folder -> composer            form        second folder -> form
instrument  second folder -> scoring            work        second folder that holds one work -> its title ('' for its form's name)
prefix      beginning of a stem -> form         tag         beginning of a stem that says nothing of the form, such as initials
work_stem   beginning of a stem that names one work -> its title

Of codes that a stem begins with the longest counts.  A code that is there twice has its least value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import music
from evidentia.functions.music import Tokens, let
from evidentia.operators.candidates import WITHOUT_OPUS, Sides, adapter, built_title, emitted, file_rows, said

# What each reading of a path is worth, two forms that agree, and words of files that are no pieces.
WEIGHTS = {"folder_composer": 0.70, "folder_form": 0.70, "filename_form": 0.62, "title": 0.62, "agreed": 0.72, "single_work": 0.80, "name": 0.55, "movement": 0.72, "number": 0.60, "instrument": 0.68}
NO_TITLES = ["index", "contents", "readme", "toc", "cover", "misc", "notes"]
#: Longest code of a stem.
MAX_CODE = 64


def of_kind(codes: DataFrame, kind: str) -> DataFrame:
    """code, value of a kind, one row a code."""
    return codes.where((F.col("kind") == kind) & F.col("code").isNotNull()).groupBy("code").agg(F.min(F.coalesce("value", F.lit(""))).alias("value"))


def beginnings(rows: DataFrame, codes: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns, text, code, value of all codes that a text begins with.

    Each text is cut to its beginnings, and they meet the codes by an equi-join: codes are never scanned for each text.
    """
    cut = F.transform(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(MAX_CODE))), lambda n: F.left("text", n))
    return rows.where("text <> ''").select(*keep, "text", F.explode(cut).alias("code")).join(codes, "code")


def longest(rows: DataFrame, codes: DataFrame, key: str = "file_key") -> DataFrame:
    """key, value of the longest code that a text (key, turn, text) begins with; of several texts of a key those of the least turn come first."""
    found = beginnings(rows, codes, key, "turn")
    return found.groupBy(key).agg(F.min_by("value", F.struct("turn", -F.length("code"))).alias("value"))


def stem_forms(files: DataFrame, codes: DataFrame) -> DataFrame:
    """file_key, value: the form that a stem's beginning names, behind its longest tag that leaves a form, or else from its start."""
    bare = lambda c: F.ltrim(c, F.lit("_-"))
    stems = files.select("file_key", bare(F.lower(F.trim("stem"))).alias("text"))
    tagged = beginnings(stems, of_kind(codes, "tag"), "file_key").where(F.length("code") < F.length("text"))
    behind = tagged.select("file_key", (-F.length("code")).alias("turn"), bare(F.substr("text", F.length("code") + 1)).alias("text"))
    return longest(behind.unionByName(stems.select("file_key", F.lit(1).alias("turn"), "text")), of_kind(codes, "prefix"))


def stem_numbers(stem: Column) -> Column:
    """(group, number) of a stem: 10 and 1 of 'et10_1', nothing and 101 of 'sn101'; digits after the leading letters alone count."""

    def read(ts: Column) -> Column:
        t = Tokens(ts)
        pair = let(F.filter(t.places, lambda i: t.digits(i, 3) & (t.raw(i + 1) == "_") & t.digits(i + 2, 2)), lambda found: F.get(found, F.lit(0)))
        return let(pair, lambda at: made(t, at))

    def made(t: Tokens, at: Column) -> Column:
        led = F.rlike(t.raw(F.lit(0)), F.lit("^[A-Za-z]")).cast("int")
        runs = F.filter(F.slice(t.tokens, led + 1, 1 << 20), lambda x: F.rlike(x, F.lit("^[0-9]+$")))
        alone = F.right(F.try_element_at(runs, F.lit(-1)), F.lit(3)).cast("int")
        return F.struct(F.when(at.isNotNull(), t.raw(at).cast("int")).alias("group"), F.when(at.isNotNull(), t.raw(at + 2).cast("int")).otherwise(alone).alias("number"))

    return let(Tokens.of(F.trim(stem)), read)


def movement_of(stem: Column) -> Column:
    """The number that a stem ends with, of up to three digits; a letter behind it makes it no movement."""
    return F.right(F.nullif(F.regexp_extract(F.trim(stem), r"([0-9]+)$", 1), F.lit("")), F.lit(3)).cast("int")


def named_by(stem: Column) -> Column:
    """The title of a stem that reads as a word and not as a code, null otherwise."""
    text = F.trim(F.replace(F.trim(stem), F.lit("_"), F.lit(" ")))
    wordlike = F.rlike(F.trim(stem), F.lit("(?i)^[a-z][a-z_'-]{3,}$"))
    structural = F.exists(F.array(*map(F.lit, NO_TITLES)), lambda w: F.contains(F.lower(text), w))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    recased = F.transform(words, lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w))
    return F.when(wordlike & ~structural, F.array_join(recased, " "))


def readings(signals: DataFrame, codes: DataFrame) -> DataFrame:
    """One row a file: composer, form (of folder and stem), title and its weight, movement, number, scoring."""
    parts = F.split("rel_path", "/")
    files = file_rows(signals)
    f = files.withColumns({"top": F.lower(F.when(F.size(parts) > 1, parts[0]).otherwise("")), "inner": F.lower(F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(""))})
    for kind, key, name in (("composer", "top", "composer"), ("form", "inner", "folder_form"), ("instrument", "inner", "scoring"), ("work", "inner", "work")):
        f = f.join(of_kind(codes, kind).select(F.col("code").alias(key), F.col("value").alias(name)), key, "left")
    # stems are read from the files as given: from `f` each reading would join the codes of folders once more
    f = f.join(stem_forms(files, codes).withColumnRenamed("value", "stem_form"), "file_key", "left")
    stems = files.select("file_key", F.lit(0).alias("turn"), F.lower(F.trim("stem")).alias("text"))
    f = f.join(longest(stems, of_kind(codes, "work_stem")).withColumnRenamed("value", "work_by_stem"), "file_key", "left")
    form = F.coalesce("folder_form", "stem_form")
    f = f.withColumns({"form": form, "n": stem_numbers(F.col("stem")), "one_work": F.coalesce(F.when(F.col("work") != "", F.col("work")).when(F.col("work") == "", form), F.col("work_by_stem"))})
    # a folder named for its opus gives the opus that the stem lacks
    opus = F.nullif(F.regexp_extract("inner", r"^opus\s*([0-9]{1,3})$", 1), F.lit("")).cast("int")
    split = F.col("one_work").isNotNull()
    f = f.withColumns({"group": F.when(~split, F.coalesce("n.group", opus)), "number": F.when(~split, F.col("n.number"))})
    pattern = F.when(~split, built_title(F.col("form"), F.col("group"), F.col("number"), F.col("composer")))
    by_opus = ~F.coalesce(F.col("composer"), F.lit("")).isin(*WITHOUT_OPUS)
    number = F.when(by_opus & F.col("group").isNotNull(), F.concat(F.lit("Op. "), F.col("group").cast("string"), F.coalesce(F.concat(F.lit(" no. "), F.col("number").cast("string")), F.lit(""))))
    agreed = F.coalesce(F.col("folder_form") == F.col("stem_form"), F.lit(False))
    f = f.withColumn("pattern", pattern)
    return f.withColumns({
        "movement": F.when(split, movement_of(F.col("stem"))), "catalog": number, "weight": F.when(agreed, WEIGHTS["agreed"]).otherwise(WEIGHTS["title"]),
        "name": F.when(~split & F.col("pattern").isNull(), named_by(F.col("stem"))), "page_start": F.lit(1), "page_end": F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)),
    })


@adapter("paths")
def path_adapter(signals: DataFrame, sides: Sides) -> DataFrame:
    """Candidates of coded paths (see `readings`): folder and stem are two sources of a form, and a title counts more where they agree.

    The files of a folder that holds one work share its title, and their number is a movement, never an opus.  A title without a form is the
    stem, where it reads as a name.  Without a table of codes there is nothing to read.
    """
    f = readings(signals, sides.codes) if sides.codes is not None else readings(signals, signals.sparkSession.createDataFrame([], "kind string, code string, value string"))
    values = [
        said("composer", F.col("composer"), "folder_composer", WEIGHTS["folder_composer"]), said("form", F.col("folder_form"), "folder_form", WEIGHTS["folder_form"]),
        said("form", F.col("stem_form"), "filename_form", WEIGHTS["filename_form"]), said("title", F.col("one_work"), "single_work_folder", WEIGHTS["single_work"]),
        said("movement", F.col("movement"), "filename_movement", WEIGHTS["movement"]), said("title", F.col("pattern"), "path_pattern", F.col("weight")),
        said("title", F.col("name"), "filename_name", WEIGHTS["name"]), said("catalog", F.col("catalog"), "path_pattern", WEIGHTS["number"]),
        said("instrumentation", F.col("scoring"), "folder_instrument", WEIGHTS["instrument"]),
    ]
    return emitted(f, values, "paths")
