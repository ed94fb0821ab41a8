"""Folding values to the form in which two signals are compared."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

# Number words, accented Latin letters and what they fold to.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
}
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĪīĮįŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŲųŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgIiIiNnNnOoOoRrSsSsSsTtUuUuUuUuYZzZzZz"

#: Spaces that folding takes off: at an end or in a row.
LOOSE = r"^ | \z|  "
#: Lower case by `translate` is that of `lower` for plain letters, which takes every text through ICU.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_latin(text: Column) -> Column:
    """Accented Latin letters without their accents; combining marks dropped.  Runs in the JVM."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}+", "")


@pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, for scripts beyond Latin; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold(value: Column, unicode: bool = False) -> Column:
    """Accents off, punctuation to spaces, spaces collapsed, lower case; null gives ''.

    `unicode` folds every script through an Arrow UDF; without it Latin letters are folded in the JVM.
    """
    given = F.coalesce(value.cast("string"), F.lit(""))
    text = decomposed(given) if unicode else plain_latin(given)
    text = F.regexp_replace(text, r"(?U)[^\w\s]+", " ")
    text = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    # an Arrow UDF is run for all rows, whatever the branch
    return text if unicode else F.when(F.rlike(given, F.lit(f"[^0-9A-Za-z ]|{LOOSE}")), text).otherwise(F.translate(given, CAPITALS, CAPITALS.lower()))


@dataclass(frozen=True)
class Folds:
    """How the values of fields are folded: as titles, as keys, and all others plainly; `unicode` for scripts beyond Latin, through an Arrow UDF."""

    titles: tuple[str, ...] = ("title", "work_title")
    keys: tuple[str, ...] = ("key",)
    unicode: bool = False


FOLDS, UNICODE_FOLDS = Folds(), Folds(unicode=True)
# Short words for modes, and words that announce a number.
SHORT = {"maj": "major", "min": "minor", "mi": "minor"}
ORDINALS = ["number", "num", "nr", "no", "#"]


#: Words to what stands for them: number words, short modes, and keys in one word such as eflat.
REPLACED = {w: str(n) for w, n in NUMBER_WORDS.items()} | SHORT | {f"{c}flat": f"{c}b" for c in "abcdefg"} | {f"{c}sharp": c for c in "abcdefg"}
#: What titles and keys have to be read word by word for; words of plain letters beside these stand for themselves.
TOLD = rf"[^A-Za-z ]|{LOOSE}|(?i)(?<![a-z])(?:{'|'.join([*REPLACED, 'flat', 'sharp'])})(?![a-z])"


def _replaced() -> Column:
    return F.create_map(*[F.lit(x) for pair in REPLACED.items() for x in pair])


def folded(value: Column, title: Column, unicode: bool = False) -> Column:
    """`fold` of a title or key, and in the same pass over its words: number words to digits, modes written out, E-flat as eb; where
    `title` holds, No. 1, Nr 1 and #1 as n1.
    """
    given = F.coalesce(value.cast("string"), F.lit(""))
    text = F.lower(decomposed(given) if unicode else plain_latin(given))
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\w+|#|-|[^\w\s#-]+"), F.lit(0))
    replaced = _replaced()

    def read(ts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(ts, i), F.lit(""))
        number = lambda i: F.regexp_extract(at(i), "^[0-9]+", 0)

        def word(w: Column, i: Column) -> Column:
            after, before = at(i + 1 + (at(i + 1) == "-").cast("int")), at(i - 1 - (at(i - 1) == "-").cast("int"))
            tonic = F.rlike(w, F.lit("^[a-g]$"))
            # the number that this token announces, and what announces this token's number
            behind = i + 1 + ((at(i + 1) == ".") & (w != "#")).cast("int")
            announced = title & w.isin(*ORDINALS) & (number(behind) != "")
            mark = F.when(at(i - 1) == ".", at(i - 2)).otherwise(at(i - 1))
            told = title & (number(i) != "") & (mark.isin(*ORDINALS) & ~((mark == "#") & (at(i - 1) == ".")))
            own = number(i)
            return (
                F.when(announced | ~F.rlike(w, F.lit(r"(?U)^\w")), "")
                .when(w.isin("flat", "sharp") & F.rlike(before, F.lit("^[a-g]$")), "")
                .when(told, F.concat(F.lit("n"), own, F.lit(" "), F.substr(w, F.length(own) + 1)))
                .when(tonic & (after == "flat"), F.concat(w, F.lit("b")))
                .otherwise(F.coalesce(F.try_element_at(replaced, w), w))
            )

        return F.array_join(F.filter(F.transform(ts, word), lambda w: w != ""), " ")

    said = F.rtrim(F.replace(F.get(F.transform(F.array(tokens), read), F.lit(0)), F.lit("  "), F.lit(" ")))
    return F.when(F.rlike(given, F.lit(TOLD)), said).otherwise(F.translate(given, CAPITALS, CAPITALS.lower()))


def fold_title(value: Column, unicode: bool = False) -> Column:
    """`fold` for titles: No. 1, Nr 1 and #1 become n1, shorthand is written out."""
    return folded(value, F.lit(True), unicode)


def fold_key(value: Column, unicode: bool = False) -> Column:
    return folded(value, F.lit(False), unicode)


def fold_by_field(field: Column, value: Column, folds: Folds = FOLDS) -> Column:
    """Each value folded as its field asks for; words are looked at one by one only in titles and keys."""
    title, key = field.isin(*folds.titles), field.isin(*folds.keys)
    return F.when(title | key, folded(value, title, folds.unicode)).otherwise(fold(value, folds.unicode))


def fold_name(name: Column) -> Column:
    """For alias lookup: accents, dots, commas and apostrophes off, other punctuation but hyphens to spaces."""
    text = F.regexp_replace(plain_latin(F.coalesce(name, F.lit(""))), r"[.,'`]", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s-]", " ")
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
