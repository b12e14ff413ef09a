"""Names as keys: folding, slugs, token sets and ids.

Compatibility decomposition has no built-in, so `fold` is the one Arrow UDF of the library; where only ASCII and Latin text
occurs, `fold_latin` does the same inside the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from meetlens.functions.marks import col

#: Latin letters with marks and their plain forms, position by position.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


@F.pandas_udf(StringType())
def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def fold(name: str | Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _fold(col(name))


def fold_latin(name: str | Column) -> Column:
    return F.translate(col(name), MARKED, PLAIN)


def name_key(name: str | Column, folded=fold) -> Column:
    """Folded, upper case, trimmed: the key of label joins."""
    return F.trim(F.upper(folded(name)))


def field_key(name: str | Column, folded=fold) -> Column:
    """name_key with only letters A-Z and digits left."""
    return F.regexp_replace(name_key(name, folded), "[^A-Z0-9]", "")


def title_name(name: str | Column) -> Column:
    """One space between words; a capital after a space, hyphen or apostrophe, lower case else."""
    spaced = F.regexp_replace(F.trim(col(name)), r"\s+", " ")
    pieces = F.regexp_extract_all(F.lower(spaced), F.lit(r"([^ '\-]*[ '\-]?)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def match_text(text: str | Column, folded=fold) -> Column:
    """Folded lower case; hyphens, apostrophes and dots are spaces; one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded(text)), r"[-'’.]", " "), r"\s+", " "))


def token_set(name: str | Column, folded=fold) -> Column:
    """The distinct words of match_text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(match_text(name, folded), " "), lambda w: w != "")))


def tokens(name: str | Column, folded=fold) -> Column:
    return F.filter(F.split(match_text(name, folded), " "), lambda w: w != "")


def nation_keys(name: str | Column, nation: str | Column, folded=fold) -> Column:
    """(kind, key) structs with the nation: flat letters, and sorted words where there are two or more."""
    words, nat = token_set(name, folded), F.coalesce(F.upper(col(nation)), F.lit(""))
    flat = F.struct(F.lit("flat").alias("kind"), F.concat_ws("|", field_key(name, folded), nat).alias("key"))
    sorted_words = F.struct(F.lit("words").alias("kind"), F.concat_ws("|", F.array_join(words, " "), nat).alias("key"))
    return F.when(F.size(words) >= 2, F.array(flat, sorted_words)).otherwise(F.array(flat))


def slug(name: str | Column, folded=fold) -> Column:
    """Folded lower case; everything but letters and digits is a single hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(folded(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def family_words(name: str | Column) -> Column:
    """Words in capitals that are longer than one letter."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(col(name)), r"\s+"), lambda w: (w == F.upper(w)) & (F.length(w) > 1))))


def given_words(name: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(col(name)), r"\s+"), lambda w: ~((w == F.upper(w)) & (F.length(w) > 1)))))


def same_person(a: str | Column, b: str | Column) -> Column:
    """Equal family words, and the given words of one contain the other's."""
    x, y = (F.transform(given_words(n), F.lower) for n in (a, b))
    return (family_words(a) == family_words(b)) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def id_after_hyphen(text: str | Column) -> Column:
    """Digits after the last hyphen of a slug or profile address, else null."""
    return F.regexp_extract(col(text), r"-(\d+)/?$", 1).try_cast("long")


def id_in_path(url: str | Column, folder: str) -> Column:
    """The number that follows a folder in an address."""
    return F.regexp_extract(col(url), f"/{folder}/(?:[^/]*-)?(\\d+)", 1).try_cast("long")


def without_gender(event: str | Column) -> Column:
    """What follows "'s " in an event's name."""
    return F.element_at(F.split(col(event), "'s ", 2), -1)


def event_key(event: str | Column) -> Column:
    """An event's name without gender, "metres" as m, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_gender(event)), r"\s*met(re|er)s?", "m"), "[^a-z0-9]", "")


def label_matches(label: str | Column, expected: str | Column) -> Column:
    """The label contains the expected text, and what is left are numbers."""
    rest = F.split(F.trim(F.replace(F.lower(col(label)), F.lower(col(expected)), F.lit(""))), r"\s+")
    return F.contains(F.lower(col(label)), F.lower(col(expected))) & F.forall(rest, lambda w: (w == "") | w.rlike("^[0-9]+$"))


def heading_label(path: str | Column) -> Column:
    return F.array_join(col(path), " / ")
