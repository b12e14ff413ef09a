"""Headlines: keyword hits, attribution to the nearest name, recovery estimates and status decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meetlens.functions.marks import col
from meetlens.functions.names import fold_latin


def contains_any(text: str | Column, words: list[str]) -> Column:
    """Any of the words as a substring."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(col(text), w)) if words else F.lit(False)


def whole_word_hits(text: str | Column, words: list[str]) -> Column:
    """The words that occur as whole words, in the order given."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.regexp_like(col(text), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))


def position(text: str | Column, word: str | Column) -> Column:
    """Where a word first occurs, counted from 1; null if it does not."""
    return F.nullif(F.instr(col(text), col(word)) if isinstance(word, str) else F.position(col(word), col(text)), F.lit(0))


def nearest_name(text: str | Column, names: Column, keyword: Column) -> Column:
    """Of an array of names that occur, the one whose start is nearest to the keyword's; ties to the earlier in the text."""
    at = F.position(keyword, col(text))
    own = F.transform(names, lambda n: F.struct(F.abs(F.position(n, col(text)) - at).alias("far"), F.position(n, col(text)).alias("at"), n.alias("name")))
    return F.when(at > 0, F.array_min(F.filter(own, lambda x: x["at"] > 0))["name"])


def is_about(text: str | Column, target: Column, names: Column, keyword: Column, connectors: list[str]) -> Column:
    """The keyword is about the target: it is the nearest name, or the first where a connector word stands between names."""
    first = F.array_min(F.filter(F.transform(names, lambda n: F.struct(F.position(n, col(text)).alias("at"), n.alias("name"))), lambda x: x["at"] > 0))["name"]
    joined = contains_any(text, [f" {c} " for c in connectors])
    return F.when(joined & (F.position(keyword, col(text)) > F.position(target, col(text))), first == target).otherwise(nearest_name(text, names, keyword) == target)


def part_of_double_name(headline: str | Column, alias: Column) -> Column:
    """The alias is half of a hyphenated name in the headline as written; a dash between spaces is no hyphen."""
    text = F.lower(fold_latin(headline))
    return F.regexp_like(text, F.concat(F.lit(r"(\b"), alias, F.lit(r"[\u2010-\u2015-]\w)|(\w[\u2010-\u2015-]"), alias, F.lit(r"\b)")))


def recovery_weeks(text: str | Column, ranges: dict[str, tuple[int, int]], longer: list[str], shorter: list[str]) -> Column:
    """(low, high) weeks of the body part named with the largest high; null if none is named, as a whole word.

    Words of a severe injury widen the range to 12 and 26 weeks at least; else words of a slight one halve it, to one week at least.
    """
    rows = F.array(*(F.struct(F.lit(high).alias("high"), F.lit(-i).alias("order"), F.lit(low).alias("low"), F.lit(part).alias("part")) for i, (part, (low, high)) in enumerate(ranges.items())))
    word = lambda w: F.regexp_like(col(text), F.concat(F.lit(r"\b"), w, F.lit(r"\b")))
    worst = F.array_max(F.filter(rows, lambda r: word(r["part"])))
    severe, slight = (F.exists(F.array(*map(F.lit, words)), word) for words in (longer, shorter))
    half = lambda n: F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    low = F.when(severe, F.greatest(worst["low"], F.lit(12))).when(slight, half(worst["low"])).otherwise(worst["low"])
    high = F.when(severe, F.greatest(worst["high"], F.lit(26))).when(slight, half(worst["high"])).otherwise(worst["high"])
    return F.when(worst.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def decision(remove_hits: Column, watch_hits: Column, surname_only: Column, names_target: Column) -> Column:
    """remove, watch or null: a hard keyword removes only under the full name or with the target event named."""
    hard = F.size(remove_hits) > 0
    return F.when(hard & (~surname_only | names_target), "remove").when(hard | (F.size(watch_hits) > 0), "watch")


def severity(status: str | Column) -> Column:
    """2 for remove, 1 for watch, 0 else: statuses only escalate, so a group's status is its largest."""
    return F.when(col(status) == "remove", 2).when(col(status) == "watch", 1).otherwise(0)


def status_of(severity_code: Column) -> Column:
    return F.when(severity_code == 2, "remove").when(severity_code == 1, "watch").otherwise("ok")


def did_not_finish_near(text: str | Column, name: Column, within: int = 40) -> Column:
    """"dnf" as a word within so many characters behind the name."""
    at = F.position(name, col(text))
    return (at > 0) & F.regexp_like(F.substring(col(text), at + F.length(name), F.lit(within)), F.lit(r"\bdnf\b"))


def around(text: str | Column, name: Column, before: int = 100, after: int = 300) -> Column:
    """The text about a name."""
    at = F.position(name, col(text))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(col(text), start, at + after - start))


def evidence(matches: Column) -> Column:
    """The last match as a quoted headline with source and date."""
    last = F.try_element_at(matches, F.lit(-1))
    return F.when(F.size(matches) > 0, F.concat(F.lit('"'), last["headline"], F.lit('" ('), F.concat_ws(", ", last["source"], last["published"]), F.lit(")")))
