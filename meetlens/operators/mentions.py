"""Aliases and mentions: which names a text has, without a regular expression per pair of text and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlens.sources.shared import materialise

Keys = list[str]


def unique_tokens(athletes: DataFrame, key: str, name: str, ambiguous: list[str] = (), least: int = 3) -> DataFrame:
    """alias, key: words of names that belong to exactly one athlete, of three letters or more, not on the stop list."""
    words = athletes.select(key, F.explode(F.split(F.lower(name), " ")).alias("alias")).where((F.length("alias") >= least) & ~F.col("alias").isin(*ambiguous or [""]))
    return words.groupBy("alias").agg(F.min(key).alias(key), F.count_distinct(key).alias("_n")).where("_n = 1").drop("_n")


def aliases(athletes: DataFrame, key: str, name: str, ambiguous: list[str] = ()) -> DataFrame:
    """Full names, and the unique words but for the first: alias, key, surname_only."""
    full = athletes.select(F.lower(name).alias("alias"), key, F.lit(False).alias("surname_only"))
    rest = athletes.select(key, F.array_join(F.slice(F.split(F.lower(name), " "), 2, 1 << 20), " ").alias("_r"))
    return full.unionByName(unique_tokens(rest, key, "_r", ambiguous).withColumn("surname_only", F.lit(True)))


_WORDS = r"(\w+)"


def positions(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """The positional word index: a row (text_id, _p, _w) for each word of each text."""
    return texts.select(text_id, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_WORDS), F.lit(1))).alias("_p", "_w"))


def mentions(texts: DataFrame, text_id: str, text: str, alias_table: DataFrame, key: str, alias: str) -> DataFrame:
    """text_id, key, alias: names that occur as whole words, once a text. Equi-joins on the positional word index; no theta join.

    Of the index only words that some alias has are kept, and written once. An alias is looked up by its rarest word, which gives the
    place where it would start; its other words are then joined by text, place and word. Aliases of one word need the first step only.
    """
    named = alias_table.select(key, alias, F.regexp_extract_all(F.col(alias), F.lit(_WORDS), F.lit(1)).alias("_as")).where(F.size("_as") > 0).distinct()
    parts = named.select(key, alias, "_as", F.posexplode("_as").alias("_o", "_w"))
    known = materialise(positions(texts, text_id, text).join(parts.select("_w").distinct(), "_w", "left_semi"), "positions")
    often = parts.join(known.groupBy("_w").agg(F.count("*").alias("_c")), "_w")
    rarest = often.groupBy(key, alias, "_as").agg(F.min(F.struct("_c", "_o", "_w")).alias("_r"), F.count("*").alias("_n")).where(F.col("_n") == F.size("_as"))
    anchors = rarest.select(key, alias, "_as", F.col("_r._o").alias("_o"), F.col("_r._w").alias("_w"))
    starts = known.join(anchors, "_w").select(text_id, key, alias, (F.col("_p") - F.col("_o")).alias("_s"), "_as")
    single = starts.where(F.size("_as") == 1).select(text_id, key, alias)
    wanted = starts.where(F.size("_as") > 1).select(text_id, key, alias, "_s", F.size("_as").alias("_n"), F.posexplode("_as").alias("_o", "_w")).withColumn("_p", F.col("_s") + F.col("_o"))
    met = wanted.join(known, [text_id, "_p", "_w"]).groupBy(text_id, key, alias, "_s", "_n").agg(F.count("*").alias("_m")).where("_m = _n")
    return single.union(met.select(text_id, key, alias)).distinct()


def superseded(flags: DataFrame, returns: DataFrame, keys: Keys, flagged: str, back: str) -> DataFrame:
    """Flags without a later return."""
    last = returns.groupBy(*keys).agg(F.max(back).alias("_b"))
    return flags.join(last, keys, "left").where(F.col("_b").isNull() | (F.col("_b") <= F.col(flagged))).drop("_b")


def flagged(articles: DataFrame, alias_table: DataFrame, returns: DataFrame, hard: list[str], soft: list[str], event_terms: list[str]) -> DataFrame:
    """The whole text pipeline: articles (id, text, published) x aliases to flags per athlete, less those that have returned.

    A keyword counts for the nearest name of the article's own; statuses only escalate.
    """
    from meetlens.functions import text as T

    found = mentions(articles, "id", "text", alias_table, "athlete", "alias").join(alias_table.select("athlete", "alias", "surname_only"), ["athlete", "alias"])
    full = Window.partitionBy("id", "athlete")
    found = found.withColumn("_f", F.min("surname_only").over(full)).where("surname_only = _f").drop("_f")  # a full name outranks its surname
    named = found.groupBy("id").agg(F.collect_set("alias").alias("_names"))
    rows = articles.join(found, "id").join(named, "id").withColumns({"_h": T.whole_word_hits("text", hard), "_s": T.whole_word_hits("text", soft)})
    own = lambda words: F.filter(words, lambda k: T.nearest_name("text", F.col("_names"), k) == F.col("alias"))
    rows = rows.withColumn("status", T.decision(own(F.col("_h")), own(F.col("_s")), F.col("surname_only"), T.contains_any("text", event_terms))).where("status IS NOT NULL")
    flags = rows.groupBy("athlete").agg(F.max(T.severity("status")).alias("_v"), F.max("published").alias("newest"), F.count("*").alias("articles")).withColumn("status", T.status_of(F.col("_v"))).drop("_v")
    return superseded(flags, returns, ["athlete"], "newest", "returned")
