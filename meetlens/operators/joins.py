"""Joins with rules: labels, tiers of keys, as-of lookups with fallbacks, reconciliation, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def with_labels(features: DataFrame, labels: DataFrame, keys: Keys, label: Column, default_tier: str = "tour") -> DataFrame:
    """Left join of label rows; a row without a label gets 0, and the default tier."""
    found = labels.select(*keys, label.cast("int").alias("label"), "tier").groupBy(*keys).agg(F.max("label").alias("label"), F.min("tier").alias("tier"))
    return features.join(found, keys, "left").withColumns({"label": F.coalesce("label", F.lit(0)), "tier": F.coalesce("tier", F.lit(default_tier))})


def contested(features: DataFrame, finals: DataFrame, keys: Keys) -> DataFrame:
    """Only rows of a (discipline, season) that was contested."""
    return features.join(finals.select(*keys).distinct(), keys, "left_semi")


def unmatched(labels: DataFrame, features: DataFrame, keys: Keys) -> DataFrame:
    """Label rows that no feature row meets: an empty result is the check that keys agree."""
    return labels.join(features.select(*keys).distinct(), keys, "left_anti")


def pooled(athletes: DataFrame, finals: DataFrame, group: Keys, date: str) -> DataFrame:
    """Each final with the rows of its group dated before its own cut-off."""
    return finals.join(athletes, group).where(F.col(date) < F.col("cutoff"))


def dated(records: DataFrame, dates: DataFrame, keys: Keys) -> DataFrame:
    """Records with their meeting's date; undated ones are left out, not given a default."""
    return records.join(dates.where("date IS NOT NULL").select(*keys, "date").dropDuplicates(keys), keys)


def in_field(df: DataFrame, start_list: DataFrame, keys: Keys, flag: str = "in_field") -> DataFrame:
    """Whether a row's key is on the start list."""
    return df.join(start_list.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def allowed(df: DataFrame, lists: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is on any of the lists."""
    return df.join(reduce(DataFrame.union, [x.select(key) for x in lists]).distinct(), key, "left_semi")


def with_ids(df: DataFrame, ids: DataFrame, keys: Keys, id_column: str) -> DataFrame:
    """Left join of ids after the right side is made unique (its smallest id)."""
    return df.join(ids.groupBy(*keys).agg(F.min(id_column).alias(id_column)), keys, "left")


def tiered_match(entrants: DataFrame, history: DataFrame, entrant_id: str, id_column: str, name: str, nation: str) -> DataFrame:
    """Each entrant's history key and the rule that found it: by id; by name and nation; by a name of one nation only; none.

    The uniqueness of a name's nation is judged over the whole history.
    """
    by_id = history.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(name).alias("_n1"), F.min(nation).alias("_t1"))
    by_both = history.groupBy(name, nation).agg(F.lit(True).alias("_b"))
    by_name = history.groupBy(name).agg(F.count_distinct(nation).alias("_c"), F.min(nation).alias("_t3"))
    out = entrants.join(by_id, id_column, "left").join(by_both, [name, nation], "left").join(by_name, name, "left")
    rule = F.when(F.col("_n1").isNotNull(), "id").when(F.col("_b"), "name+nation").when(F.col("_c") == 1, "name").otherwise("none")
    key = F.when(rule == "id", F.col("_n1")).when(rule != "none", F.col(name))
    where = F.when(rule == "id", F.col("_t1")).when(rule == "name+nation", F.col(nation)).when(rule == "name", F.col("_t3"))
    return out.select(entrant_id, key.alias("matched_name"), where.alias("matched_nation"), rule.alias("matched_by"))


def unique_match(entrants: DataFrame, rows: DataFrame, entrant_id: str, row_id: str, keys: Keys, rule: Column | None = None) -> DataFrame:
    """Pairs in which the entrant has exactly one candidate and the row is claimed by no other entrant."""
    pairs = entrants.join(rows, keys)
    pairs = (pairs if rule is None else pairs.where(rule)).select(entrant_id, row_id).distinct()
    counted = pairs.withColumns({"_e": F.count("*").over(Window.partitionBy(entrant_id)), "_r": F.count("*").over(Window.partitionBy(row_id))})
    return counted.where("_e = 1 AND _r = 1").drop("_e", "_r")


def asof_best(events: DataFrame, history: DataFrame, keys: Keys, cutoff: str, date: str, season: str, event_season: str, score: str, profile: str | None = None) -> DataFrame:
    """Season best before the cut-off, failing that the profile's, failing that last season's (flagged); and earlier bests."""
    rows = events.select(*keys, cutoff, event_season).distinct().join(history.select(*keys, F.col(date).alias("_d"), F.col(season).alias("_y"), F.col(score).alias("_s")), keys).where(F.col("_d") < F.col(cutoff))
    now, last = F.col("_y") == F.col(event_season), F.col("_y") == F.col(event_season) - 1
    found = rows.groupBy(*keys, cutoff, event_season).agg(F.max(F.when(now, F.col("_s"))).alias("_now"), F.max_by("_d", F.when(now, F.struct("_s", (-F.unix_date("_d")).alias("t")))).alias("sb_date"), F.max(F.when(last, F.col("_s"))).alias("prev_season_best"), F.max(F.when(F.col("_y") < F.col(event_season), F.col("_s"))).alias("career_best"))
    out = events.join(found, [*keys, cutoff, event_season], "left")
    own = F.col(profile) if profile else F.lit(None).cast("double")
    source = F.when(F.col("_now").isNotNull(), "toplist").when(own.isNotNull(), "profile").when(F.col("prev_season_best").isNotNull(), "last_season")
    return out.withColumns({"sb_score": F.coalesce("_now", own, "prev_season_best"), "sb_source": source, "sb_prior_season": F.coalesce(source == "last_season", F.lit(False))}).drop("_now")


def last_season_rule(df: DataFrame, now: str, last: str, better_of_two: Column) -> DataFrame:
    """This season's mark; failing that last season's; the larger of the two where the event asks for it."""
    mark = F.when(better_of_two, F.greatest(now, last)).otherwise(F.coalesce(now, last))
    return df.withColumns({"used_score": mark, "used_last_season": F.coalesce((mark == F.col(last)) & (F.col(now).isNull() | (F.col(last) > F.col(now))), F.lit(False))})


def reconcile(qualified: DataFrame, entered: DataFrame, keys: Keys) -> DataFrame:
    """kept, added and not_entered, by a full outer join."""
    both = qualified.select(*keys).distinct().withColumn("_q", F.lit(True)).join(entered.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("_q") & F.col("_e"), "kept").when(F.col("_e"), "added").otherwise("not_entered").alias("entry_status"))


def ordered_diff(a: DataFrame, b: DataFrame, order: list[Column], fields: Keys) -> DataFrame:
    """Two ordered lists compared position by position: one row per field that differs, or row that one of them lacks."""
    w = Window.orderBy(*order)
    left, right = (x.select(F.row_number().over(w).alias("position"), *[F.col(f).cast("string").alias(f"{f}_{s}") for f in fields]) for x, s in ((a, "a"), (b, "b")))
    both = left.join(right, "position", "full")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("old"), F.col(f"{f}_b").alias("new")) for f in fields))
    return both.select("position", F.inline(rows)).where(~F.col("old").eqNullSafe(F.col("new")))


def winner_disagreements(a: DataFrame, b: DataFrame, keys: Keys, name: str, place: str) -> DataFrame:
    """Finals whose winners by two sources do not intersect."""
    x, y = (d.where(F.col(place) == 1).groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias(c)) for d, c in ((a, "winners_a"), (b, "winners_b")))
    return x.join(y, keys).where(~F.arrays_overlap("winners_a", "winners_b"))


def first_source(sources: list[DataFrame], keys: Keys, tiebreak: list[Column]) -> DataFrame:
    """The first row of each key over ordered sources, with the source's number."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("source_no", *tiebreak))).where("_n = 1").drop("_n")


def whole_first_source(sources: list[DataFrame], keys: Keys) -> DataFrame:
    """All rows of the first source that has the key: history with fallbacks, seasons from the first file that has them."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    return rows.withColumn("_m", F.min("source_no").over(Window.partitionBy(*keys))).where("source_no = _m").drop("_m")


def races_on_record(sources: list[DataFrame], name: str, date: str, venue: str) -> DataFrame:
    """Distinct (name, date, venue) rows over several sources, counted by name."""
    rows = reduce(DataFrame.union, [s.select(name, date, venue) for s in sources])
    return rows.distinct().groupBy(name).agg(F.count("*").alias("races"))


def resolved_names(rows: DataFrame, canonical: DataFrame, key: str, name: str) -> DataFrame:
    """Names spelled as the canonical list has them, by id."""
    own = canonical.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias("_c"))
    return rows.join(own, key, "left").withColumn(name, F.coalesce("_c", name)).drop("_c")


def rivals_with_fallback(derived: DataFrame, edges: DataFrame, rivals: DataFrame, athlete: str, rival: str, least: int = 2) -> DataFrame:
    """Derived records of at least `least` meetings against the rivals; an athlete without any gets the edge table's rows."""
    own = derived.where(F.col("meetings") >= least).join(rivals.select(athlete, rival).distinct(), [athlete, rival], "left_semi")
    rest = edges.join(rivals.select(athlete, rival).distinct(), [athlete, rival], "left_semi").join(own.select(athlete).distinct(), athlete, "left_anti")
    return own.withColumn("from_edges", F.lit(False)).unionByName(rest.withColumn("from_edges", F.lit(True)), allowMissingColumns=True)
