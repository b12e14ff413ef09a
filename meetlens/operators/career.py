"""An athlete's career from a profile's lists: honours, their headline, rankings and personal bests. One aggregate per list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.functions import marks

Keys = list[str]

# Categories of honours and how a title of theirs is called, the best first; what is never a headline; medal words.
GLOBAL = [("Olympic Games", "Olympic"), ("World Championships", "World"), ("Diamond League Final", "Diamond League Final"), ("World Indoor Championships", "World Indoor")]
CONTINENTAL = [
    ("European Championships", "European"),
    ("Commonwealth Games", "Commonwealth"),
    ("Asian Games", "Asian Games"),
    ("Asian Championships", "Asian"),
    ("African Championships", "African"),
    ("Pan American Games", "Pan American"),
    ("NACAC Championships", "NACAC"),
    ("South American Championships", "South American"),
    ("Oceania Championships", "Oceania"),
]
NEVER = r"(?i)U1[0-9]|U2[0-9]|youth|junior|NCAA|National"
MEDALS = ["champion", "silver", "bronze"]


def _rank(category: Column) -> Column:
    """Place of a category among the known ones; others come last."""
    order = F.array(*(F.lit(name) for name, _ in [*GLOBAL, *CONTINENTAL]))
    return F.when(F.array_position(order, category) > 0, F.array_position(order, category)).otherwise(len(GLOBAL) + len(CONTINENTAL) + 1)


def honours(results: DataFrame, athlete: Keys) -> DataFrame:
    """A row for each athlete and category of (category, competition, mark, place as text): its results in order of competition, medals,
    podiums, and honour_no, its place among the athlete's: by what the championship is, then golds, podiums and name.
    """
    from pyspark.sql import Window

    place = marks.leading_digits("place")
    item = F.struct("competition", "mark", place.alias("place"))
    count = lambda k: F.count_if(F.coalesce(place == k, F.lit(False)))
    groups = results.where(F.col("category").isNotNull()).groupBy(*athlete, "category").agg(F.array_sort(F.collect_list(item)).alias("results"), count(1).alias("gold"), count(2).alias("silver"), count(3).alias("bronze"))
    ranked = groups.withColumns({"podiums": F.col("gold") + F.col("silver") + F.col("bronze"), "tier_no": _rank(F.col("category")).cast("int")})
    return ranked.withColumn("honour_no", F.row_number().over(Window.partitionBy(*athlete).orderBy("tier_no", F.desc("gold"), F.desc("podiums"), "category")))


def headline(groups: DataFrame, athlete: Keys, most: int = 3) -> DataFrame:
    """athlete, headline: the best colour of up to three categories with a podium, global ones first and continental ones only where
    there is none; nothing for an athlete with neither.
    """
    label = marks.in_order("category", [(f"^{name}$", label) for name, label in [*GLOBAL, *CONTINENTAL]])
    best = F.when(F.col("gold") > 0, F.struct(F.col("gold").alias("n"), F.lit(MEDALS[0]).alias("word"))).when(F.col("silver") > 0, F.struct(F.col("silver").alias("n"), F.lit(MEDALS[1]).alias("word"))).otherwise(F.struct(F.col("bronze").alias("n"), F.lit(MEDALS[2]).alias("word")))
    named = groups.where((F.col("podiums") > 0) & (F.col("tier_no") <= len(GLOBAL) + len(CONTINENTAL)) & ~F.col("category").rlike(NEVER)).select(*athlete, "tier_no", label.alias("label"), best.alias("b"))
    part = F.concat(F.when(F.col("b.n") > 1, F.concat(F.col("b.n").cast("string"), F.lit("× "))).otherwise(""), F.col("label"), F.lit(" "), F.col("b.word"))
    lists = named.groupBy(*athlete).agg(F.array_sort(F.collect_list(F.struct("tier_no", part.alias("part")))).alias("parts"))
    kept = F.filter("parts", lambda p: (p["tier_no"] <= len(GLOBAL)) == F.exists("parts", lambda q: q["tier_no"] <= len(GLOBAL)))
    return lists.select(*athlete, F.array_join(F.slice(F.transform(kept, lambda p: p["part"]), 1, most), " · ").alias("headline"))


def world_ranking(rows: DataFrame, athlete: Keys) -> DataFrame:
    """athlete, events (event, place; the best first), overall: the place in the overall ranking, which is another scale."""
    overall = F.contains(F.coalesce("event", F.lit("")), F.lit("Overall"))
    known = rows.where(F.col("place").isNotNull())
    events = F.array_sort(F.collect_list(F.when(~overall, F.struct(F.col("place").cast("int").alias("place"), F.coalesce("event", F.lit("")).alias("event")))))
    return known.groupBy(*athlete).agg(events.alias("events"), F.max(F.when(overall, F.col("place").cast("int"))).alias("overall"))


def personal_bests(rows: DataFrame, athlete: Keys) -> DataFrame:
    """athlete, bests (date, discipline, mark, venue, indoor; the newest first), event_count: disciplines among them."""
    indoor = F.coalesce(F.col("venue").rlike(r"(?i)\(i\)\s*$|\bindoor\b"), F.lit(False))
    item = F.struct(marks.any_date("date").alias("date"), "discipline", "mark", "venue", indoor.alias("indoor"))
    return rows.groupBy(*athlete).agg(F.sort_array(F.collect_list(item), asc=False).alias("bests"), F.count_distinct("discipline").alias("event_count"))


def career(honour_rows: DataFrame, ranking_rows: DataFrame, best_rows: DataFrame, athlete: Keys) -> DataFrame:
    """One row for each athlete that any of the lists names: headline, honours in order, rankings, bests. An athlete's lists are bounded
    by the profile, so they are arrays.
    """
    groups = honours(honour_rows, athlete)
    item = F.struct("honour_no", "category", "results", "gold", "silver", "bronze", "podiums")
    listed = groups.groupBy(*athlete).agg(F.array_sort(F.collect_list(item)).alias("honours"))
    parts = [headline(groups, athlete), world_ranking(ranking_rows, athlete), personal_bests(best_rows, athlete)]
    out = listed
    for part in parts:
        out = out.join(part, athlete, "full")
    return out.where(F.coalesce(F.size("honours") > 0, F.lit(False)) | F.coalesce(F.size("events") > 0, F.lit(False)) | F.coalesce(F.size("bests") > 0, F.lit(False)))
