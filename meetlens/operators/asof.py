"""What is known of athletes at the cut-offs of finals: bests, form, rates and records, from races strictly before.

Cut-offs and races of an athlete are one table, dealt by group and athlete once; every state is a running window over it, so no join
of races and cut-offs is made and a cut-off costs a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]
#: Days of recent form, marks in form, most podiums at big meetings that count.
RECENT_DAYS, FORM_MARKS, PODIUM_CAP = 42, 3, 5


def as_of_states(entries: DataFrame, races: DataFrame, group: Keys, athlete: str, cutoff: str, date: str, season: str, score: str, place: str, big: Column, recent_days: int = RECENT_DAYS, form_marks: int = FORM_MARKS, podium_cap: int = PODIUM_CAP) -> DataFrame:
    """entries (group, athlete, cutoff, season, more) with the athlete's states before the cut-off.

    sb_score, sb_date: the season's best and its first day, failing that last season's (sb_prior_season 1); career_best, prev_season_best,
    two_seasons_ago_best, older_seasons_best and its latest season: bests of earlier seasons; form_score, form_spread: mean and span of the
    season's best form_marks; recent_score: best of the season's last recent_days; races: the season's scores; big_podiums: its places 1 to 3
    at big meetings, podium_cap at most. A race without a score counts for podiums only; without a date for nothing.
    """
    own = ["__t", "__y", "__s", "__p", "__entry"]
    day = lambda c: F.unix_date(F.to_date(c))
    here = entries.select(*group, athlete, (2 * day(cutoff)).alias("__t"), F.col(season).cast("int").alias("__y"), F.lit(None).cast("double").alias("__s"), F.lit(0).alias("__p"), F.struct(*entries.columns).alias("__entry"))
    past = races.where(F.col(date).isNotNull()).select(*group, athlete, (2 * day(date) + 1).alias("__t"), F.col(season).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"), (F.coalesce(big, F.lit(False)) & F.coalesce(F.col(place) <= 3, F.lit(False))).cast("int").alias("__p"))
    rows = past.withColumn("__entry", F.lit(None).cast(here.schema["__entry"].dataType)).select(*group, athlete, *own).unionByName(here).repartition(*group, athlete)
    key = Window.partitionBy(*group, athlete)
    this = Window.partitionBy(*group, athlete, "__y").orderBy("__t")
    before = this.rowsBetween(Window.unboundedPreceding, -1)
    recent = this.rangeBetween(-2 * recent_days, -1)
    seasons = lambda a, b: key.orderBy("__y").rangeBetween(a, b)
    mark = F.when(F.col("__s").isNotNull(), F.struct(F.col("__s").alias("s"), (-F.col("__t")).alias("t"), F.col("__y").alias("y")))
    old = F.when(F.col("__s").isNotNull(), F.struct(F.col("__s").alias("s"), F.col("__y").alias("y")))
    known = rows.withColumns(
        {
            "__now": F.max(mark).over(before),
            "__last": F.max(mark).over(seasons(-1, -1)),
            "__races": F.count("__s").over(before),
            "__podiums": F.coalesce(F.sum("__p").over(before), F.lit(0)),
            "__best": F.slice(F.sort_array(F.collect_list("__s").over(before), asc=False), 1, form_marks),
            "recent_score": F.max("__s").over(recent),
            "career_best": F.max("__s").over(seasons(Window.unboundedPreceding, -1)),
            "two_seasons_ago_best": F.max("__s").over(seasons(-2, -2)),
            "__older": F.max(old).over(seasons(Window.unboundedPreceding, -3)),
        }
    ).where("__entry IS NOT NULL")
    used = F.coalesce("__now", "__last")
    total = F.aggregate("__best", F.lit(0.0), lambda a, x: a + x)
    return known.select(
        "__entry.*",
        used["s"].alias("sb_score"),
        F.date_from_unix_date(F.floor(-used["t"] / 2).cast("int")).alias("sb_date"),
        (F.col("__now").isNull() & F.col("__last").isNotNull()).cast("double").alias("sb_prior_season"),
        "career_best",
        F.col("__last.s").alias("prev_season_best"),
        "two_seasons_ago_best",
        F.col("__older.s").alias("older_seasons_best"),
        F.col("__older.y").alias("older_seasons_best_year"),
        F.when(F.size("__best") > 0, total / F.size("__best")).alias("form_score"),
        F.when(F.size("__best") > 0, F.array_max("__best") - F.array_min("__best")).alias("form_spread"),
        "recent_score",
        F.col("__races").alias("races"),
        F.least(F.col("__podiums"), F.lit(podium_cap)).cast("double").alias("big_podiums"),
    )


def record_against_strongest(entries: DataFrame, races: DataFrame, final: Keys, group: Keys, athlete: str, cutoff: str, season: str, score: str, race: Keys, date: str, place: str, strongest: int = 3) -> DataFrame:
    """entries with h2h_top: (wins - losses) / (wins + losses) over the season's races before the cut-off against the `strongest` best
    scores of the field but one's own; 0 without a decided meeting. A shared place is neither. Meetings come from the races, once for both
    of a pair, and meet the entries by pair and season: rows grow with meetings and entries, and not with all races of an entry's season.
    """
    ranked = entries.where(F.col(score).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(*final).orderBy(F.desc(score), athlete))).where(F.col("__n") <= strongest + 1)
    top = ranked.select(*final, F.col(athlete).alias("__rival"), "__n")
    pairs = entries.select(*final, *(c for c in [*group, cutoff, season] if c not in final), athlete).join(top, final).where(F.col(athlete) != F.col("__rival"))
    pairs = pairs.withColumn("__k", F.row_number().over(Window.partitionBy(*final, athlete).orderBy("__n"))).where(F.col("__k") <= strongest)
    first = F.col(athlete) < F.col("__rival")  # an entry's own side of the pair is its first
    pairs = pairs.select(*final, *(c for c in group if c not in final), athlete, F.to_date(cutoff).alias("__cutoff"), F.col(season).alias("__season"), F.least(athlete, "__rival").alias("__a"), F.greatest(athlete, "__rival").alias("__b"), first.alias("__first"))
    run = races.where(F.col(place).isNotNull() & F.col(date).isNotNull())
    side = lambda n: run.select(*group, *(c for c in race if c not in group), F.col(athlete).alias(f"__{n}"), F.col(season).alias(f"__{n}y"), F.to_date(date).alias(f"__{n}d"), F.col(place).alias(f"__{n}p"))
    both = side("a").join(side("b"), list(dict.fromkeys([*group, *race]))).where((F.col("__a") < F.col("__b")) & (F.col("__ap") != F.col("__bp")))
    # a meeting counts by the season and day of one's own row; where these are the same for both, one row serves both
    view = lambda n, whose: F.struct(F.col(f"__{n}y").alias("__season"), F.col(f"__{n}d").alias("__d"), F.lit(whose).cast("boolean").alias("__whose"))
    same = F.col("__ay").eqNullSafe(F.col("__by")) & (F.col("__ad") == F.col("__bd"))
    views = F.when(same, F.array(view("a", None))).otherwise(F.array(view("a", True), view("b", False)))
    meetings = both.select(*group, "__a", "__b", (F.col("__ap") < F.col("__bp")).alias("__won"), F.explode(views).alias("__v")).select(*group, "__a", "__b", "__won", "__v.*")
    met = pairs.join(meetings, [*group, "__a", "__b", "__season"]).where((F.col("__d") < F.col("__cutoff")) & F.coalesce(F.col("__whose") == F.col("__first"), F.lit(True)))
    sums = met.groupBy(*final, athlete).agg(F.count_if(F.col("__won") == F.col("__first")).alias("__w"), F.count_if(F.col("__won") != F.col("__first")).alias("__l"))
    net = (F.col("__w") - F.col("__l")) / F.nullif(F.col("__w") + F.col("__l"), F.lit(0))
    return entries.join(sums, [*final, athlete], "left").withColumn("h2h_top", F.coalesce(net.cast("double"), F.lit(0.0))).drop("__w", "__l")
