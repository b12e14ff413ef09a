"""Bests, records, seasons, depth and other aggregates, with the direction of an event as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.functions.marks import col
from meetlens.operators.order import join_null_safe, quantiles, share_at_most

Keys = list[str]


def best(value: str | Column, higher_is_better: bool) -> Column:
    return (F.max if higher_is_better else F.min)(value)


def best_per_group(df: DataFrame, keys: Keys, value: str, higher_is_better: bool) -> DataFrame:
    return df.groupBy(*keys).agg(best(value, higher_is_better).alias("best"))


def event_counts(athletes: DataFrame, log: DataFrame | None, keys: Keys, fallback: str) -> DataFrame:
    """meets: rows of the log, 0 for a key that it lacks; without a log the fallback column."""
    if log is None:
        return athletes.withColumn("meets", F.col(fallback))
    return athletes.join(log.groupBy(*keys).agg(F.count("*").alias("meets")), keys, "left").withColumn("meets", F.coalesce("meets", F.lit(0)))


def spread(value: str) -> Column:
    """Sample deviation; a single row has none and counts as 0."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def latest_season_deviation(df: DataFrame, keys: Keys, season: str, value: str, fallback: float = 0.0) -> DataFrame:
    """Deviation within each key's own most recent season."""
    last = df.withColumn("_y", F.max(season).over(Window.partitionBy(*keys))).where(F.col(season) == F.col("_y"))
    return last.groupBy(*keys).agg(F.coalesce(F.stddev_samp(value), F.lit(fallback)).alias("season_deviation"))


def season_features(log: DataFrame, finals: DataFrame, group: Keys, athlete: Keys, higher_is_better: bool, date: str = "date", season: str = "year", value: str = "value") -> DataFrame:
    """Per athlete and final, from rows dated before the cut-off only; athletes without a row that season give none.

    finals: the group keys, season, cutoff. season_best, career_best, last_best, pb_gap, meets, deviation, year_on_year.
    """
    rows = log.join(finals.select(*group, F.col(season).alias("_season"), "cutoff"), group).where((F.col(date) < F.col("cutoff")) & (F.col(season) <= F.col("_season")))
    now, last = F.col(season) == F.col("_season"), F.col(season) == F.col("_season") - 1
    out = rows.groupBy(*group, F.col("_season").alias(season), "cutoff", *athlete).agg(best(F.when(now, F.col(value)), higher_is_better).alias("season_best"), best(value, higher_is_better).alias("career_best"), best(F.when(last, F.col(value)), higher_is_better).alias("last_best"), F.count_if(now).alias("meets"), F.coalesce(F.stddev_samp(F.when(now, F.col(value))), F.lit(0.0)).alias("deviation"))
    gain = F.col("season_best") - F.col("last_best") if higher_is_better else F.col("last_best") - F.col("season_best")
    return out.where("meets > 0").withColumns({"pb_gap": F.abs(F.col("season_best") - F.col("career_best")), "year_on_year": F.coalesce(gain, F.lit(0.0))})


def year_over_year(df: DataFrame, keys: Keys, season: str, value: str, higher_is_better: bool) -> DataFrame:
    """Each season's best and the gain on the season before (positive is better; 0 if there was none)."""
    seasons = df.groupBy(*keys, season).agg(best(value, higher_is_better).alias("season_best"))
    before = seasons.select(*keys, (F.col(season) + 1).alias(season), F.col("season_best").alias("last_best"))
    gain = F.col("season_best") - F.col("last_best") if higher_is_better else F.col("last_best") - F.col("season_best")
    return seasons.join(before, [*keys, season], "left").withColumn("year_on_year", F.coalesce(gain, F.lit(0.0)))


def weighted_best(df: DataFrame, keys: Keys, value: str, weight: Column, higher_is_better: bool) -> DataFrame:
    """Best after weighing marks by their competition: times the weight in the field, divided by it on the track."""
    own = F.col(value) * weight if higher_is_better else F.col(value) / weight
    return df.groupBy(*keys).agg(best(own, higher_is_better).alias("weighted_best"))


def competition_record(df: DataFrame, athlete: Keys, cuts: Keys, place: str = "place") -> DataFrame:
    """Races, wins, podiums, rates in percent and finishes of each athlete: overall and by each of the cuts."""
    sets = [[F.col(c) for c in athlete], *[[*(F.col(c) for c in athlete), F.col(cut)] for cut in cuts]]
    p = F.col(place)
    races, rate = F.count("*"), lambda c: F.round(F.count_if(c) * 100.0 / F.count("*"), 1)
    made = [races.alias("races"), F.count_if(p == 1).alias("wins"), F.count_if(p <= 3).alias("podiums"), rate(p == 1).alias("win_rate"), rate(p <= 3).alias("podium_rate"), F.round(F.avg(p), 4).alias("mean_place"), F.min(p).alias("best_place")]
    names = [F.col(c) for c in [*athlete, *cuts]]
    level = [F.grouping(F.col(c)).alias(f"all_{c}") for c in cuts]
    return df.groupingSets(sets, *names).agg(*made, *level)


def form_by_season(df: DataFrame, keys: Keys, value: str, higher_is_better: bool, top: int = 3) -> DataFrame:
    """Per key (with its season): races, best, mean of the best three, median, variation (population, from three marks), range."""
    order = F.desc(value) if higher_is_better else F.asc(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    variation = F.when(F.count("*") >= 3, F.stddev_pop(value) / F.avg(value) * 100)
    return ranked.groupBy(*keys).agg(F.count("*").alias("races"), best(value, higher_is_better).alias("best"), F.avg(F.when(F.col("_n") <= top, F.col(value))).alias("mean_of_best"), F.median(value).alias("median"), variation.alias("variation"), (F.max(value) - F.min(value)).alias("range"))


def season_shape(df: DataFrame, keys: Keys, date: str, value: str, higher_is_better: bool) -> DataFrame:
    """Races of each month, and of the whole the first and last date and the month of the best mark."""
    d = F.to_date(date)
    months = df.groupBy(*keys, F.month(d).alias("month")).agg(F.count("*").alias("races"), best(value, higher_is_better).alias("month_best"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))
    w = Window.partitionBy(*keys)
    order = (F.desc if higher_is_better else F.asc)("month_best")
    return months.withColumns({"best_month": F.first("month").over(w.orderBy(order, "month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "season_races": F.sum("races").over(w), "season_first": F.min("first_day").over(w), "season_last": F.max("last_day").over(w)})


def career_progression(sources: list[DataFrame], keys: Keys, season: str, date: str, value: str, higher_is_better: bool) -> DataFrame:
    """Season by season over several sources, equal (date, mark) counted once: best, races, indoor races."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    once = rows.groupBy(*keys, season, date, value).agg(F.max("indoor").alias("indoor"))
    return once.groupBy(*keys, season).agg(best(value, higher_is_better).alias("best"), F.count("*").alias("races"), F.count_if("indoor").alias("indoor_races"))


def depth_stats(df: DataFrame, group: Keys, score: str, indoor: Column | None = None) -> DataFrame:
    """Count, whole-number median, largest score and share indoors of each group. The median is exact, over counts by value."""
    extra = [F.round(F.avg(indoor.cast("double")), 4).alias("indoor_share")] if indoor is not None else []
    middle = quantiles(df, group, F.col(score), {"_median": 0.5})
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), F.max(score).alias("top_score"), F.min(score).alias("low_score"), *extra)
    named = join_null_safe(sums, middle, group, "left")
    return named.select(*group, "n", F.floor("_median").cast("long").alias("median_score"), "top_score", "low_score", *(["indoor_share"] if extra else []))


def corpus_counts(df: DataFrame, season: Column, venue: str, date: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(season).alias("seasons"), F.count_distinct(venue).alias("venues"), F.count_distinct(F.struct(F.col(venue), date)).alias("venue_days"))


def coverage(df: DataFrame, keys: Keys, group: str, scored: Column, podium: Column, gate: float = 0.85) -> DataFrame:
    """Of each competition: groups, rows, the shares of rows and of podium rows that are scored, and whether the gate is met."""
    s = scored.cast("double")
    out = df.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups"), F.count("*").alias("n_rows"), F.round(F.avg(s), 4).alias("share_scored"), F.round(F.avg(F.when(podium, s)), 4).alias("podium_share"))
    return out.withColumn("gate_met", F.col("share_scored") >= gate)


def race_summary(df: DataFrame, keys: Keys, date: str, score: str, cutoff: Column, big: Column, place: str, recent_days: int = 42, marks: int = 3, most_podiums: int = 5) -> DataFrame:
    """From rows before the cut-off: mean and deviation of the best scores, best of the last days, races, big podiums (capped)."""
    rows = df.where(F.to_date(date) < cutoff)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score))))
    top = F.when(F.col("_n") <= marks, F.col(score))
    recent = F.when(F.to_date(date) >= F.date_sub(cutoff, recent_days), F.col(score))
    return ranked.groupBy(*keys).agg(F.avg(top).alias("form_score"), F.coalesce(F.stddev_samp(top), F.lit(0.0)).alias("form_spread"), F.max(recent).alias("recent_score"), F.count("*").alias("races"), F.least(F.count_if(big & (F.col(place) <= 3)), F.lit(most_podiums)).alias("big_podiums"))


def earlier_bests(df: DataFrame, keys: Keys, season: str, score: str, year: Column) -> DataFrame:
    """Best before a season: ever, one and two seasons ago, three or more ago, and the latest season that holds the last."""
    y, s = F.col(season), F.col(score)
    old = F.max(F.struct(F.when(y <= year - 3, s).alias("s"), F.when(y <= year - 3, y).alias("y")))
    out = df.where(y < year).groupBy(*keys).agg(F.max(s).alias("career_best"), F.max(F.when(y == year - 1, s)).alias("prev_best"), F.max(F.when(y == year - 2, s)).alias("two_ago_best"), old.alias("_o"))
    return out.withColumns({"older_best": F.col("_o.s"), "older_year": F.col("_o.y")}).drop("_o")


def complete_podiums(df: DataFrame, final: Keys, place: str, athlete: str) -> DataFrame:
    """Places 1 to 3 of finals in which each of them is held exactly once after de-duplication."""
    first = df.where(F.col(place).between(1, 3)).groupBy(*final, place).agg(F.min(athlete).alias(athlete))
    return first.withColumn("_n", F.count("*").over(Window.partitionBy(*final))).where("_n = 3").drop("_n")


def start_lists(sources: list[DataFrame], keys: Keys) -> DataFrame:
    """Distinct start-list rows of several sources."""
    rows = sources[0].select(*keys)
    for s in sources[1:]:
        rows = rows.union(s.select(*keys))
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct()


def nation_rollup(df: DataFrame, nation: Keys, athlete: str, event: str, score: str, priority: str) -> DataFrame:
    """Per nation its athletes as an ordered array: the best-placed source's row of each (athlete, event), score desc, nulls last."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*nation, athlete, event).orderBy(priority, F.desc_nulls_last(score)))).where("_n = 1")
    item = F.struct((-F.coalesce(score, F.lit(-1.0))).alias("k"), F.col(event).alias("event"), F.col(athlete).alias("athlete"), F.col(score).alias("score"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["athlete"].alias("athlete"), x["event"].alias("event"), x["score"].alias("score")))
    return first.groupBy(*nation).agg(F.count("*").alias("n"), F.max(score).alias("top_score"), rows.alias("athletes"))


def relay_squads(df: DataFrame, team: Keys, athlete: str, meet: str, round_id: str, leg: str) -> DataFrame:
    """Appearances of each squad member: rounds, meets, the legs run; most meets first."""
    return df.groupBy(*team, athlete).agg(F.count_distinct(meet).alias("meets"), F.count_distinct(round_id).alias("rounds"), F.array_sort(F.collect_set(leg)).alias("legs")).orderBy(*team, F.desc("meets"), F.desc("rounds"), F.element_at("legs", 1), athlete)


def field_gap(df: DataFrame, partition: Keys, value: str, higher_is_better: bool, name: str = "field_gap") -> DataFrame:
    """How far behind the field's best, in sample deviations of the field; 0 where there is no spread.

    The best and the deviation are aggregates, joined back: no field is gathered in one task.
    """
    best = F.max(value) if higher_is_better else F.min(value)
    fields = df.groupBy(*partition).agg(best.alias("_best"), F.stddev_samp(value).alias("_sd"))
    behind = F.col("_best") - F.col(value) if higher_is_better else F.col(value) - F.col("_best")
    return join_null_safe(df, fields, partition).withColumn(name, F.coalesce(behind / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(0.0))).drop("_best", "_sd")


def score_context(df: DataFrame, group: Keys, score: str, at: DataFrame) -> DataFrame:
    """For probe scores (group keys, probe): the share of all rows and of the group's rows at or below, in percent.

    Probes may be many: each meets a running count (order.share_at_most), so neither side is broadcast and no pairs are made.
    """
    probes = at.select(*group, "probe").distinct()
    both = share_at_most(share_at_most(probes, df, [], F.col(score), "probe", "_overall"), df, group, F.col(score), "probe", "_inside")
    return both.select(*group, "probe", F.round(100.0 * F.col("_overall"), 4).alias("overall_percentile"), F.round(100.0 * F.col("_inside"), 4).alias("group_percentile"))


def depth_index(df: DataFrame, group: Keys, score: str, athlete: str, chance: str) -> DataFrame:
    """Per field: spread of scores, best athlete, median, gap between the two best chances; rank 1 is the closest field.

    The two best chances come from a top-2 cut, which Spark makes before the shuffle; the median is exact, over counts by value.
    """
    two = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(chance), athlete))).where("_n <= 2")
    gaps = two.groupBy(*group).agg(F.max(F.when(F.col("_n") == 1, F.col(chance))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col(chance))).alias("_b"))
    sums = df.groupBy(*group).agg((F.max(score) - F.min(score)).alias("spread"), F.max_by(athlete, F.struct(F.col(score), (-F.hash(athlete)).alias("h"))).alias("best_athlete"), F.count("*").alias("n"))
    both = join_null_safe(join_null_safe(sums, gaps, group), quantiles(df, group, F.col(score), {"median_score": 0.5}), group, "left")
    out = both.select(*group, "spread", "best_athlete", "median_score", (F.col("_a") - F.col("_b")).alias("chance_gap"), "n")
    return out.withColumn("depth_rank", F.row_number().over(Window.orderBy("spread", *group)))


def trajectory(df: DataFrame, keys: Keys, date: str, value: str, higher_is_better: bool, least: int = 3) -> DataFrame:
    """Seasons of three races or more: week of the peak, improvement from the first mark, early and late means of three."""
    from meetlens.functions.marks import season_week

    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_a": F.row_number().over(w.orderBy(date, value)), "_z": F.row_number().over(w.orderBy(F.desc(date), F.desc(value))), "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    peak = (F.max_by if higher_is_better else F.min_by)(season_week(date), value)
    sign = 1 if higher_is_better else -1
    out = rows.groupBy(*keys).agg(F.count("*").alias("races"), peak.alias("peak_week"), (sign * (best(value, higher_is_better) - F.max(F.when(F.col("_a") == 1, F.col(value))))).alias("improvement"), F.avg(F.when(F.col("_a") <= 3, F.col(value))).alias("early_mean"), F.avg(F.when(F.col("_z") <= 3, F.col(value))).alias("late_mean"))
    return out


def fingerprints(profiles: DataFrame, athlete: Keys) -> DataFrame:
    """Means of an athlete's season trajectories."""
    return profiles.groupBy(*athlete).agg(F.count("*").alias("seasons"), F.avg("peak_week").alias("peak_week"), F.avg("improvement").alias("improvement"), F.avg(F.col("late_mean") - F.col("early_mean")).alias("late_form"))


def activity(a: DataFrame, b: DataFrame, keys: Keys, today: Column) -> DataFrame:
    """Of two sources the larger race count and the later date, and the days since."""
    both = a.withColumnsRenamed({"races": "_ra", "last": "_la"}).join(b.withColumnsRenamed({"races": "_rb", "last": "_lb"}), keys, "full")
    return both.select(*keys, F.greatest("_ra", "_rb").alias("races"), F.greatest("_la", "_lb").alias("last"), F.datediff(today, F.greatest("_la", "_lb")).alias("days_since"))


def news_rollup(articles: DataFrame, athlete: Keys, url: str, headline: str, published: str, status: str, keywords: str) -> DataFrame:
    """One row per athlete: articles once per address (else headline), newest first, all keywords, the gravest status."""
    from meetlens.functions.text import severity, status_of

    once = articles.withColumn("_k", F.coalesce(url, headline))
    once = once.withColumn("_n", F.row_number().over(Window.partitionBy(*athlete, "_k").orderBy(F.desc_nulls_last(published), headline))).where("_n = 1")
    item = F.struct(F.col(published).alias("published"), F.col(headline).alias("headline"))
    return once.groupBy(*athlete).agg(F.count("*").alias("articles"), F.transform(F.sort_array(F.collect_list(item), asc=False), lambda x: x["headline"]).alias("headlines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(keywords)))).alias("keywords"), status_of(F.max(severity(status))).alias("status"), F.max(published).alias("newest"))
