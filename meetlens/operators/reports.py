"""Building blocks of the reports: comparisons, stories, status reasons, indexes, athlete and discipline pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def compare(results: DataFrame, call: DataFrame, final: Keys, athlete: str, place: str, predicted: str, field_size: int) -> DataFrame:
    """Results beside a stored call: field, near_miss or unseen, and predicted minus actual; non-finishers have status dnf."""
    p = F.col(predicted)
    state = F.when(p.isNull(), "unseen").when(p <= field_size, "field").otherwise("near_miss")
    return results.join(call, [*final, athlete], "left").withColumns({"status": F.when(F.col(place).isNull(), "dnf").otherwise("finished"), "state": state, "delta": p - F.col(place)})


def track_record(comparisons: DataFrame, keys: Keys, place: str, predicted: str) -> DataFrame:
    """Of each championship: medallists and winners named, and results unseen by the call."""
    return comparisons.groupBy(*keys).agg(F.count_if((F.col(place) <= 3) & (F.col(predicted) <= 3)).alias("medallists"), F.count_if((F.col(place) == 1) & (F.col(predicted) == 1)).alias("winners"), F.count_if(F.col("state") == "unseen").alias("unseen"), F.count("*").alias("results"))


def status(df: DataFrame, reasons: list[tuple[str, Column]], otherwise: str, name: str = "reason") -> DataFrame:
    """The first reason that holds, in order."""
    out = F.when(reasons[0][1], reasons[0][0])
    for code, test in reasons[1:]:
        out = out.when(test, code)
    return df.withColumn(name, out.otherwise(otherwise))


#: Surprise of a story: background, worth saying, against an expectation, against the model's own call.
CONTEXT, NOTABLE, DEFIES, CONTRADICTS = 0, 1, 2, 3


def storylines(field: DataFrame, rivalries: DataFrame, group: Keys, athlete: str, chance: str, closest: float = 6.0, streak: int = 3, limit: int = 4) -> DataFrame:
    """Stories of each field by six rules, the most surprising first; equal ones in the order of the rules, then of chances.

    field: with flags watch, champion, debut and the length of the winning streak. rivalries: the leader of a pair's record
    with wins and losses. All rules share the field's one window.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(chance), athlete)
    k = field.withColumns({"_n": F.row_number().over(w), "_gap": 100 * (F.col(chance) - F.lead(chance).over(w))})
    k = k.join(rivalries.select(*group, athlete, (F.col("wins") == F.col("losses")).alias("_level")), [*group, athlete], "left")
    n, first = F.col("_n"), F.col("_n") == 1
    rules = [
        ("photo_finish", first & (F.col("_gap") <= closest), F.when(F.col("_gap") <= 2, DEFIES).otherwise(NOTABLE)),
        ("injury_watch", F.col("watch"), F.when(first, CONTRADICTS).when(n <= 3, DEFIES).otherwise(NOTABLE)),
        ("returning_champion", F.col("champion"), F.lit(NOTABLE)),
        ("debutant", F.col("debut"), F.when(first, DEFIES).otherwise(CONTEXT)),
        ("rivalry", F.col("_level").isNotNull(), F.when(F.col("_level") | first, NOTABLE).otherwise(CONTRADICTS)),
        ("hot_streak", F.col("streak") >= streak, F.lit(NOTABLE)),
    ]
    told = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("kind"), F.lit(i).alias("order"), score.alias("surprise"))) for i, (name, test, score) in enumerate(rules))))
    stories = k.select(*group, athlete, "_n", F.explode(told).alias("s")).select(*group, "s.kind", athlete, "s.surprise", "s.order", "_n")
    return stories.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("surprise"), "order", "_n"))).where(F.col("rank") <= limit).drop("order", "_n")


def directory(df: DataFrame, score: str, name: str) -> DataFrame:
    """In order of the best score, then the name, with its position. One row per nation: bounded by their number."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), name)))


def search_index(sources: list[DataFrame], name: str, group: str, rank: str) -> DataFrame:
    """First row of each (name, discipline) over ordered sources."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name, group).orderBy("_s", rank))).where("_n = 1").drop("_s", "_n")


def trajectories(history: DataFrame, field: DataFrame, group: Keys, athlete: str, date: str, value: str, limit: int = 8) -> DataFrame:
    """Histories of each field's contenders as arrays in order of date; those without any are left out."""
    own = history.join(field.select(*group, athlete).distinct(), [*group, athlete], "left_semi")
    return own.groupBy(*group, athlete).agg(F.array_sort(F.collect_list(F.struct(date, value))).alias("history"))


def comparison_rows(names: DataFrame, record: DataFrame, form: DataFrame, recent: DataFrame, keys: Keys) -> DataFrame:
    """One analyst row per contender: record, this season's form and the last places."""
    return names.join(record, keys, "left").join(form, keys, "left").join(recent, keys, "left")


def corrected_by_profile(log: DataFrame, profile: DataFrame, keys: Keys, wind: str = "wind", most_wind: float = 2.0) -> DataFrame:
    """The race log's season, or the profile's where that has more marks; wind-legal marks only."""
    legal = lambda d: d.where(F.col(wind).isNull() | (F.col(wind) <= most_wind))
    a, b = legal(log), legal(profile)
    n = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys, "full")
    use = n.select(*keys, (F.coalesce("_b", F.lit(0)) > F.coalesce("_a", F.lit(0))).alias("_profile"))
    return a.join(use.where("NOT _profile"), keys).unionByName(b.join(use.where("_profile"), keys), allowMissingColumns=True).withColumnRenamed("_profile", "from_profile")


def athlete_page(athlete: Keys, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per athlete with each part as an ordered array of its rows: pages of all athletes at once."""
    out = None
    for name, df in parts.items():
        rows = df.groupBy(*athlete).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in athlete]))).alias(name))
        out = rows if out is None else out.join(rows, athlete, "full")
    return out


def with_flags(df: DataFrame, flags: DataFrame, keys: Keys) -> DataFrame:
    """Availability columns added; no row is dropped."""
    own = flags.groupBy(*keys).agg(F.max(F.struct("status", "reason")).alias("_f"))
    return df.join(own, keys, "left").withColumns({"flag_status": F.coalesce(F.col("_f.status"), F.lit("ok")), "flag_reason": F.col("_f.reason")}).drop("_f")


def called_events(scored: DataFrame, event: Keys, score: str, least: int = 3) -> DataFrame:
    """How an event is called: by the model where enough of its entrants are scored, else by points."""
    n = scored.groupBy(*event).agg(F.count(score).alias("_n"))
    return scored.join(n, event).withColumn("called_by", F.when(F.col("_n") >= least, "model").otherwise("points")).drop("_n")


def ranked_by_points(df: DataFrame, event: Keys, score: str, area_rank: str, tiebreak: str) -> DataFrame:
    return df.withColumn("points_rank", F.row_number().over(Window.partitionBy(*event).orderBy(F.desc_nulls_last(score), F.asc_nulls_last(area_rank), tiebreak)))


def two_orders(df: DataFrame, group: Keys, score: str, rating: str, tiebreak: str, limit: int = 20) -> DataFrame:
    """The first by points, with a second rank among them by the model's rating."""
    top = df.withColumn("points_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), tiebreak))).where(F.col("points_rank") <= limit)
    return top.withColumn("rating_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(rating), tiebreak)))


def unranked(entrants: DataFrame, ranked: DataFrame, keys: Keys, reason: Column) -> DataFrame:
    """Entrants that a call does not rank, with the reason."""
    return entrants.join(ranked.select(*keys).distinct(), keys, "left_anti").withColumn("reason", reason)


def event_report(entrants: DataFrame, featured: DataFrame, event: Keys, athlete: str, score: str, model, flags: DataFrame, least: int = 3) -> DataFrame:
    """Each event's call: event, athlete, score, called_by, rank, podium_chance, win_chance, reason.

    Events with `least` scored entrants are called by the model (over featured: the scored entrants with its features), the others by
    points, without chances. Entrants without a score are 'unranked', with the flag's reason or noMark. flags: athlete, status, reason.
    """
    from meetlens.models import plackett_luce as P

    called = called_events(featured, event, score, least)
    by_model = called.where("called_by = 'model'").withColumn("_u", model.utility())
    chances = P.podium_chances(P.win_chances(by_model, event, "_u"), event, "_u")
    order = Window.partitionBy(*event).orderBy(F.desc(F.round("podium_chance", 9)), F.desc(score), athlete)
    columns = [*event, athlete, score, "called_by", "rank", "podium_chance", "win_chance", "reason"]
    none = lambda kind: F.lit(None).cast(kind)
    modelled = chances.withColumns({"rank": F.row_number().over(order), "reason": none("string")}).select(columns)
    points = called.where("called_by = 'points'").withColumn("_a", none("int"))
    pointed = ranked_by_points(points, event, score, "_a", athlete).select(*event, athlete, score, "called_by", F.col("points_rank").alias("rank"), none("double").alias("podium_chance"), none("double").alias("win_chance"), none("string").alias("reason"))
    rest = unranked(entrants, featured, [*event, athlete], F.lit("noMark"))
    flagged = with_flags(rest, flags, [athlete]).select(*event, athlete, score, F.lit("unranked").alias("called_by"), none("int").alias("rank"), none("double").alias("podium_chance"), none("double").alias("win_chance"), F.coalesce("flag_reason", "reason").alias("reason"))
    return modelled.union(pointed).union(flagged)


def qualification_state(race: DataFrame, calendar: DataFrame, group: Keys, name: str, last_day: str, today: Column, is_final: Column) -> DataFrame:
    """The rows of a qualification race with the calendar's state: meetings left before the final, and the next one's name and day."""
    from meetlens.operators.ranking import meeting_status, meetings_left

    stated = meeting_status(calendar, group, last_day, today, is_final, [name])
    state = stated.groupBy(*group).agg(meetings_left("status").alias("meetings_left"), F.max(F.when(F.col("status") == "next", F.struct(F.col(name).alias("meeting"), F.col(last_day).alias("day")))).alias("_n"))
    return race.join(state, group, "left").withColumns({"meetings_left": F.coalesce("meetings_left", F.lit(0)), "next_meeting": F.col("_n.meeting"), "next_day": F.col("_n.day")}).drop("_n")


def preferred(*values: Column, otherwise: float) -> Column:
    """The first of several figures that is a number; failing all, a stated one."""
    return F.coalesce(*(v.try_cast("double") for v in values), F.lit(otherwise))


def removed(flags: DataFrame, evidence: Column) -> DataFrame:
    return flags.where(F.col("status") == "remove").withColumn("reason", evidence)


def document(df: DataFrame, name: str, keys: Keys = ()) -> DataFrame:
    """A report as JSON, one row per key (or one): the form in which routes are served."""
    own = F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])))).alias("value")
    return df.groupBy(*keys).agg(own).withColumn("report", F.lit(name))


def project_final_mark(features: DataFrame, fingerprints: DataFrame, keys: Keys, best: str, higher_is_better: bool, penalty: float = 0.02, most: float = 0.03) -> DataFrame:
    """Season best moved by the late form (clipped to a share), past the peak a penalty; unknown athletes take the mean."""
    mean = fingerprints.agg(F.avg("late_form").alias("_late"), F.avg("peak_week").alias("_peak"))
    rows = features.join(fingerprints.select(*keys, "late_form", "peak_week"), keys, "left").crossJoin(F.broadcast(mean))
    late, peak = F.coalesce("late_form", "_late"), F.coalesce("peak_week", "_peak")
    share = F.greatest(F.lit(-most), F.least(F.lit(most), late / F.col(best))) - F.when(F.col("week") > peak, penalty * (1 if higher_is_better else -1)).otherwise(0.0)
    return rows.withColumn("projected", F.col(best) * (1 + share)).drop("_late", "_peak")
