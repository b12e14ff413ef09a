"""Ranks, top-k, trends and other windows. Every order is total: ties end at the given tiebreak columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.functions.marks import col
from meetlens.operators.order import with_standing

Keys = list[str]


def directed(value: str | Column, higher_is_better: bool | Column) -> Column:
    """The value, negated where lower is better, so that larger is always better."""
    if isinstance(higher_is_better, bool):
        return col(value) if higher_is_better else -col(value)
    return F.when(higher_is_better, col(value)).otherwise(-col(value))


def with_season_rank(df: DataFrame, partition: Keys, value: str, higher_is_better: bool | Column) -> DataFrame:
    """season_rank (1 is best, ties averaged) and percentile: the rank in the other direction as a share of the field.

    Rows without a value have neither, and do not count. Ranks are exact and no group is sorted in one task (order.with_standing).
    """
    good = directed(value, higher_is_better)
    known = with_standing(df.where(good.isNotNull()), partition, good, "_below", "_ties", "_size")
    extra = (F.col("_ties").cast("double") - 1) / 2
    ranked = known.withColumns({"season_rank": (F.col("_size") - F.col("_below") - F.col("_ties") + 1).cast("double") + extra, "percentile": ((F.col("_below") + 1).cast("double") + extra) / F.col("_size")})
    none = F.lit(None).cast("double")
    return ranked.drop("_below", "_ties", "_size").unionByName(df.where(good.isNull()).withColumns({"season_rank": none, "percentile": none}))


def with_min_rank(df: DataFrame, partition: Keys, value: Column, name: str = "min_rank") -> DataFrame:
    """Competition rank in ascending order of value, null first: one more than the rows below."""
    return with_standing(df, partition, value, "_below", "_ties", "_size").withColumn(name, F.col("_below") + 1).drop("_below", "_ties", "_size")


def with_row_number(df: DataFrame, partition: Keys, order: Column, name: str = "rn") -> DataFrame:
    """Places from 1 in ascending order of a value that no two rows of a group share (a struct, say), for groups of any size."""
    return with_min_rank(df, partition, order, name)


def top_k(df: DataFrame, partition: Keys, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each partition; without partition keys, of the table. Spark cuts each task's rows to k before the shuffle."""
    if partition:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)
    few = df.orderBy(*order).limit(k)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_per(df: DataFrame, keys: Keys, order: list[Column]) -> DataFrame:
    """Keep-first de-duplication with a stated order."""
    return top_k(df, keys, order, 1, "_n").drop("_n")


def uniform_depth(df: DataFrame, group: Keys, order: list[Column], depth: int = 100) -> DataFrame:
    """The same depth of list for every group."""
    return top_k(df, group, order, depth, "depth_rank")


def tercile(rank: str | Column, total: str | Column) -> Column:
    """deep, middle or thin by thirds of n; null below three."""
    r, n = col(rank), col(total)
    return F.when(n < 3, None).when(r <= n / 3, "deep").when(r > 2 * n / 3, "thin").otherwise("middle")


def trend(df: DataFrame, keys: Keys, date: str, value: str, higher_is_better: bool, last: int = 3, tiebreak: Keys = ()) -> DataFrame:
    """Per key over its latest races: trend (positive is getting worse; 0 with one race) and how many races it has."""
    w = Window.partitionBy(*keys).orderBy(F.desc(date), *[F.desc(c) for c in tiebreak])
    few = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    ends = few.groupBy(*keys).agg(F.min_by(value, "_n").alias("_new"), F.max_by(value, "_n").alias("_old"), F.count("*").alias("races"))
    change = F.col("_old") - F.col("_new") if higher_is_better else F.col("_new") - F.col("_old")
    return ends.select(*keys, F.when(F.col("races") < 2, F.lit(0.0)).otherwise(change).alias("recent_trend"), "races")


def days_since(df: DataFrame, keys: Keys, date: str, reference: Column, missing: int = 999) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.datediff(reference, F.max(F.to_date(date))), F.lit(missing)).alias("days_since_last"))


def gap_variability(df: DataFrame, keys: Keys, date: str) -> DataFrame:
    """Sample deviation of the days between races; 0 with fewer than three dates."""
    dates = df.select(*keys, F.to_date(date).alias("_d")).where("_d IS NOT NULL").distinct()
    gaps = dates.withColumn("_gap", F.datediff("_d", F.lag("_d").over(Window.partitionBy(*keys).orderBy("_d"))))
    return gaps.groupBy(*keys).agg(F.when(F.count("_gap") >= 2, F.stddev_samp("_gap")).otherwise(F.lit(0.0)).alias("gap_deviation"))


def form_ratio(df: DataFrame, keys: Keys, field: Keys, date: str, value: str, reference: Column, higher_is_better: bool, days: int = 45, missing: int = 999) -> DataFrame:
    """peak_age_days: age of the season's best mark; recent_ratio: the best of the last days against it, over 1 off the peak.

    A key without a recent mark gets its field's median ratio, failing that 1.
    """
    best, at = (F.max, F.max_by) if higher_is_better else (F.min, F.min_by)
    d = F.to_date(date)
    recent = F.when((d >= F.date_sub(reference, days)) & (d <= reference), F.col(value))
    out = df.groupBy(*dict.fromkeys([*field, *keys])).agg(best(value).alias("season_best"), best(recent).alias("_recent"), at(d, F.struct(value, (-F.unix_date(d) if higher_is_better else F.unix_date(d)).alias("_t"))).alias("_peak"))
    ratio = F.col("season_best") / F.col("_recent") if higher_is_better else F.col("_recent") / F.col("season_best")
    out = out.withColumn("_ratio", ratio)
    median = out.groupBy(*field).agg(F.median("_ratio").alias("_median"))
    return out.join(median, field).select(*dict.fromkeys([*field, *keys]), "season_best", F.coalesce(F.datediff(reference, "_peak"), F.lit(missing)).alias("peak_age_days"), F.coalesce("_ratio", "_median", F.lit(1.0)).alias("recent_ratio"))


def recent_form(df: DataFrame, keys: Keys, date: str, tiebreak: Keys, last: int = 6) -> DataFrame:
    """The last races of each key, numbered oldest first."""
    few = top_k(df, keys, [F.desc(date), *[F.desc(c) for c in tiebreak]], last, "_n")
    return few.withColumn("form_no", F.count("*").over(Window.partitionBy(*keys)) - F.col("_n") + 1).drop("_n")


def long_history(df: DataFrame, keys: Keys, month: Keys, order: list[Column], limit: int = 14) -> DataFrame:
    """All races of a key with up to `limit`; else the best of each month."""
    out = df.withColumns({"_all": F.count("*").over(Window.partitionBy(*keys)), "_n": F.row_number().over(Window.partitionBy(*keys, *month).orderBy(*order))})
    return out.where((F.col("_all") <= limit) | (F.col("_n") == 1)).drop("_all", "_n")


def latest_season(df: DataFrame, keys: Keys, season: str) -> DataFrame:
    return df.withColumn("_y", F.max(season).over(Window.partitionBy(*keys))).where(F.col(season) == F.col("_y")).drop("_y")


def meeting_status(df: DataFrame, partition: Keys, last_day: str, today: Column, is_final: Column, tiebreak: Keys) -> DataFrame:
    """done, next (the first that is not done), upcoming, or final."""
    done = F.to_date(last_day) < today
    order = Window.partitionBy(*partition, done).orderBy(last_day, *tiebreak)
    status = F.when(is_final, "final").when(done, "done").when(F.row_number().over(order) == 1, "next").otherwise("upcoming")
    return df.withColumn("status", status)


def meetings_left(status: str | Column) -> Column:
    return F.count_if(col(status).isin("next", "upcoming"))


def favourite(df: DataFrame, group: Keys, chance: str, order: list[Column]) -> DataFrame:
    """The row with the largest chance of each group; ties to the first in order."""
    return first_per(df, group, [F.desc(chance), *order])


def top_winners(df: DataFrame, group: Keys, chance: str, order: list[Column], limit: int = 6) -> DataFrame:
    """Favourites of all groups, the surest first, numbered."""
    return top_k(favourite(df, group, chance, order), [], [F.desc(chance), *order], limit, "list_rank")


def confidence(groups: DataFrame, df: DataFrame, group: Keys, chance: str) -> DataFrame:
    """Each group's largest chance; 0 for a group without rows."""
    top = df.groupBy(*group).agg(F.max(chance).alias("top_chance"))
    return groups.join(top, group, "left").withColumn("top_chance", F.coalesce("top_chance", F.lit(0.0)))


def field_and_near_miss(ranked: DataFrame, qualified: DataFrame, group: Keys, key: Keys, order: list[Column], limit: int, near: int = 4) -> DataFrame:
    """The qualified of each group, or, for a group without standings, its top `limit`; then `near` rows that just missed.

    predicted_rank counts the field only; it is null for a near miss.
    """
    has = qualified.select(*group).distinct().withColumn("_has", F.lit(True))
    marked = ranked.join(qualified.select(*group, *key).distinct().withColumn("_q", F.lit(True)), [*group, *key], "left").join(has, group, "left")
    w = Window.partitionBy(*group).orderBy(*order)
    marked = marked.withColumn("_in", F.when(F.col("_has"), F.coalesce("_q", F.lit(False))).otherwise(F.row_number().over(w) <= limit))
    side = marked.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_in").orderBy(*order)))
    kept = side.where((F.col("_in") & (F.col("_n") <= limit)) | (~F.col("_in") & (F.col("_n") <= near)))
    return kept.withColumns({"in_field": F.col("_in"), "predicted_rank": F.when(F.col("_in"), F.col("_n"))}).drop("_q", "_has", "_in", "_n")


def search(df: DataFrame, text: str, query: str, order: list[Column], limit: int = 25) -> DataFrame:
    """Rows whose text holds the query, any case; a query of one letter finds nothing."""
    hit = F.contains(F.lower(F.col(text)), F.lit(query.lower().strip())) if len(query.strip()) >= 2 else F.lit(False)
    return top_k(df.where(hit), [], order, limit, "position")


def ranked_search(df: DataFrame, code: str, name: str, query: str, order: list[Column], limit: int = 5) -> DataFrame:
    """Exact code first, then names that begin with the query, then those that hold it."""
    q, n = F.lit(query.lower().strip()), F.lower(F.col(name))
    kind = F.when(F.lower(F.col(code)) == q, 0).when(F.startswith(n, q), 1).when(F.contains(n, q), 2)
    return top_k(df.withColumn("match_kind", kind).where("match_kind IS NOT NULL"), [], [F.asc("match_kind"), *order], limit, "position")
