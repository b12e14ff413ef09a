"""Head-to-heads: pairs within a race, rates, matrices, as-of rates and net records against a field's strongest.

Pairs come from an equi self-join on the race key, after each athlete is reduced to its best place, so a race gives as many rows
as it has pairs and nothing is paired across races.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def one_row_per_athlete(df: DataFrame, race: Keys, athlete: str, place: str) -> DataFrame:
    """The best place of each athlete in each race; a null part of a race's key counts as empty text."""
    named = df.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k, t in df.dtypes if k in race and t == "string"})
    return named.where(F.col(place).isNotNull()).groupBy(*race, athlete).agg(F.min(place).alias(place))


def pairwise(df: DataFrame, race: Keys, athlete: str, place: str, carry: Keys = ()) -> DataFrame:
    """athlete_a, athlete_b, a_wins for every ordered pair of a race, without dead heats."""
    one = one_row_per_athlete(df, [*race, *carry], athlete, place)
    a, b = one.withColumnsRenamed({athlete: "athlete_a", place: "_pa"}), one.select(*race, F.col(athlete).alias("athlete_b"), F.col(place).alias("_pb"))
    met = a.join(b, race).where((F.col("athlete_a") != F.col("athlete_b")) & (F.col("_pa") != F.col("_pb")))
    return met.select(*race, *carry, "athlete_a", "athlete_b", (F.col("_pa") < F.col("_pb")).cast("int").alias("a_wins"))


def rates(records: DataFrame, keys: Keys = (), least: int = 1) -> DataFrame:
    """wins, meetings and win_rate of each ordered pair (HAVING meetings >= least)."""
    out = records.groupBy(*keys, "athlete_a", "athlete_b").agg(F.sum("a_wins").cast("long").alias("wins"), F.count("*").alias("meetings"))
    return out.where(F.col("meetings") >= least).withColumn("win_rate", F.col("wins") / F.col("meetings"))


def versus(df: DataFrame, race: Keys, athlete: str, place: str, date: str, who: Column, least: int = 1, opponents: DataFrame | None = None) -> DataFrame:
    """One athlete (or those that meet `who`) against all others: wins, losses, draws, meetings, last meeting, rate in percent.

    Draws count as meetings. opponents: a frame with the column of athletes to keep.
    """
    one = df.where(F.col(place).isNotNull()).groupBy(*race, athlete).agg(F.min(place).alias("_p"), F.max(date).alias("_d"))
    me, other = one.where(who).withColumnsRenamed({athlete: "athlete", "_p": "_mine"}), one.select(*race, F.col(athlete).alias("opponent"), F.col("_p").alias("_theirs"))
    if opponents is not None:
        other = other.join(opponents.select(F.col(opponents.columns[0]).alias("opponent")).distinct(), "opponent", "left_semi")
    met = me.join(other, race).where("athlete <> opponent")
    out = met.groupBy("athlete", "opponent").agg(F.count_if(F.col("_mine") < F.col("_theirs")).alias("wins"), F.count_if(F.col("_mine") > F.col("_theirs")).alias("losses"), F.count_if(F.col("_mine") == F.col("_theirs")).alias("draws"), F.count("*").alias("meetings"), F.max("_d").alias("last_met"))
    return out.where(F.col("meetings") >= least).withColumn("win_rate", F.round(100.0 * F.col("wins") / F.col("meetings"), 1))


#: Shares of a field, by its names' hashes, in which a row of a matrix is made.
SHARES = 64


def matrix(field: DataFrame, pairs: DataFrame, group: Keys, name: str) -> DataFrame:
    """Every ordered pair of each group's field with wins and meetings; null where they never met.

    Cells are as many as pairs of a field, and are made last: those met stand beside an athlete as one array a share of the field, and the
    share's names are laid out over it. So no cell is moved or sorted.
    """
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)).cast("int").alias("__share")
    known = [c for c in group if c in pairs.columns]
    met = pairs.groupBy(*known, "athlete_a", share("athlete_b")).agg(F.collect_list(F.struct("athlete_b", "wins", "meetings")).alias("__met"))
    names = field.where(F.col(name).isNotNull()).groupBy(*group, share(name)).agg(F.collect_list(name).alias("__names"))
    rows = field.select(*group, F.col(name).alias("athlete_a"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("__share"))
    beside = rows.join(met, [*known, "athlete_a", "__share"], "left").join(names, [*group, "__share"])
    cells = beside.select(*group, "athlete_a", "__met", F.explode("__names").alias("athlete_b")).where("athlete_a <> athlete_b")
    found = cells.select(*group, "athlete_a", "athlete_b", F.explode_outer(F.filter("__met", lambda m: m["athlete_b"] == F.col("athlete_b"))).alias("__m"))
    return found.select(*group, "athlete_a", "athlete_b", "__m.wins", "__m.meetings", (F.col("__m.wins") / F.col("__m.meetings")).alias("win_rate"))


def within(field: DataFrame, pairs: DataFrame, group: Keys, name: str) -> DataFrame:
    """The pairs whose two athletes share a field, once for each field."""
    a, b = field.select(*group, F.col(name).alias("athlete_a")), field.select(*group, F.col(name).alias("athlete_b"))
    return a.join(pairs, [*(c for c in group if c in pairs.columns), "athlete_a"]).join(b, [*group, "athlete_b"]).where("athlete_a <> athlete_b")


def matrix_rows(cells: DataFrame, group: Keys) -> DataFrame:
    """Row totals of a matrix, with the row as an array in order of opponents."""
    return cells.groupBy(*group, "athlete_a").agg(F.sum(F.coalesce("wins", F.lit(0))).cast("long").alias("wins"), F.sum(F.coalesce("meetings", F.lit(0))).cast("long").alias("meetings"), F.count("meetings").alias("met"), F.count("*").alias("others"), F.array_sort(F.collect_list(F.struct("athlete_b", "wins", "meetings"))).alias("cells"))


def matrix_coverage(cells: DataFrame, group: Keys) -> DataFrame:
    """Share of a field's pairs that have met, in percent."""
    return cells.groupBy(*group).agg(F.round(100.0 * F.count("meetings") / F.count("*"), 1).alias("coverage"), F.count("*").alias("pairs"))


def coverage(field: DataFrame, pairs: DataFrame, group: Keys, name: str) -> DataFrame:
    """matrix_coverage of the field's matrix, without its cells: the pairs of a field are counted, those met are looked up."""
    named = field.where(F.col(name).isNotNull()).where(" AND ".join(f"`{c}` IS NOT NULL" for c in group) or "true")
    all_pairs = named.groupBy(*group, name).agg(F.count("*").alias("_c")).groupBy(*group).agg((F.sum("_c") * F.sum("_c") - F.sum(F.col("_c") * F.col("_c"))).alias("pairs")).where("pairs > 0")
    met = within(field, pairs, group, name).groupBy(*group).agg(F.count("meetings").alias("_m"))
    return all_pairs.join(met, group, "left").select(*group, F.round(100.0 * F.coalesce("_m", F.lit(0)) / F.col("pairs"), 1).alias("coverage"), "pairs")


def field_mean(field: DataFrame, edges: DataFrame, group: Keys, name: str, never: float = 0.5) -> DataFrame:
    """Each athlete's mean rate against the others of its field; 0.5 where it met none. Only those it met are looked at."""
    met = within(field, edges, group, name).groupBy(*group, "athlete_a").agg(F.avg("win_rate").alias("_m"))
    out = field.select(*group, F.col(name).alias("athlete_a")).join(met, [*group, "athlete_a"], "left")
    return out.select(*group, F.col("athlete_a").alias(name), F.coalesce("_m", F.lit(never)).alias("h2h_mean"))


def as_of_rates(records: DataFrame, cutoffs: DataFrame, keys: Keys, date: str, least: int = 2) -> DataFrame:
    """Rates of each ordered pair before each distinct cut-off of its group; a record on a cut-off's own day comes after it.

    Each record is counted at the first cut-off after it, a running sum per pair carries it on, and a sum is written for the
    cut-offs up to the pair's next record: as many rows as the result has, and no product of records and cut-offs.
    """
    ordered = cutoffs.where("cutoff IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set(F.to_date("cutoff"))).alias("_cuts"))
    rows = records.where(F.col(date).isNotNull())
    rows = rows.join(ordered, keys) if keys else rows.crossJoin(F.broadcast(ordered))
    rows = rows.withColumn("_k", F.size(F.filter("_cuts", lambda c: c <= F.to_date(F.col(date))))).where(F.col("_k") < F.size("_cuts"))
    sums = rows.groupBy(*keys, "athlete_a", "athlete_b", "_k").agg(F.sum("a_wins").alias("_w"), F.count("*").alias("_m"))
    pair = Window.partitionBy(*keys, "athlete_a", "athlete_b").orderBy("_k")
    running = sums.select(*keys, "athlete_a", "athlete_b", "_k", F.sum("_w").over(pair).cast("long").alias("wins"), F.sum("_m").over(pair).alias("meetings"), F.lead("_k").over(pair).alias("_next")).where(F.col("meetings") >= least)
    running = running.join(ordered, keys) if keys else running.crossJoin(F.broadcast(ordered))
    until = F.coalesce("_next", F.size("_cuts"))
    return running.select(*keys, F.explode(F.slice("_cuts", F.col("_k") + 1, until - F.col("_k"))).alias("cutoff"), "athlete_a", "athlete_b", "wins", "meetings", (F.col("wins") / F.col("meetings")).alias("win_rate"))


def top_rivals(field: DataFrame, group: Keys, name: str, score: str, k: int = 3) -> DataFrame:
    """For each athlete of a field its k strongest others, by score desc, then name."""
    rank = Window.partitionBy(*group).orderBy(F.desc(score), name)
    strong = field.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k + 1).select(*group, F.col(name).alias("rival"), "_r")
    pairs = field.select(*group, name).join(strong, group).where(F.col(name) != F.col("rival"))
    own = Window.partitionBy(*group, name).orderBy("_r")
    return pairs.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k).drop("_n", "_r")


def net_against_top(field: DataFrame, places: DataFrame, group: Keys, name: str, score: str, race: Keys, place: str, k: int = 3) -> DataFrame:
    """(wins - losses) / decided meetings of each athlete against its field's k strongest others; 0 if it never met them."""
    rivals = top_rivals(field, group, name, score, k)
    one = one_row_per_athlete(places, race, name, place)
    mine, theirs = one.select(*race, name, F.col(place).alias("_a")), one.select(*race, F.col(name).alias("rival"), F.col(place).alias("_b"))
    met = rivals.join(mine, name).join(theirs, [*race, "rival"])
    net = met.groupBy(*group, name).agg(F.count_if(F.col("_a") < F.col("_b")).alias("_w"), F.count_if(F.col("_a") > F.col("_b")).alias("_l"))
    out = field.select(*group, name).join(net, [*group, name], "left")
    return out.select(*group, name, F.coalesce((F.col("_w") - F.col("_l")) / F.nullif(F.col("_w") + F.col("_l"), F.lit(0)), F.lit(0.0)).alias("h2h_top"))


def qualification(standings: DataFrame, group: Keys, name: str, points: str, rank: str, limit: str, meetings_left: Column, per_meeting: int = 8) -> DataFrame:
    """Cut line, ceiling and status of every standings row.

    above: others already beyond its ceiling; reach: others able to reach its points. out: as many above as there are
    places; safe: fewer can reach it than there are places; else in or chasing by the cut; unknown without points. Counting
    is by ranks over the group's points and ceilings, not by pairs.
    """
    w = Window.partitionBy(*group)
    left = meetings_left * per_meeting
    df = standings.withColumns({"ceiling": F.col(points) + left, "_k": F.row_number().over(w.orderBy(rank, name))})
    df = df.withColumn("cut", F.max(F.when(F.col("_k") == F.col(limit), F.col(points))).over(w))
    marks = df.select(*group, F.col(points).alias("_p"), "ceiling")
    above = _count_above(marks, group, "_p", "ceiling", strict=True).select(*group, F.col("_at").alias("ceiling"), F.col("_n").alias("above"))
    reach = _count_above(marks, group, "ceiling", "_p", strict=False).select(*group, F.col("_at").alias(points), F.col("_n").alias("_reach"))
    out = df.join(above, [*group, "ceiling"], "left").join(reach, [*group, points], "left")
    out = out.withColumn("reach", F.col("_reach") - F.when(F.col("ceiling") >= F.col(points), 1).otherwise(0))
    status = F.when(F.col(points).isNull(), "unknown").when(F.col("above") >= F.col(limit), "out").when(F.col("reach") < F.col(limit), "safe").when(F.col("_k") <= F.col(limit), "in").otherwise("chasing")
    return out.withColumns({"status": status, "gap": F.round(F.col("cut") - F.col(points), 2)}).drop("_k", "_reach")


def _count_above(df: DataFrame, group: Keys, value: str, at: str, strict: bool) -> DataFrame:
    """For each distinct value of `at` in a group, how many rows have `value` above (or from) it: one sorted running count."""
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"), F.lit(1).alias("_c"), F.lit(0).alias("_probe"))
    probes = df.where(F.col(at).isNotNull()).select(*group, F.col(at).alias("_v"), F.lit(0).alias("_c"), F.lit(1).alias("_probe")).distinct()
    w = Window.partitionBy(*group).orderBy(F.desc("_v"), (F.desc if strict else F.asc)("_probe")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.union(probes).withColumn("_n", F.sum("_c").over(w)).where("_probe = 1").select(*group, F.col("_v").alias("_at"), "_n")


def double_entries(entries: DataFrame, athlete: str, event: str, slots: str) -> DataFrame:
    """Pairs of one athlete's events whose timetable slots overlap."""
    a, b = entries.select(athlete, F.col(event).alias("event_a"), F.col(slots).alias("_sa")), entries.select(athlete, F.col(event).alias("event_b"), F.col(slots).alias("_sb"))
    return a.join(b, athlete).where((F.col("event_a") < F.col("event_b")) & F.arrays_overlap("_sa", "_sb")).select(athlete, "event_a", "event_b")
