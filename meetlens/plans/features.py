"""Bests, ranks, form and season queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlens.functions import marks
from meetlens.operators import aggregates as A
from meetlens.operators import ranking as R
from meetlens.plans.base import PLACED_SQL, TOTALS_SQL, placed, query, runs, totals


def day(text="1998-01-01"):
    return F.lit(text).cast("date")


@query("SELECT l_suppkey AS athlete, min(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def best_per_entity_asc(t):
    return A.best_per_group(t("lineitem").withColumnRenamed("l_suppkey", "athlete"), ["athlete"], "l_extendedprice", False)


@query("SELECT l_suppkey AS athlete, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def best_per_entity_desc(t):
    return A.best_per_group(t("lineitem").withColumnRenamed("l_suppkey", "athlete"), ["athlete"], "l_extendedprice", True)


FINALS_SQL = "finals AS (SELECT tier, y, max(d) AS cutoff FROM runs WHERE month(d) <= 9 GROUP BY 1, 2)"


def finals(t):
    return runs(t).where(F.month("d") <= 9).groupBy("tier", "y").agg(F.max("d").alias("cutoff"))


@query(f"""WITH {PLACED_SQL}, {FINALS_SQL},
x AS (SELECT f.tier, f.y, f.cutoff, r.athlete, r.v, r.y AS ry FROM runs r JOIN finals f USING (tier) WHERE r.d < f.cutoff AND r.y <= f.y),
g AS (SELECT tier, y, cutoff, athlete, max(CASE WHEN ry = y THEN v END) AS season_best, max(v) AS career_best, max(CASE WHEN ry = y - 1 THEN v END) AS last_best,
 count(CASE WHEN ry = y THEN 1 END) AS meets, coalesce(stddev_samp(CASE WHEN ry = y THEN v END), 0) AS deviation FROM x GROUP BY 1, 2, 3, 4)
SELECT tier, y, cutoff, athlete, season_best, career_best, last_best, meets, round(deviation, 4) AS deviation,
 round(abs(season_best - career_best), 4) AS pb_gap, round(coalesce(season_best - last_best, 0), 4) AS year_on_year FROM g WHERE meets > 0""")
def career_and_season_best(t):
    out = A.season_features(runs(t).select("tier", "athlete", "v", "d", "y"), finals(t), ["tier"], ["athlete"], True, "d", "y", "v")
    return out.withColumns({c: F.round(c, 4) for c in ("deviation", "pb_gap", "year_on_year")})


@query(f"""WITH {TOTALS_SQL}, b AS (SELECT grp, y, athlete, min(v) AS sb FROM totals GROUP BY 1, 2, 3)
SELECT grp, y, athlete, sb, CAST(rank() OVER (PARTITION BY grp, y ORDER BY sb) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY grp, y, sb) AS DOUBLE) - 1) / 2 AS season_rank,
 round((CAST(rank() OVER (PARTITION BY grp, y ORDER BY sb DESC) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY grp, y, sb) AS DOUBLE) - 1) / 2) / count(*) OVER (PARTITION BY grp, y), 6) AS percentile FROM b""")
def season_rank_percentile(t):
    b = totals(t).groupBy("grp", "y", "athlete").agg(F.min("v").alias("sb"))
    return R.with_season_rank(b, ["grp", "y"], "sb", False).withColumn("percentile", F.round("percentile", 6))


@query("SELECT o_orderpriority AS grp, o_orderkey AS id, rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC) AS min_rank FROM orders")
def min_rank(t):
    o = t("orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return R.with_min_rank(o, ["grp"], -F.round(F.col("o_totalprice") / 1000)).drop("o_totalprice")


@query(f"""WITH {TOTALS_SQL}, b AS (SELECT grp, athlete, max(v) AS v FROM totals GROUP BY 1, 2)
SELECT grp, athlete, v, round(coalesce((max(v) OVER w - v) / nullif(stddev_samp(v) OVER w, 0), 0), 6) AS field_gap FROM b WINDOW w AS (PARTITION BY grp)""")
def field_gap(t):
    b = totals(t).groupBy("grp", "athlete").agg(F.max("v").alias("v"))
    return A.field_gap(b, ["grp"], "v", True).withColumn("field_gap", F.round("field_gap", 6))


@query("""SELECT p_brand AS grp, p_partkey AS id, p_retailprice AS v, n AS depth_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 20""")
def uniform_depth_topk(t):
    p = t("part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return R.uniform_depth(p, ["grp"], [F.desc("v"), F.asc("id")], 20)


@query(f"WITH {TOTALS_SQL} SELECT id, grp, v, row_number() OVER (ORDER BY v DESC, id) AS rn FROM totals ORDER BY v DESC, id LIMIT 40")
def top_n_performances(t):
    return R.top_k(totals(t).select("id", "grp", "v"), [], [F.desc("v"), F.asc("id")], 40)


@query("""SELECT o_orderpriority AS grp, count(*) AS n, CAST(floor(quantile_cont(o_totalprice, 0.5)) AS BIGINT) AS median_score, max(o_totalprice) AS top_score, min(o_totalprice) AS low_score,
round(avg(CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END), 4) AS indoor_share FROM orders GROUP BY 1""")
def discipline_depth_stats(t):
    return A.depth_stats(t("orders").withColumnRenamed("o_orderpriority", "grp"), ["grp"], "o_totalprice", F.col("o_orderstatus") == "O")


@query("""WITH p AS (SELECT c_mktsegment AS grp, max(c_acctbal) * 0.75 AS probe FROM customer GROUP BY 1)
SELECT grp, probe, round(100e0 * (SELECT count(*) FROM customer WHERE c_acctbal <= probe) / (SELECT count(*) FROM customer), 4) AS overall_percentile,
 round(100e0 * (SELECT count(*) FROM customer WHERE c_acctbal <= probe AND c_mktsegment = grp) / (SELECT count(*) FROM customer WHERE c_mktsegment = grp), 4) AS group_percentile FROM p""")
def score_context_percentiles(t):
    c = t("customer").withColumnRenamed("c_mktsegment", "grp")
    return A.score_context(c, ["grp"], "c_acctbal", c.groupBy("grp").agg((F.max("c_acctbal") * 0.75).alias("probe")))


@query(f"""WITH {TOTALS_SQL}, b AS (SELECT grp, athlete, max(v) AS v FROM totals GROUP BY 1, 2),
f AS (SELECT *, v / sum(v) OVER (PARTITION BY grp) AS chance FROM b), g AS (SELECT *, lead(chance) OVER (PARTITION BY grp ORDER BY chance DESC, athlete) AS nx, row_number() OVER (PARTITION BY grp ORDER BY chance DESC, athlete) AS k FROM f),
s AS (SELECT grp, round(max(v) - min(v), 4) AS spread, round(median(v), 4) AS median_score, round(max(CASE WHEN k = 1 THEN chance - nx END), 9) AS chance_gap, count(*) AS n FROM g GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY spread, grp) AS depth_rank, CASE WHEN count(*) OVER () < 3 THEN NULL WHEN row_number() OVER (ORDER BY spread, grp) <= count(*) OVER () / 3e0 THEN 'deep'
 WHEN row_number() OVER (ORDER BY spread, grp) > 2 * count(*) OVER () / 3e0 THEN 'thin' ELSE 'middle' END AS verdict FROM s""")
def depth_index(t):
    b = totals(t).groupBy("grp", "athlete").agg(F.max("v").alias("v"))
    totals_ = b.groupBy("grp").agg(F.sum("v").alias("s"), F.count("*").alias("_c"))
    f = b.join(totals_, "grp").withColumn("chance", F.col("v") / F.col("s"))
    out = A.depth_index(f, ["grp"], "v", "athlete", "chance").drop("best_athlete")
    out = out.withColumns({"spread": F.round("spread", 4), "median_score": F.round("median_score", 4), "chance_gap": F.round("chance_gap", 9)})
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("_n")))).withColumn("verdict", R.tercile("depth_rank", "_n")).drop("_n")


@query("""SELECT count(*) AS n_rows, count(DISTINCT year(l_shipdate)) AS seasons, count(DISTINCT l_suppkey) AS venues, count(DISTINCT (l_suppkey, CAST(l_shipdate AS DATE))) AS venue_days FROM lineitem""")
def corpus_counts(t):
    return A.corpus_counts(t("lineitem"), F.year("l_shipdate"), "l_suppkey", F.to_date("l_shipdate"))


RECORD = "count(*) AS races, count(CASE WHEN place = 1 THEN 1 END) AS wins, count(CASE WHEN place <= 3 THEN 1 END) AS podiums, round(count(CASE WHEN place = 1 THEN 1 END) * 100e0 / count(*), 1) AS win_rate, round(count(CASE WHEN place <= 3 THEN 1 END) * 100e0 / count(*), 1) AS podium_rate, round(avg(place), 4) AS mean_place, min(place) AS best_place"


@query(f"WITH {PLACED_SQL} SELECT athlete, tier, y, {RECORD}, grouping(tier) AS all_tier, grouping(y) AS all_y FROM runs GROUP BY GROUPING SETS ((athlete), (athlete, tier), (athlete, y))")
def competition_record(t):
    return A.competition_record(runs(t), ["athlete"], ["tier", "y"])


@query(f"WITH {PLACED_SQL} SELECT athlete, tier, {RECORD} FROM runs GROUP BY 1, 2")
def record_by_tier(t):
    return A.competition_record(runs(t), ["athlete"], ["tier"]).where("all_tier = 0").drop("all_tier")


@query(f"WITH {PLACED_SQL} SELECT athlete, y, {RECORD} FROM runs GROUP BY 1, 2")
def record_by_season(t):
    return A.competition_record(runs(t), ["athlete"], ["y"]).where("all_y = 0").drop("all_y")


@query(f"""WITH {PLACED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY athlete, y ORDER BY v DESC) AS n FROM runs)
SELECT athlete, y, count(*) AS races, max(v) AS best, round(avg(CASE WHEN n <= 3 THEN v END), 4) AS mean_of_best, round(median(v), 4) AS median,
 round(CASE WHEN count(*) >= 3 THEN stddev_pop(v) / avg(v) * 100 END, 4) AS variation, round(max(v) - min(v), 4) AS range FROM k GROUP BY 1, 2""")
def form_by_season(t):
    out = A.form_by_season(runs(t), ["athlete", "y"], "v", True)
    return out.withColumns({c: F.round(c, 4) for c in ("mean_of_best", "median", "variation", "range")})


@query(f"""WITH {PLACED_SQL}, m AS (SELECT athlete, y, month(d) AS month, count(*) AS races, max(v) AS month_best, min(d) AS first_day, max(d) AS last_day FROM runs GROUP BY 1, 2, 3)
SELECT *, first_value(month) OVER (PARTITION BY athlete, y ORDER BY month_best DESC, month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_month,
 CAST(sum(races) OVER (PARTITION BY athlete, y) AS BIGINT) AS season_races, min(first_day) OVER (PARTITION BY athlete, y) AS season_first, max(last_day) OVER (PARTITION BY athlete, y) AS season_last FROM m""")
def season_shape_months(t):
    return A.season_shape(runs(t), ["athlete", "y"], "d", "v", True)


@query("""SELECT user_id, event_id, value, n - k + 1 AS form_no FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6)""")
def recent_form_last6(t):
    return R.recent_form(t("events"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "value", "form_no")


@query("""WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(value, n) - arg_min(value, n) END, 6) AS recent_trend, count(*) AS races FROM k WHERE n <= 3 GROUP BY 1""")
def recent_trend3(t):
    return R.trend(t("events"), ["user_id"], "ts", "value", True, 3, ["event_id"]).withColumn("recent_trend", F.round("recent_trend", 6))


@query(f"""WITH {PLACED_SQL} SELECT s_suppkey AS athlete, coalesce(date_diff('day', max(d), DATE '1998-01-01'), 999) AS days_since_last FROM supplier LEFT JOIN runs ON athlete = s_suppkey AND d < DATE '1998-01-01' GROUP BY 1""")
def days_since_last(t):
    before = runs(t).where(F.col("d") < day()).select("athlete", "d")
    return R.days_since(t("supplier").select(F.col("s_suppkey").alias("athlete")).join(before, "athlete", "left"), ["athlete"], "d", day())


@query(f"""WITH {PLACED_SQL}, x AS (SELECT DISTINCT athlete, y, d FROM runs), g AS (SELECT athlete, y, date_diff('day', lag(d) OVER (PARTITION BY athlete, y ORDER BY d), d) AS gap FROM x)
SELECT athlete, y, round(CASE WHEN count(gap) >= 2 THEN stddev_samp(gap) ELSE 0 END, 6) AS gap_deviation FROM g GROUP BY 1, 2""")
def gap_variability(t):
    return R.gap_variability(runs(t), ["athlete", "y"], "d").withColumn("gap_deviation", F.round("gap_deviation", 6))


@query(f"""WITH {PLACED_SQL}, g AS (SELECT tier, athlete, max(v) AS season_best, max(CASE WHEN d BETWEEN DATE '1998-01-01' - 45 AND DATE '1998-01-01' THEN v END) AS recent, arg_max(d, (v, -epoch(CAST(d AS TIMESTAMP)))) AS peak FROM runs WHERE y = 1997 GROUP BY 1, 2),
r AS (SELECT *, season_best / recent AS ratio FROM g)
SELECT tier, athlete, season_best, coalesce(date_diff('day', peak, DATE '1998-01-01'), 999) AS peak_age_days, round(coalesce(ratio, median(ratio) OVER (PARTITION BY tier), 1), 6) AS recent_ratio FROM r""")
def peak_age_and_recent_ratio(t):
    out = R.form_ratio(runs(t).where("y = 1997"), ["athlete"], ["tier"], "d", "v", day(), True)
    return out.withColumn("recent_ratio", F.round("recent_ratio", 6))


WEIGHTS = [("URGENT", 1.3), ("HIGH", 1.2)]


@query(f"WITH {TOTALS_SQL} SELECT athlete, round(min(v / CASE WHEN grp LIKE '%URGENT%' THEN 1.3e0 WHEN grp LIKE '%HIGH%' THEN 1.2e0 ELSE 1e0 END), 4) AS weighted_best FROM totals GROUP BY 1")
def weighted_best(t):
    return A.weighted_best(totals(t), ["athlete"], "v", marks.in_order("grp", WEIGHTS, 1.0), False).withColumn("weighted_best", F.round("weighted_best", 4))


@query("""SELECT l_suppkey AS athlete, round(min(CASE WHEN l_quantity / 10 <= 1 THEN l_extendedprice ELSE l_extendedprice + (l_quantity / 10 - 1) * 0.01e0 END), 6) AS track_best,
round(max(CASE WHEN l_quantity / 10 <= 1 THEN l_extendedprice ELSE l_extendedprice - (l_quantity / 10 - 1) * 0.01e0 END), 6) AS field_best FROM lineitem GROUP BY 1""")
def directional_adjusted_best(t):
    wind = F.col("l_quantity") / 10
    adjusted = lambda is_field: marks.wind_adjusted("l_extendedprice", wind, F.lit(is_field))
    return t("lineitem").groupBy(F.col("l_suppkey").alias("athlete")).agg(F.round(F.min(adjusted(False)), 6).alias("track_best"), F.round(F.max(adjusted(True)), 6).alias("field_best"))


@query(f"""WITH {TOTALS_SQL}, s AS (SELECT athlete, y, max(v) AS season_best FROM totals GROUP BY 1, 2)
SELECT a.athlete, a.y, a.season_best, b.season_best AS last_best, round(coalesce(a.season_best - b.season_best, 0), 4) AS year_on_year FROM s a LEFT JOIN s b ON a.athlete = b.athlete AND b.y = a.y - 1""")
def year_over_year(t):
    return A.year_over_year(totals(t), ["athlete"], "y", "v", True).withColumn("year_on_year", F.round("year_on_year", 4))


@query(f"""WITH {PLACED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY v DESC) AS n FROM runs WHERE d < DATE '1997-09-01')
SELECT athlete, round(avg(CASE WHEN n <= 3 THEN v END), 4) AS form_score, round(coalesce(stddev_samp(CASE WHEN n <= 3 THEN v END), 0), 4) AS form_spread, max(CASE WHEN d >= DATE '1997-09-01' - 42 THEN v END) AS recent_score,
 count(*) AS races, least(count(CASE WHEN tier LIKE '1%' AND place <= 3 THEN 1 END), 5) AS big_podiums FROM b GROUP BY 1""")
def race_summary_topk(t):
    out = A.race_summary(runs(t), ["athlete"], "d", "v", F.lit("1997-09-01").cast("date"), F.col("tier").startswith("1"), "place")
    return out.withColumns({c: F.round(c, 4) for c in ("form_score", "form_spread")})


@query(f"""WITH {PLACED_SQL} SELECT athlete, max(v) AS career_best, max(CASE WHEN y = 1996 THEN v END) AS prev_best, max(CASE WHEN y = 1995 THEN v END) AS two_ago_best,
 max(CASE WHEN y <= 1994 THEN v END) AS older_best, arg_max(CASE WHEN y <= 1994 THEN y END, CASE WHEN y <= 1994 THEN (v, y) END) AS older_year FROM runs WHERE y < 1997 GROUP BY 1""")
def earlier_bests_by_age(t):
    return A.earlier_bests(runs(t), ["athlete"], "y", "v", F.lit(1997))


@query("""WITH m AS (SELECT user_id, event_id, value, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY value DESC, event_id) AS k FROM events)
SELECT user_id, event_id, value FROM m WHERE n <= 14 OR k = 1""")
def monthly_best_when_long(t):
    e = t("events").withColumn("m", F.date_trunc("day", "ts"))
    return R.long_history(e, ["user_id"], ["m"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "value")


@query("""WITH s AS (SELECT l_suppkey AS athlete, year(l_shipdate) AS y, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS v, l_returnflag = 'R' AS indoor FROM lineitem), o AS (SELECT athlete, y, d, v, bool_or(indoor) AS indoor FROM s GROUP BY 1, 2, 3, 4)
SELECT athlete, y, max(v) AS best, count(*) AS races, count(CASE WHEN indoor THEN 1 END) AS indoor_races FROM o GROUP BY 1, 2""")
def career_progression(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("athlete"), F.year("l_shipdate").alias("y"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("indoor"), "l_linestatus")
    parts = [rows.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("O", "F")]
    return A.career_progression(parts, ["athlete"], "y", "d", "v", True)


@query(f"""WITH {PLACED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY athlete, y ORDER BY d, v) AS a, row_number() OVER (PARTITION BY athlete, y ORDER BY d DESC, v DESC) AS z, count(*) OVER (PARTITION BY athlete, y) AS n FROM runs)
SELECT athlete, y, count(*) AS races, round(max(v) - max(CASE WHEN a = 1 THEN v END), 4) AS improvement, round(avg(CASE WHEN a <= 3 THEN v END), 4) AS early_mean, round(avg(CASE WHEN z <= 3 THEN v END), 4) AS late_mean FROM k WHERE n >= 3 GROUP BY 1, 2""")
def season_trajectory(t):
    out = A.trajectory(runs(t), ["athlete", "y"], "d", "v", True).drop("peak_week")
    return out.withColumns({c: F.round(c, 4) for c in ("improvement", "early_mean", "late_mean")})


@query(f"""WITH {PLACED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY athlete, y ORDER BY d, v) AS a, row_number() OVER (PARTITION BY athlete, y ORDER BY d DESC, v DESC) AS z, count(*) OVER (PARTITION BY athlete, y) AS n FROM runs),
s AS (SELECT athlete, y, max(v) - max(CASE WHEN a = 1 THEN v END) AS improvement, avg(CASE WHEN z <= 3 THEN v END) - avg(CASE WHEN a <= 3 THEN v END) AS late FROM k WHERE n >= 3 GROUP BY 1, 2)
SELECT athlete, count(*) AS seasons, round(avg(improvement), 4) AS improvement, round(avg(late), 4) AS late_form FROM s GROUP BY 1""")
def peaking_fingerprint(t):
    out = A.fingerprints(A.trajectory(runs(t), ["athlete", "y"], "d", "v", True), ["athlete"]).drop("peak_week")
    return out.withColumns({c: F.round(c, 4) for c in ("improvement", "late_form")})


@query(f"""WITH {PLACED_SQL}, x AS (SELECT *, max(y) OVER (PARTITION BY athlete) AS last FROM runs) SELECT athlete, round(coalesce(stddev_samp(v), 0), 4) AS season_deviation FROM x WHERE y = last GROUP BY 1""")
def latest_season_deviation(t):
    return A.latest_season_deviation(runs(t), ["athlete"], "y", "v").withColumn("season_deviation", F.round("season_deviation", 4))


@query("SELECT s_suppkey AS athlete, count(l_orderkey) AS meets FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1")
def meets_from_log(t):
    log = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("athlete"))
    return A.event_counts(t("supplier").select(F.col("s_suppkey").alias("athlete")), log, ["athlete"], "athlete")


@query(f"WITH {PLACED_SQL}, x AS (SELECT *, max(y) OVER (PARTITION BY athlete) AS last FROM runs) SELECT race, athlete, v FROM x WHERE y = last")
def latest_season_results(t):
    return R.latest_season(runs(t), ["athlete"], "y").select("race", "athlete", "v")


@query("""WITH a AS (SELECT l_suppkey AS athlete, count(*) AS races, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_suppkey AS athlete, count(*) AS races, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.athlete, b.athlete) AS athlete, greatest(a.races, b.races) AS races, greatest(a.last, b.last) AS last, date_diff('day', greatest(a.last, b.last), DATE '1999-01-01') AS days_since FROM a FULL JOIN b ON a.athlete = b.athlete""")
def season_activity(t):
    side = lambda s: t("lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("athlete")).agg(F.count("*").alias("races"), F.max(F.to_date("l_shipdate")).alias("last"))
    return A.activity(side("F"), side("O"), ["athlete"], F.lit("1999-01-01").cast("date"))


@query(f"""WITH {PLACED_SQL}, {FINALS_SQL} SELECT f.tier, f.y, f.cutoff, count(*) AS n_rows, max(r.v) AS best FROM finals f JOIN runs r ON r.tier = f.tier AND r.d < f.cutoff GROUP BY 1, 2, 3""")
def pooled_before_cutoff(t):
    from meetlens.operators.joins import pooled

    rows = pooled(runs(t).select("tier", "v", "d"), finals(t), ["tier"], "d")
    return rows.groupBy("tier", "y", "cutoff").agg(F.count("*").alias("n_rows"), F.max("v").alias("best"))


@query(f"WITH {PLACED_SQL}, f AS (SELECT race, place, min(athlete) AS athlete FROM placed WHERE place BETWEEN 1 AND 3 GROUP BY 1, 2) SELECT race, place, athlete FROM f WHERE race IN (SELECT race FROM f GROUP BY 1 HAVING count(*) = 3)")
def complete_podiums(t):
    return A.complete_podiums(placed(t).select("race", "place", "athlete"), ["race"], "place", "athlete")


@query("""SELECT source, lang, count(DISTINCT d.doc_id % 7) AS n_groups, count(*) AS n_rows, round(avg(CASE WHEN quality IS NOT NULL THEN 1e0 ELSE 0e0 END), 4) AS share_scored,
 round(avg(CASE WHEN n_chars > 2000 THEN CASE WHEN quality IS NOT NULL THEN 1e0 ELSE 0e0 END END), 4) AS podium_share, round(avg(CASE WHEN quality IS NOT NULL THEN 1e0 ELSE 0e0 END), 4) >= 0.85 AS gate_met FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def coverage_report(t):
    d = t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("g", F.col("doc_id") % 7)
    return A.coverage(d, ["source", "lang"], "g", F.col("quality").isNotNull(), F.col("n_chars") > 2000)
