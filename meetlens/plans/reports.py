"""Report and model queries over the driver's tables: winners, comparisons, calibration, chances, stories, directories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlens.models import evaluation as E
from meetlens.models import forest
from meetlens.models import plackett_luce as P
from meetlens.operators import aggregates as A
from meetlens.operators import ranking as R
from meetlens.operators import reports as Q
from meetlens.plans.base import PLACED_SQL, TOTALS_SQL, query, runs, totals

# Groups and chances: customers of a priority, by their share of its best prices.

CHANCE_SQL = f"{TOTALS_SQL}, bests AS (SELECT grp, athlete, max(v) AS v FROM totals GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC, athlete) AS n FROM bests), field AS (SELECT grp, athlete, v, n, v / sum(v) OVER (PARTITION BY grp) AS chance FROM ranked WHERE n <= 8)"


def field(t):
    """grp, athlete, v, n, chance: the eight best of each group."""
    b = totals(t).groupBy("grp", "athlete").agg(F.max("v").alias("v"))
    top = R.top_k(b, ["grp"], [F.desc("v"), F.asc("athlete")], 8, "n")
    return top.withColumn("chance", F.col("v") / F.sum("v").over(Window.partitionBy("grp")))


@query(f"WITH {CHANCE_SQL} SELECT grp, athlete, round(chance, 6) AS chance FROM field WHERE n = 1")
def favourite_per_group(t):
    return R.favourite(field(t), ["grp"], "chance", [F.asc("athlete")]).select("grp", "athlete", F.round("chance", 6).alias("chance"))


@query(f"WITH {CHANCE_SQL} SELECT grp, athlete, round(chance, 6) AS chance, row_number() OVER (ORDER BY chance DESC, athlete) AS list_rank FROM field WHERE n = 1 ORDER BY list_rank LIMIT 3")
def top_winners(t):
    return R.top_winners(field(t), ["grp"], "chance", [F.asc("athlete")], 3).select("grp", "athlete", F.round("chance", 6).alias("chance"), "list_rank")


@query(f"WITH {CHANCE_SQL}, g AS (SELECT DISTINCT o_orderpriority AS grp FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer) SELECT g.grp, round(coalesce(max(chance), 0), 6) AS top_chance FROM g LEFT JOIN field USING (grp) GROUP BY 1")
def confidence(t):
    g = t("orders").select(F.col("o_orderpriority").alias("grp")).union(t("customer").select("c_mktsegment")).distinct()
    return R.confidence(g, field(t), ["grp"], "chance").withColumn("top_chance", F.round("top_chance", 6))


@query(f"""WITH {TOTALS_SQL}, b AS (SELECT grp, athlete, max(v) AS v FROM totals GROUP BY 1, 2), q AS (SELECT DISTINCT grp, athlete, TRUE AS q FROM totals WHERE athlete % 50 = 0 AND grp LIKE '1%'), h AS (SELECT DISTINCT grp, TRUE AS has FROM q),
m AS (SELECT b.*, CASE WHEN has THEN coalesce(q, FALSE) ELSE row_number() OVER (PARTITION BY grp ORDER BY v DESC, athlete) <= 6 END AS in_field FROM b LEFT JOIN q USING (grp, athlete) LEFT JOIN h USING (grp)), k AS (SELECT *, row_number() OVER (PARTITION BY grp, in_field ORDER BY v DESC, athlete) AS n FROM m)
SELECT grp, athlete, v, in_field, CASE WHEN in_field THEN n END AS predicted_rank FROM k WHERE (in_field AND n <= 6) OR (NOT in_field AND n <= 4)""")
def fallback_field_and_near_miss(t):
    x = totals(t)
    q = x.where("athlete % 50 = 0").where(F.col("grp").startswith("1")).select("grp", "athlete").distinct()
    return R.field_and_near_miss(x.groupBy("grp", "athlete").agg(F.max("v").alias("v")), q, ["grp"], ["athlete"], [F.desc("v"), F.asc("athlete")], 6)


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS last_day FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) IN (5, 6)), d AS (SELECT *, last_day < DATE '1996-06-01' AS done FROM m)
SELECT id, grp, last_day, CASE WHEN id % 97 = 0 THEN 'final' WHEN done THEN 'done' WHEN row_number() OVER (PARTITION BY grp, done ORDER BY last_day, id) = 1 THEN 'next' ELSE 'upcoming' END AS status FROM d""")
def meeting_status(t):
    o = t("orders").where((F.year("o_orderdate") == 1996) & F.month("o_orderdate").isin(5, 6)).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.to_date("o_orderdate").alias("last_day"))
    return R.meeting_status(o, ["grp"], "last_day", F.lit("1996-06-01").cast("date"), F.col("id") % 97 == 0, ["id"])


# A call at half season against the season's end.

CALL_SQL = f"""{TOTALS_SQL}, c AS (SELECT grp, athlete, row_number() OVER (PARTITION BY grp ORDER BY max(v) DESC, athlete) AS predicted FROM totals WHERE y = 1996 AND month(d) <= 6 GROUP BY 1, 2),
a AS (SELECT grp, athlete, CASE WHEN athlete % 41 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY grp ORDER BY max(v) DESC, athlete) END AS place FROM totals WHERE y = 1996 GROUP BY 1, 2)"""


def _call(t):
    x = totals(t).where("y = 1996")
    rank = lambda d, name: d.groupBy("grp", "athlete").agg(F.max("v").alias("v")).withColumn(name, F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("v"), "athlete"))).drop("v")
    call, actual = rank(x.where(F.month("d") <= 6), "predicted"), rank(x, "place")
    return call, actual.withColumn("place", F.when(F.col("athlete") % 41 != 0, F.col("place")))


@query(f"""WITH {CALL_SQL} SELECT a.grp, a.athlete, a.place, CASE WHEN a.place IS NULL THEN 'dnf' ELSE 'finished' END AS status, c.predicted, CASE WHEN c.predicted IS NULL THEN 'unseen' WHEN c.predicted <= 8 THEN 'field' ELSE 'near_miss' END AS state, c.predicted - a.place AS delta FROM a LEFT JOIN c ON c.grp = a.grp AND c.athlete = a.athlete WHERE a.place <= 10 OR a.place IS NULL""")
def result_comparison(t):
    call, actual = _call(t)
    return Q.compare(actual.where("place <= 10 OR place IS NULL"), call, ["grp"], "athlete", "place", "predicted", 8)


@query(f"""WITH {CALL_SQL}, j AS (SELECT a.grp, a.athlete, a.place, c.predicted FROM a LEFT JOIN c ON c.grp = a.grp AND c.athlete = a.athlete)
SELECT grp, count(CASE WHEN predicted <= 3 AND place <= 3 THEN 1 END) AS hits, count(CASE WHEN place <= 3 THEN 1 END) AS possible, max(CASE WHEN predicted = 1 AND place = 1 THEN 1 ELSE 0 END)::BIGINT AS winner_named FROM j GROUP BY 1""")
def podium_hits(t):
    call, actual = _call(t)
    return E.hits(actual.join(call, ["grp", "athlete"], "left"), ["grp"], "predicted", "place")


CALLED_SQL = f"{PLACED_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY athlete % 13, athlete) AS called FROM runs)"


def _called(t):
    return runs(t).withColumn("called", F.row_number().over(Window.partitionBy("race").orderBy(F.col("athlete") % 13, "athlete")))


@query(f"""WITH {CALLED_SQL}, h AS (SELECT race, tier, y, count(CASE WHEN called <= 3 AND place <= 3 THEN 1 END) AS hits, count(CASE WHEN place <= 3 THEN 1 END) AS possible, max(CASE WHEN called = 1 AND place = 1 THEN 1 ELSE 0 END) AS w FROM e GROUP BY 1, 2, 3)
SELECT tier, y, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(possible) AS BIGINT) AS possible, CAST(sum(w) AS BIGINT) AS winners, count(*) AS finals, grouping(tier) AS all_tier, grouping(y) AS all_y, round(100e0 * sum(hits) / sum(possible), 4) AS hit_rate FROM h GROUP BY GROUPING SETS ((), (tier), (y))""")
def hit_rate_by_tier_year(t):
    return E.hit_rates(E.hits(_called(t), ["race"], "called", "place", ["tier", "y"]), ["tier", "y"])


@query("""SELECT CAST(least(10, floor(p * 10) + 1) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(CASE WHEN o THEN 1e0 ELSE 0e0 END), 6) AS observed FROM (SELECT (value % 97) / 97 AS p, event_type = 'purchase' AS o FROM events) GROUP BY 1""")
def calibration_bins(t):
    e = t("events").select(((F.col("value") % 97) / 97).alias("p"), (F.col("event_type") == "purchase").alias("o"))
    return E.calibration(e, "p", F.col("o"))


@query(f"""WITH {CHANCE_SQL}, b(bin, low, high) AS (VALUES (0, 0e0, 0.1e0), (1, 0.1e0, 0.1252e0), (2, 0.1252e0, 0.4e0), (3, 0.4e0, NULL)), f AS (SELECT chance, athlete % 2 = 0 AS won, CASE WHEN chance >= 0.4 THEN 3 WHEN chance >= 0.1252 THEN 2 WHEN chance >= 0.1 THEN 1 ELSE 0 END AS bin FROM field)
SELECT bin::BIGINT AS bin, low, high, count(chance) AS n, round(avg(chance), 6) AS predicted, round(avg(CASE WHEN won THEN 1e0 WHEN chance IS NOT NULL THEN 0e0 END), 6) AS observed FROM b LEFT JOIN f USING (bin) GROUP BY 1, 2, 3""")
def favourite_bins(t):
    return E.favourite_bins(field(t), "chance", F.col("athlete") % 2 == 0, [0.0, 0.1, 0.1252, 0.4])


@query(f"""WITH {PLACED_SQL}, p AS (SELECT r.*, s_acctbal AS feature FROM runs r JOIN supplier ON s_suppkey = athlete), one AS (SELECT race, max(feature) AS fv FROM p WHERE place = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT count(*) AS comparisons, round(avg(CASE WHEN feature < fv THEN 1e0 WHEN feature = fv THEN 0.5e0 ELSE 0e0 END), 6) AS win_rate, count(DISTINCT race) AS finals FROM p JOIN one USING (race) WHERE place BETWEEN 4 AND 99""")
def pairwise_win_rate(t):
    s = t("supplier").select(F.col("s_suppkey").alias("athlete"), F.col("s_acctbal").alias("feature"))
    return E.pairwise_win_rate(runs(t).join(s, "athlete"), ["race"], "place", "feature", 1)


@query(f"""WITH {PLACED_SQL}, p AS (SELECT race, place, count(*) OVER (PARTITION BY race) AS n, rank() OVER (PARTITION BY race ORDER BY s_acctbal DESC) AS r FROM runs JOIN supplier ON s_suppkey = athlete)
SELECT count(*) AS finals, median(r) AS median_rank, round(100 * avg(CASE WHEN r <= 3 THEN 1e0 ELSE 0e0 END), 4) AS in_top3, round(100 * avg(CASE WHEN r <= 6 THEN 1e0 ELSE 0e0 END), 4) AS in_top6, round(100 * 3 / avg(n), 4) AS random_top3 FROM p WHERE n >= 6 AND place = 1""")
def pre_race_rank(t):
    s = t("supplier").select(F.col("s_suppkey").alias("athlete"), F.col("s_acctbal").alias("feature"))
    return E.pre_race_rank(runs(t).join(s, "athlete"), ["race"], "place", "feature", 1)


SLOPE = "w AS (SELECT l_returnflag AS grp, l_suppkey AS unit, l_extendedprice AS y, l_quantity AS x, dayofyear(l_shipdate) / 100e0 AS s FROM lineitem), k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, unit) AS c FROM w) WHERE c >= 3)"


@query(f"""WITH {SLOPE}, m AS (SELECT grp, unit, y - avg(y) OVER v AS y, x - avg(x) OVER v AS x FROM k WINDOW v AS (PARTITION BY grp, unit)), g AS (SELECT grp, count(*) AS n, count(DISTINCT unit) AS units, sum(x * y) / sum(x * x) AS slope, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS rss, sum(x * x) AS xx FROM m GROUP BY 1 HAVING count(*) >= 200)
SELECT grp, n, units, round(slope, 4) AS slope, round(sqrt(rss / (n - units - 1) / xx), 4) AS std_error FROM g""")
def within_group_slope(t):
    li = t("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("unit"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    return E.within_slope(li, ["unit"], "y", "x", ["grp"]).withColumns({c: F.round(c, 4) for c in ("slope", "std_error")})


@query(f"""WITH {SLOPE}, m AS (SELECT grp, unit, y - avg(y) OVER v AS y, x - avg(x) OVER v AS x, s - avg(s) OVER v AS a, s * s - avg(s * s) OVER v AS b FROM k WINDOW v AS (PARTITION BY grp, unit)),
q AS (SELECT grp, count(*) AS n, count(DISTINCT unit) AS units, sum(x*y) xy, sum(x*x) xx, sum(y*y) yy, sum(a*y) ay, sum(a*x) ax, sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(b*y) by_, sum(b*x) bx FROM m GROUP BY 1),
r AS (SELECT grp, n, units, xy - ax*ay/aa AS xy, xx - ax*ax/aa AS xx, yy - ay*ay/aa AS yy, by_ - ab*ay/aa AS zy, bx - ab*ax/aa AS bx, bb - ab*ab/aa AS bb FROM q), f AS (SELECT grp, n, units, xy - bx*zy/bb AS xy, xx - bx*bx/bb AS xx, yy - zy*zy/bb AS yy FROM r)
SELECT grp, n, units, round(xy / xx, 4) AS slope, round(sqrt((yy - xy * xy / xx) / (n - units - 3) / xx), 4) AS std_error FROM f""")
def season_controlled_slope(t):
    s = F.dayofyear("l_shipdate") / 100.0
    li = t("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("unit"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), s.alias("s"))
    return E.within_slope(li, ["unit"], "y", "x", ["grp"], controls=[F.col("s"), F.col("s") * F.col("s")]).withColumns({c: F.round(c, 4) for c in ("slope", "std_error")})


UTILITY_SQL = f"{CHANCE_SQL}, u AS (SELECT grp, athlete, n, v / 100000 AS u FROM field), e AS (SELECT *, exp(u - max(u) OVER (PARTITION BY grp)) AS e FROM u), s AS (SELECT *, sum(e) OVER (PARTITION BY grp) AS t FROM e)"


def _utility(t):
    return field(t).select("grp", "athlete", "n", (F.col("v") / 100000).alias("u"))


@query(f"WITH {UTILITY_SQL} SELECT grp, athlete, round(e / t, 6) AS win_chance FROM s")
def win_chances(t):
    return P.win_chances(_utility(t), ["grp"], "u").select("grp", "athlete", F.round("win_chance", 6).alias("win_chance"))


PODIUM_SQL = f"""WITH {UTILITY_SQL}, two AS (SELECT a.grp, a.athlete, sum(b.e / a.t * a.e / (a.t - b.e)) AS p FROM s a JOIN s b ON a.grp = b.grp AND a.athlete <> b.athlete GROUP BY 1, 2),
three AS (SELECT a.grp, a.athlete, sum(b.e / a.t * c.e / (a.t - b.e) * a.e / (a.t - b.e - c.e)) AS p FROM s a JOIN s b ON a.grp = b.grp AND a.athlete <> b.athlete JOIN s c ON a.grp = c.grp AND c.athlete <> a.athlete AND c.athlete <> b.athlete GROUP BY 1, 2)
SELECT s.grp, s.athlete, round(e / t + two.p + three.p, 6) AS podium_chance FROM s JOIN two USING (grp, athlete) JOIN three USING (grp, athlete)"""


@query(PODIUM_SQL)
def podium_chances(t):
    return P.podium_chances(_utility(t), ["grp"], "u").select("grp", "athlete", F.round("podium_chance", 6).alias("podium_chance"))


@query(PODIUM_SQL)
def podium_chances_by_joins(t):
    return P.podium_chances_by_joins(_utility(t), ["grp"], "athlete", "u").select("grp", "athlete", F.round("podium_chance", 6).alias("podium_chance"))


@query(f"WITH {UTILITY_SQL} SELECT grp, round(sum(CASE WHEN n <= 3 THEN ln(e) END) - ln(sum(e)) - ln(sum(CASE WHEN n > 1 THEN e END)) - ln(sum(CASE WHEN n > 2 THEN e END)), 6) AS log_likelihood FROM s GROUP BY 1")
def top3_log_likelihood(t):
    return P.top3_log_likelihood(_utility(t), ["grp"], "u", "n").withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(f"""WITH {PLACED_SQL}, b AS (SELECT tier, athlete, max(CASE WHEN y = 1997 THEN v END) AS now, max(CASE WHEN y = 1996 THEN v END) AS one, max(CASE WHEN y = 1995 THEN v END) AS two FROM runs GROUP BY 1, 2),
l AS (SELECT *, greatest(0, coalesce((one - now) * 0.35, 0)) AS a, greatest(0, coalesce((two - now) * 0.35 * 0.3, 0)) AS b, (max(now) OVER (PARTITION BY tier) - now) * 0.75 AS room FROM b WHERE now IS NOT NULL)
SELECT tier, athlete, round(least(greatest(a, b), room), 6) AS lift, round(now + least(greatest(a, b), room), 6) AS level, CASE WHEN least(greatest(a, b), room) > 0 THEN CASE WHEN b > a THEN 'two' ELSE 'one' END END AS reason FROM l""")
def faded_level(t):
    best = lambda y: F.max(F.when(F.col("y") == y, F.col("v")))
    b = runs(t).groupBy("tier", "athlete").agg(best(1997).alias("now"), best(1996).alias("one"), best(1995).alias("two")).where("now IS NOT NULL")
    out = P.faded_level(b, ["tier"], "now", [("one", F.lit(1)), ("two", F.lit(2))])
    return out.select("tier", "athlete", F.round("lift", 6).alias("lift"), F.round("level", 6).alias("level"), F.col("lift_from").alias("reason"))


@query("""WITH b AS (SELECT l_suppkey AS athlete, avg(l_extendedprice) AS form, max(l_extendedprice) AS career, least(greatest(count(*), 1), 5) / 5e0 * greatest(0, 1 - coalesce(stddev_samp(l_quantity), 0) / 50) AS c FROM lineitem WHERE l_discount = 0.05 GROUP BY 1)
SELECT athlete, round(CASE WHEN form >= career THEN form ELSE (0.5 + 0.5 * c) * form + (1 - (0.5 + 0.5 * c)) * career END, 3) AS strength FROM b""")
def strength_blend(t):
    from meetlens.functions.marks import consistency

    b = t("lineitem").where("l_discount = 0.05").groupBy(F.col("l_suppkey").alias("athlete")).agg(F.avg("l_extendedprice").alias("form"), F.max("l_extendedprice").alias("career"), F.count("*").alias("n"), F.stddev_samp("l_quantity").alias("s"))
    return b.select("athlete", F.round(P.strength("form", "career", consistency("n", "s")), 3).alias("strength"))


@query("""WITH c AS (SELECT n_name, r_name, c_name AS athlete, c_mktsegment AS event, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, c_custkey % 2 AS priority FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT n_name, r_name, count(*) AS n, max(score) AS top_score, row_number() OVER (ORDER BY max(score) DESC, n_name) AS position FROM c GROUP BY 1, 2""")
def country_directory(t):
    return Q.directory(_by_country(t).select("n_name", "r_name", "n", "top_score"), "top_score", "n_name")


def _by_country(t):
    n = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = t("customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    c = c.select("n_name", "r_name", F.col("c_name").alias("athlete"), F.col("c_mktsegment").alias("event"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"), (F.col("c_custkey") % 2).alias("priority"))
    return A.nation_rollup(c, ["n_name", "r_name"], "athlete", "event", "score", "priority")


@query("""WITH c AS (SELECT n_name, r_name, c_name AS athlete, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, c_mktsegment AS event FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT n_name, r_name, count(*) AS n, max(score) AS top_score, string_agg(athlete, ',' ORDER BY coalesce(score, -1) DESC, event, athlete) AS athletes FROM c GROUP BY 1, 2""")
def country_rollup(t):
    return _by_country(t).withColumn("athletes", F.array_join(F.transform("athletes", lambda a: a["athlete"]), ","))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_partkey) AS position FROM part WHERE contains(lower(p_name), 'ar') ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 25")
def search_rank(t):
    return R.search(t("part").select("p_partkey", "p_name", "p_size"), "p_name", "Ar", [F.desc_nulls_last("p_size"), F.asc("p_partkey")]).drop("p_size")


@query("""WITH m AS (SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN lower(right(n_name, 2)) = '_1' THEN 0 WHEN starts_with(lower(n_name), '_1') THEN 1 WHEN contains(lower(n_name), '_1') THEN 2 END AS match_kind FROM nation) SELECT n_nationkey, n_name, match_kind::BIGINT AS match_kind, row_number() OVER (ORDER BY match_kind, n_name) AS position FROM m WHERE match_kind IS NOT NULL ORDER BY match_kind, n_name LIMIT 5""")
def search_country(t):
    n = t("nation").select("n_nationkey", "n_name", F.lower(F.substring("n_name", -2, 2)).alias("code"))
    return R.ranked_search(n, "code", "n_name", "_1", [F.asc("n_name")]).drop("code")


@query(f"""WITH {CHANCE_SQL}, k AS (SELECT *, 100 * (chance - lead(chance) OVER (PARTITION BY grp ORDER BY n)) AS gap FROM field),
s AS (SELECT grp, 'photo_finish' AS kind, 0 AS o, athlete, n, CASE WHEN gap <= 2 THEN 2 ELSE 1 END AS surprise FROM k WHERE n = 1 AND gap <= 6 UNION ALL SELECT grp, 'injury_watch', 1, athlete, n, CASE WHEN n = 1 THEN 3 WHEN n <= 3 THEN 2 ELSE 1 END FROM k WHERE athlete % 3 = 0
 UNION ALL SELECT grp, 'returning_champion', 2, athlete, n, 1 FROM k WHERE athlete % 7 = 0 UNION ALL SELECT grp, 'debutant', 3, athlete, n, CASE WHEN n = 1 THEN 2 ELSE 0 END FROM k WHERE athlete % 5 = 0
 UNION ALL SELECT grp, 'rivalry', 4, athlete, n, CASE WHEN athlete % 3 = athlete % 2 THEN 1 ELSE 3 END FROM k WHERE n = 2 UNION ALL SELECT grp, 'hot_streak', 5, athlete, n, 1 FROM k WHERE athlete % 4 = 0)
SELECT grp, kind, athlete, surprise::BIGINT AS surprise, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY surprise DESC, o, n) AS rank FROM s) WHERE rank <= 4""")
def storylines(t):
    a = F.col("athlete")
    f = field(t).withColumns({"watch": a % 3 == 0, "champion": a % 7 == 0, "debut": a % 5 == 0, "streak": F.when(a % 4 == 0, 3).otherwise(1)})
    rivals = f.where("n = 2").select("grp", "athlete", (a % 3).alias("wins"), (a % 2).alias("losses"))
    return Q.storylines(f, rivals, ["grp"], "athlete", "chance")


@query(f"""WITH {TOTALS_SQL}, n AS (SELECT grp, athlete, max(v) AS v FROM totals WHERE y = 1997 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC, athlete) AS rank FROM n), one AS (SELECT * FROM r)
SELECT grp, athlete, rank, CASE WHEN rank <= 8 THEN 'in_field' WHEN athlete % 9 = 0 THEN 'injured' WHEN rank <= 30 THEN 'points_cut' ELSE 'out_of_reach' END AS reason FROM one""")
def field_status(t):
    n = totals(t).where("y = 1997").groupBy("grp", "athlete").agg(F.max("v").alias("v"))
    r = R.with_row_number(n, ["grp"], F.struct(-F.col("v"), "athlete"), "rank")
    return Q.status(r, [("in_field", F.col("rank") <= 8), ("injured", F.col("athlete") % 9 == 0), ("points_cut", F.col("rank") <= 30)], "out_of_reach").select("grp", "athlete", "rank", F.col("reason"))


@query(f"""WITH {TOTALS_SQL}, b AS (SELECT athlete, grp, min(v) AS v FROM totals GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v, athlete) AS r FROM b) SELECT athlete, grp, v, r AS rank FROM k""")
def search_index(t):
    b = totals(t).groupBy("athlete", "grp").agg(F.min("v").alias("v"))
    return Q.search_index([R.with_row_number(b, ["grp"], F.struct("v", "athlete"), "rank")], "athlete", "grp", "rank")


@query(f"""WITH {CHANCE_SQL}, h AS (SELECT t.grp, t.athlete, t.d, t.v FROM totals t JOIN field f ON f.grp = t.grp AND f.athlete = t.athlete WHERE f.n <= 4) SELECT grp, athlete, count(*) AS races, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d, v) AS dates FROM h GROUP BY 1, 2""")
def discipline_trajectories(t):
    f = field(t).where("n <= 4").select("grp", "athlete")
    return Q.trajectories(totals(t).select("grp", "athlete", "d", "v", "id"), f, ["grp"], "athlete", "d", "v", 8).select("grp", "athlete", F.size("history").alias("races"), F.array_join(F.transform("history", lambda x: x["d"].cast("string")), ",").alias("dates"))


@query()
def forest_walk_forward(t):
    """Hits of the forest model per season, with an expanding fit over all races. Rows only."""
    r = runs(t).join(t("supplier").select(F.col("s_suppkey").alias("athlete"), F.col("s_acctbal").alias("balance")), "athlete").where("y >= 1996")
    past = runs(t).where("y < 1996").groupBy("athlete").agg(F.avg("place").alias("mean_place"), F.max("v").alias("career_best"))
    rows = r.join(past, "athlete").withColumn("label", (F.col("place") <= 3).cast("int")).select("race", "athlete", "place", "y", "balance", "mean_place", "career_best", "label")
    return E.hit_rates(forest.folds(rows, ["balance", "mean_place", "career_best"], ["race"], "athlete", "place", "y", [1997, 1998]), ["fold"])


@query("""WITH c AS (SELECT o_custkey AS name, o_orderpriority AS grp, sum(floor(o_totalprice / 10000)) AS points FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, name) AS rk FROM c),
m AS (SELECT DISTINCT o_orderpriority AS grp, 'M' || month(o_orderdate) AS meeting, last_day(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE year(o_orderdate) = 1996),
n AS (SELECT grp, count(*) FILTER (day >= DATE '1996-09-10' AND month(day) < 12) AS left_, arg_min(meeting, day) FILTER (day >= DATE '1996-09-10' AND month(day) < 12) AS next_meeting, min(day) FILTER (day >= DATE '1996-09-10' AND month(day) < 12) AS next_day FROM m GROUP BY 1)
SELECT s.grp, name, points, rk, left_ AS meetings_left, next_meeting, next_day FROM s JOIN n USING (grp)""")
def qualification_states(t):
    """Standings of a season beside the state of its calendar: meetings left before the final, and the next one."""
    o = t("orders").where(F.year("o_orderdate") == 1996)
    points = o.groupBy(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("grp")).agg(F.sum(F.floor(F.col("o_totalprice") / 10000)).alias("points"))
    race = R.with_row_number(points, ["grp"], F.struct(-F.col("points"), "name"), "rk")
    meets = o.select(F.col("o_orderpriority").alias("grp"), F.concat(F.lit("M"), F.month("o_orderdate").cast("string")).alias("meeting"), F.last_day("o_orderdate").alias("day")).distinct()
    return Q.qualification_state(race, meets, ["grp"], "meeting", "day", F.lit("1996-09-10").cast("date"), F.month("day") == 12)


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_retailprice END, CASE WHEN p_size % 3 = 1 THEN p_size::DOUBLE END, 44) AS quoted FROM part""")
def preferred_metric(t):
    """A metric with two fallbacks, some of which are no numbers."""
    size = F.col("p_size") % 3
    return t("part").select("p_partkey", Q.preferred(F.when(size == 0, F.col("p_retailprice").cast("string")).otherwise("n/a"), F.when(size == 1, F.col("p_size").cast("string")).when(size == 2, ""), otherwise=44.0).alias("quoted"))
