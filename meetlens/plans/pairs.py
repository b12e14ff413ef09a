"""Head-to-head, join, set and sink queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meetlens.operators import h2h as H
from meetlens.operators import joins as J
from meetlens.operators import ranking as R
from meetlens.plans.base import PLACED_SQL, placed, query, runs
from meetlens.sources import readers, sinks

PAIRS_SQL = "pairs AS (SELECT a.race, a.athlete AS athlete_a, b.athlete AS athlete_b, CASE WHEN a.place < b.place THEN 1 ELSE 0 END AS a_wins FROM placed a JOIN placed b ON a.race = b.race AND a.athlete <> b.athlete AND a.place <> b.place)"
RATES_SQL = "rates AS (SELECT athlete_a, athlete_b, CAST(sum(a_wins) AS BIGINT) AS wins, count(*) AS meetings, CAST(sum(a_wins) AS DOUBLE) / count(*) AS win_rate FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2)"


def _pairs(t):
    return H.pairwise(placed(t), ["race"], "athlete", "place")


@query(f"WITH {PLACED_SQL}, {PAIRS_SQL} SELECT race, athlete_a, athlete_b, CAST(a_wins AS BIGINT) AS a_wins FROM pairs")
def pairwise_records(t):
    return _pairs(t)


@query(f"WITH {PLACED_SQL}, {PAIRS_SQL}, {RATES_SQL} SELECT athlete_a, athlete_b, wins, meetings, round(win_rate, 6) AS win_rate FROM rates")
def h2h_rates(t):
    return H.rates(_pairs(t), least=2).withColumn("win_rate", F.round("win_rate", 6))


@query(f"""WITH {PLACED_SQL} SELECT a.athlete AS athlete, b.athlete AS opponent, count(CASE WHEN a.place < b.place THEN 1 END) AS wins, count(CASE WHEN a.place > b.place THEN 1 END) AS losses, count(CASE WHEN a.place = b.place THEN 1 END) AS draws,
 count(*) AS meetings, max(a.d) AS last_met, round(100e0 * count(CASE WHEN a.place < b.place THEN 1 END) / count(*), 1) AS win_rate FROM runs a JOIN runs b ON a.race = b.race AND a.athlete <> b.athlete WHERE a.athlete <= 10 GROUP BY 1, 2""")
def h2h_vs_one(t):
    return H.versus(runs(t), ["race"], "athlete", "place", "d", F.col("athlete") <= 10)


FIELD_SQL = "field AS (SELECT s_nationkey AS grp, s_suppkey AS athlete FROM supplier)"


def _field(t):
    return t("supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("athlete"))


def _field_pairs(t):
    """Pairs of one field in a race: others have no cell."""
    return H.pairwise(placed(t).join(_field(t).distinct(), "athlete"), ["race", "grp"], "athlete", "place")


@query(f"""WITH {PLACED_SQL}, {PAIRS_SQL}, {FIELD_SQL}, r AS (SELECT athlete_a, athlete_b, CAST(sum(a_wins) AS BIGINT) AS wins, count(*) AS meetings FROM pairs GROUP BY 1, 2)
SELECT a.grp, a.athlete AS athlete_a, b.athlete AS athlete_b, wins, meetings, round(CAST(wins AS DOUBLE) / meetings, 6) AS win_rate FROM field a JOIN field b ON a.grp = b.grp AND a.athlete <> b.athlete LEFT JOIN r ON r.athlete_a = a.athlete AND r.athlete_b = b.athlete""")
def h2h_matrix(t):
    cells = H.matrix(_field(t), H.rates(_field_pairs(t), ["grp"]).drop("win_rate"), ["grp"], "athlete")
    return cells.withColumn("win_rate", F.round("win_rate", 6))


@query(f"""WITH {PLACED_SQL}, {PAIRS_SQL}, {FIELD_SQL}, r AS (SELECT DISTINCT athlete_a, athlete_b FROM pairs)
SELECT a.grp, round(100e0 * count(r.athlete_a) / count(*), 1) AS coverage, count(*) AS pairs FROM field a JOIN field b ON a.grp = b.grp AND a.athlete <> b.athlete LEFT JOIN r ON r.athlete_a = a.athlete AND r.athlete_b = b.athlete GROUP BY 1""")
def matrix_coverage(t):
    return H.coverage(_field(t), H.rates(_field_pairs(t), ["grp"]), ["grp"], "athlete")


@query(f"""WITH {PLACED_SQL}, {PAIRS_SQL}, {RATES_SQL}, {FIELD_SQL} SELECT a.grp, a.athlete, round(coalesce(avg(win_rate), 0.5), 6) AS h2h_mean FROM field a LEFT JOIN field b ON a.grp = b.grp AND a.athlete <> b.athlete LEFT JOIN rates ON athlete_a = a.athlete AND athlete_b = b.athlete GROUP BY 1, 2""")
def h2h_field_mean(t):
    return H.field_mean(_field(t), H.rates(_field_pairs(t), ["grp"], least=2), ["grp"], "athlete").withColumn("h2h_mean", F.round("h2h_mean", 6))


@query(f"""WITH {PLACED_SQL}, {PAIRS_SQL}, c AS (SELECT DISTINCT make_date(year(o_orderdate), 9, 1) AS cutoff FROM orders), dated AS (SELECT p.*, CAST(o_orderdate AS DATE) AS d FROM pairs p JOIN orders ON o_orderkey = race)
SELECT cutoff, athlete_a, athlete_b, CAST(sum(a_wins) AS BIGINT) AS wins, count(*) AS meetings, round(CAST(sum(a_wins) AS DOUBLE) / count(*), 6) AS win_rate FROM dated JOIN c ON d < cutoff GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def h2h_asof_cutoff(t):
    o = t("orders").select(F.col("o_orderkey").alias("race"), F.to_date("o_orderdate").alias("d"))
    cuts = o.select(F.make_date(F.year("d"), F.lit(9), F.lit(1)).alias("cutoff")).distinct()
    return H.as_of_rates(_pairs(t).join(o, "race"), cuts, [], "d").withColumn("win_rate", F.round("win_rate", 6))


@query(f"""WITH {PLACED_SQL}, f AS (SELECT s_nationkey AS grp, s_suppkey AS athlete, s_acctbal AS score FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, athlete) AS r FROM f),
rv AS (SELECT * FROM (SELECT f.grp, f.athlete, k.athlete AS rival, row_number() OVER (PARTITION BY f.grp, f.athlete ORDER BY k.r) AS n FROM f JOIN k ON f.grp = k.grp AND k.r <= 4 AND k.athlete <> f.athlete) WHERE n <= 3),
n AS (SELECT rv.grp, rv.athlete, count(CASE WHEN a.place < b.place THEN 1 END) AS w, count(CASE WHEN a.place > b.place THEN 1 END) AS l FROM rv JOIN placed a ON a.athlete = rv.athlete JOIN placed b ON b.race = a.race AND b.athlete = rv.rival GROUP BY 1, 2)
SELECT f.grp, f.athlete, round(coalesce(CAST(w - l AS DOUBLE) / nullif(w + l, 0), 0), 6) AS h2h_top FROM f LEFT JOIN n ON n.grp = f.grp AND n.athlete = f.athlete""")
def h2h_top3_net(t):
    f = t("supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("athlete"), F.col("s_acctbal").alias("score"))
    return H.net_against_top(f, placed(t), ["grp"], "athlete", "score", ["race"], "place").withColumn("h2h_top", F.round("h2h_top", 6))


@query("""WITH s AS (SELECT c_mktsegment AS grp, c_custkey AS name, c_acctbal AS points, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer),
x AS (SELECT a.*, a.points + 2 * 8 AS ceiling, (SELECT count(*) FROM s b WHERE b.grp = a.grp AND b.points > a.points + 16) AS above, (SELECT count(*) FROM s b WHERE b.grp = a.grp AND b.name <> a.name AND b.points + 16 >= a.points) AS reach, max(CASE WHEN rk = 8 THEN points END) OVER (PARTITION BY grp) AS cut FROM s a)
SELECT grp, name, points, rk, round(ceiling, 2) AS ceiling, cut, above, reach, CASE WHEN points IS NULL THEN 'unknown' WHEN above >= 8 THEN 'out' WHEN reach < 8 THEN 'safe' WHEN rk <= 8 THEN 'in' ELSE 'chasing' END AS status, round(cut - points, 2) AS gap FROM x""")
def qualification_race(t):
    s = R.with_row_number(t("customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("points")), ["grp"], F.struct(-F.col("points"), "name"), "rk")
    out = H.qualification(s.withColumn("qual_limit", F.lit(8)), ["grp"], "name", "points", "rk", "qual_limit", F.lit(2))
    return out.withColumn("ceiling", F.round("ceiling", 2)).drop("qual_limit")


@query("""WITH e AS (SELECT user_id, event_type, list(DISTINCT hour(ts)) AS slots FROM events GROUP BY 1, 2)
SELECT a.user_id, a.event_type AS event_a, b.event_type AS event_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type AND list_has_any(a.slots, b.slots)""")
def slot_overlap_pairs(t):
    e = t("events").groupBy("user_id", "event_type").agg(F.collect_set(F.hour("ts")).alias("slots"))
    return H.double_entries(e, "user_id", "event_type", "slots")


# Joins


@query("""SELECT o_orderkey, o_custkey, coalesce(label, 0) AS label, coalesce(tier, 'tour') AS tier FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, 1 AS label, c_mktsegment AS tier FROM customer WHERE c_acctbal > 5000) USING (o_custkey)""")
def label_left_join(t):
    labels = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tier"), F.lit(1).alias("one"))
    return J.with_labels(t("orders").select("o_orderkey", "o_custkey"), labels, ["o_custkey"], F.col("one"))


@query("SELECT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def unmatched_labels_anti(t):
    return J.unmatched(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), t("orders").where(F.col("o_orderpriority").startswith("1")), ["o_custkey"])


@query(f"WITH {PLACED_SQL} SELECT race, athlete, tier, y FROM runs WHERE (tier, y) IN (SELECT (tier, y) FROM runs WHERE place = 1 AND v > 90000 AND month(d) = 9)")
def contested_semi(t):
    r = runs(t)
    return J.contested(r.select("race", "athlete", "tier", "y"), r.where("place = 1 AND v > 90000 AND month(d) = 9"), ["tier", "y"])


@query("SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS in_field FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def in_field_flag(t):
    return J.in_field(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount = 0.1)")
def allow_list_semi(t):
    lists = [t("supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("l_suppkey")), t("lineitem").where("l_quantity >= 50 AND l_discount = 0.1").select("l_suppkey")]
    return J.allowed(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), lists, "l_suppkey")


@query("""WITH e AS (SELECT c_custkey AS eid, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 END AS sid, 'N' || (c_custkey % 60) AS name, c_nationkey AS nation FROM customer),
h AS (SELECT s_suppkey AS sid, 'N' || (s_suppkey % 45) AS name, s_nationkey AS nation FROM supplier),
i AS (SELECT sid, min(name) AS n1, min(nation) AS t1 FROM h GROUP BY 1), b AS (SELECT DISTINCT name, nation, TRUE AS b FROM h), n AS (SELECT name, count(DISTINCT nation) AS c, min(nation) AS t3 FROM h GROUP BY 1),
r AS (SELECT e.*, n1, t1, t3, CASE WHEN n1 IS NOT NULL THEN 'id' WHEN b THEN 'name+nation' WHEN c = 1 THEN 'name' ELSE 'none' END AS rule FROM e LEFT JOIN i USING (sid) LEFT JOIN b USING (name, nation) LEFT JOIN n USING (name))
SELECT eid, CASE rule WHEN 'id' THEN n1 WHEN 'none' THEN NULL ELSE name END AS matched_name, CAST(CASE rule WHEN 'id' THEN t1 WHEN 'name+nation' THEN nation WHEN 'name' THEN t3 END AS BIGINT) AS matched_nation, rule AS matched_by FROM r""")
def tiered_key_match(t):
    e = t("customer").select(F.col("c_custkey").alias("eid"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 40).alias("sid"), F.concat(F.lit("N"), F.col("c_custkey") % 60).alias("name"), F.col("c_nationkey").alias("nation"))
    h = t("supplier").select(F.col("s_suppkey").alias("sid"), F.concat(F.lit("N"), F.col("s_suppkey") % 45).alias("name"), F.col("s_nationkey").alias("nation"))
    return J.tiered_match(e, h, "eid", "sid", "name", "nation")


@query("""WITH p AS (SELECT c_custkey AS eid, s_suppkey AS rid FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 500) = floor(s_acctbal / 500) WHERE abs(c_acctbal - s_acctbal) < 100),
n AS (SELECT *, count(*) OVER (PARTITION BY eid) AS e, count(*) OVER (PARTITION BY rid) AS r FROM p) SELECT eid, rid FROM n WHERE e = 1 AND r = 1""")
def entity_match_unique(t):
    e = t("customer").select(F.col("c_custkey").alias("eid"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 500).alias("b"), "c_acctbal")
    r = t("supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 500).alias("b"), "s_acctbal")
    return J.unique_match(e, r, "eid", "rid", ["nation", "b"], F.abs(F.col("c_acctbal") - F.col("s_acctbal")) < 100)


@query(f"""WITH {PLACED_SQL}, e AS (SELECT DISTINCT athlete, y AS ey, make_date(y, 6, 1) AS cutoff FROM runs),
f AS (SELECT e.athlete, e.ey, e.cutoff, max(CASE WHEN r.y = ey THEN v END) AS now, max(CASE WHEN r.y = ey - 1 THEN v END) AS prev, max(CASE WHEN r.y < ey THEN v END) AS career FROM e LEFT JOIN runs r ON r.athlete = e.athlete AND r.d < e.cutoff GROUP BY 1, 2, 3)
SELECT athlete, ey, cutoff, coalesce(now, prev) AS sb_score, CASE WHEN now IS NOT NULL THEN 'toplist' WHEN prev IS NOT NULL THEN 'last_season' END AS sb_source, now IS NULL AND prev IS NOT NULL AS sb_prior_season, prev AS prev_season_best, career AS career_best FROM f""")
def asof_score_fallback(t):
    r = runs(t)
    e = r.select("athlete", F.col("y").alias("ey")).distinct().withColumn("cutoff", F.make_date("ey", F.lit(6), F.lit(1)))
    return J.asof_best(e, r, ["athlete"], "cutoff", "d", "y", "ey", "v").drop("sb_date")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 49)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'kept' WHEN b.id IS NOT NULL THEN 'added' ELSE 'not_entered' END AS entry_status FROM a FULL JOIN b ON a.id = b.id""")
def entry_reconciliation(t):
    side = lambda f, q: t("lineitem").where((F.col("l_returnflag") == f) & (F.col("l_quantity") > q)).select(F.col("l_suppkey").alias("id"))
    return J.reconcile(side("R", 45), side("N", 49), ["id"])


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY d) AS position, CAST(d AS VARCHAR) AS day, CAST(n AS VARCHAR) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 GROUP BY 1)),
b AS (SELECT row_number() OVER (ORDER BY d) AS position, CAST(d AS VARCHAR) AS day, CAST(n AS VARCHAR) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 AND o_orderstatus <> 'P' GROUP BY 1)),
j AS (SELECT coalesce(a.position, b.position) AS position, a.day AS da, b.day AS db, a.n AS na, b.n AS nb FROM a FULL JOIN b ON a.position = b.position)
SELECT position, field, old, new FROM (SELECT position, 'day' AS field, da AS old, db AS new FROM j UNION ALL SELECT position, 'n', na, nb FROM j) WHERE old IS DISTINCT FROM new""")
def calendar_diff_full_outer(t):
    o = t("orders").where((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") == 3))
    days = lambda df: df.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return J.ordered_diff(days(o), days(o.where("o_orderstatus <> 'P'")), [F.asc("day")], ["day", "n"])


@query(f"""WITH {PLACED_SQL}, a AS (SELECT tier, y, list(DISTINCT athlete) AS w FROM runs WHERE place = 1 AND dayofyear(d) = 1 GROUP BY 1, 2), b AS (SELECT tier, y, list(DISTINCT athlete) AS w FROM runs WHERE place = 1 AND dayofyear(d) = 2 GROUP BY 1, 2)
SELECT a.tier, a.y, len(a.w) AS n_a, len(b.w) AS n_b FROM a JOIN b ON a.tier = b.tier AND a.y = b.y WHERE NOT list_has_any(a.w, b.w)""")
def winner_disagreements(t):
    r = runs(t)
    out = J.winner_disagreements(r.where(F.dayofyear("d") == 1), r.where(F.dayofyear("d") == 2), ["tier", "y"], "athlete", "place")
    return out.select("tier", "y", F.size("winners_a").alias("n_a"), F.size("winners_b").alias("n_b"))


@query("""SELECT athlete, v, source_no FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY source_no, v DESC, k) AS n FROM (SELECT l_suppkey AS athlete, l_extendedprice AS v, l_orderkey * 10 + l_linenumber AS k, 0 AS source_no FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_extendedprice, l_orderkey * 10 + l_linenumber, 1 FROM lineitem)) WHERE n = 1""")
def first_source_lookup(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("athlete"), F.col("l_extendedprice").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_returnflag")
    return J.first_source([rows.where("l_quantity = 50 AND l_returnflag = 'R'"), rows], ["athlete"], [F.desc("v"), F.asc("k")]).select("athlete", "v", "source_no")


@query("""WITH u AS (SELECT l_suppkey AS athlete, CAST(l_shipdate AS DATE) AS d, l_partkey AS venue FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_suppkey, CAST(l_shipdate AS DATE), l_partkey FROM lineitem WHERE l_returnflag = 'N') SELECT athlete, count(*) AS races FROM u GROUP BY 1""")
def races_on_record(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("athlete"), F.to_date("l_shipdate").alias("d"), F.col("l_partkey").alias("venue"), "l_linestatus", "l_returnflag")
    return J.races_on_record([rows.where("l_linestatus = 'O'"), rows.where("l_returnflag = 'N'")], "athlete", "d", "venue")


@query("""SELECT athlete, y, n, source_no FROM (SELECT *, min(source_no) OVER (PARTITION BY athlete, y) AS m FROM (SELECT l_suppkey AS athlete, year(l_shipdate) AS y, count(*) AS n, 0 AS source_no FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2 UNION ALL SELECT l_suppkey, year(l_shipdate), count(*), 1 FROM lineitem GROUP BY 1, 2)) WHERE source_no = m""")
def whole_first_source(t):
    rows = lambda df: df.groupBy(F.col("l_suppkey").alias("athlete"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    return J.whole_first_source([rows(t("lineitem").where("l_quantity > 48")), rows(t("lineitem"))], ["athlete", "y"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN greatest(c_acctbal, last) ELSE coalesce(nullif(c_acctbal, 0), last) END AS used_score FROM (SELECT c_custkey, c_acctbal, max(o_totalprice) / 40 AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)""")
def last_season_rule(t):
    last = t("orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_totalprice") / 40).alias("last"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.nullif("c_acctbal", F.lit(0.0)).alias("now")).join(last, "id", "left")
    return J.last_season_rule(c, "now", "last", F.col("id") % 2 == 0).select("id", "used_score")


# Sets


def _parts(t, flag):
    return t("lineitem").where(F.col("l_returnflag") == flag).where("l_quantity > 40").select("l_suppkey", "l_partkey")


def _parts_sql(op):
    return f"SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 {op} SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40"


@query(_parts_sql("UNION"))
def start_list_union_distinct(t):
    from meetlens.operators.aggregates import start_lists

    return start_lists([_parts(t, "R"), _parts(t, "N")], ["l_suppkey", "l_partkey"])


@query(_parts_sql("INTERSECT"))
def start_list_intersect(t):
    return _parts(t, "R").intersect(_parts(t, "N"))


@query(_parts_sql("EXCEPT"))
def start_list_except(t):
    return _parts(t, "R").subtract(_parts(t, "N"))


# Logs and sinks


@query("""SELECT athlete, d, v, source_priority, place FROM (SELECT *, row_number() OVER (PARTITION BY athlete, d, v ORDER BY source_priority, place, k) AS n FROM (SELECT l_suppkey AS athlete, CAST(l_shipdate AS DATE) AS d, floor(l_extendedprice / 5000) AS v, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source_priority, l_linenumber::BIGINT AS place, l_orderkey AS k FROM lineitem)) WHERE n = 1""")
def race_log_union_dedupe(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("athlete"), F.to_date("l_shipdate").alias("d"), F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("v"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("source_priority"), F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("k"))
    parts = [rows.where(F.col("source_priority") == i) for i in range(3)]
    return R.first_per(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["athlete", "d", "v"], [F.asc("source_priority"), F.asc("place"), F.asc("k")]).drop("k")


@query("""WITH l AS (SELECT l_linestatus AS discipline, l_suppkey AS athlete, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS m, CAST(l_shipdate AS DATE) AS d,
l_linenumber::BIGINT AS place, 'venue ' || l_partkey % 50 AS meeting, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source_priority FROM lineitem)
SELECT discipline, athlete, m || '.50' AS mark, m + 0.5::DOUBLE AS value, place, d AS date, year(d) AS year, meeting, source_priority FROM
(SELECT *, row_number() OVER (PARTITION BY discipline, athlete, d, m ORDER BY source_priority, place, meeting) AS n FROM l) WHERE n = 1""")
def race_log_from_sources(t):
    """Three sources of text columns, each in the race log's shape by the readers, then one log."""
    raw = t("lineitem").select(
        F.col("l_linestatus").alias("discipline"), F.col("l_suppkey").alias("athlete"),
        F.concat(F.floor(F.col("l_extendedprice") / 5000).cast("string"), F.lit(".50")).alias("mark"),
        F.col("l_linenumber").cast("string").alias("pos"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("venue "), (F.col("l_partkey") % 50).cast("string")).alias("venue"), "l_returnflag",
    )
    sources = [readers.normalised(raw.where(F.col("l_returnflag") == flag).drop("l_returnflag"), flag, k) for k, flag in enumerate("RAN")]
    return readers.race_log(sources).select("discipline", "athlete", "mark", "value", "place", "date", "year", "meeting", "source_priority")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag AS source, year(l_shipdate) AS y FROM lineitem WHERE NOT (l_returnflag = 'R' AND year(l_shipdate) IN (1994, 1995)) UNION ALL SELECT o_orderkey, 0, 'R', year(o_orderdate) FROM orders WHERE year(o_orderdate) IN (1994, 1995)""")
def source_replace(t):
    old = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("source"), F.year("l_shipdate").alias("y"))
    new = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("R").alias("source"), F.year("o_orderdate").alias("y")).where("y IN (1994, 1995)")
    return sinks.source_replaced(old, new, "source", "R", "y")


@query("""WITH o AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), n AS (SELECT l_suppkey AS id, max(l_extendedprice) AS v FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1 GROUP BY 1) SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.id = n.id""")
def upsert_keep_last(t):
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    new = t("lineitem").where("l_quantity = 50 AND l_linenumber = 1").groupBy(F.col("l_suppkey").alias("id")).agg(F.max("l_extendedprice").alias("v"))
    return sinks.upserted(old, new, ["id"], "v")


@query("""WITH o AS (SELECT p_brand AS section, count(*) AS old_rows FROM part GROUP BY 1), n AS (SELECT p_brand AS section, count(*) AS new_rows FROM part WHERE p_size > 3 AND p_brand <> 'Brand#11' GROUP BY 1) SELECT section, old_rows, coalesce(new_rows, 0) AS new_rows FROM o LEFT JOIN n USING (section) WHERE coalesce(new_rows, 0) < old_rows""")
def lost_sections_guard(t):
    p = t("part").select(F.col("p_brand").alias("section"), "p_size")
    return sinks.lost_sections(p, p.where("p_size > 3 AND section <> 'Brand#11'"), "section")


@query("""WITH world AS (SELECT c_custkey AS id, c_name AS name, c_custkey AS rank FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM world UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
WHERE s_suppkey NOT IN (SELECT id FROM world) AND upper(trim(s_name)) NOT IN (SELECT upper(trim(name)) FROM world)""")
def merged_snapshot(t):
    world = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("rank"))
    area = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("rank"))
    return sinks.merged_snapshot(world, area, "id", "name", "rank")
