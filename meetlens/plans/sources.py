"""Readers on files that Spark writes from the driver's tables, in the shapes that sources deliver."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlens.functions import marks
from meetlens.functions import text as T
from meetlens.operators import career as C
from meetlens.plans.base import query
from meetlens.sources import html, paged, readers
from meetlens.sources.shared import shared_dir


def scratch(df, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


PAGES_SQL = """WITH k AS (SELECT page_id, url, page_id % 12 AS list, (row_number() OVER (PARTITION BY page_id % 12 ORDER BY page_id) - 1) // 5 AS page FROM pages),
n AS (SELECT list, page, count(*) FILTER (page_id % 23 <> 0) AS n FROM k GROUP BY 1, 2), stop AS (SELECT list, min(CASE WHEN n < 5 THEN page END) AS stop FROM n GROUP BY 1)"""


def listed(t):
    """Twelve lists of pages of five; rows that a source left out make some pages short."""
    p = t("pages").select("page_id", "url", (F.col("page_id") % 12).alias("list"))
    p = p.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("list").orderBy("page_id")) - 1) / 5).cast("int")).where("page_id % 23 <> 0")
    path = scratch(p, "pages")
    value = F.to_json(F.struct("page_id", "url", F.when(F.col("page_id") % 40 == 0, "elsewhere").otherwise("here").alias("area")))
    p.select("list", "page", value.alias("value")).repartition("list", "page").write.partitionBy("list", "page").text(path)
    return p.sparkSession, path


@query(f"{PAGES_SQL} SELECT page_id, url, CAST(k.list AS VARCHAR) AS list, k.page FROM k JOIN stop USING (list) WHERE page_id % 23 <> 0 AND (stop IS NULL OR k.page <= stop)")
def paged_lists(t):
    """Every list up to its first short page, read by the pages format; unique by id, and few rows outside the area."""
    rows = paged.pages(*listed(t), "page_id long, url string, area string, list string, page int", 5)
    return paged.checked(rows, "page_id", [F.col("list"), F.col("page")], F.col("area") != "here").drop("area")


@query(f"{PAGES_SQL} SELECT CAST(k.list AS VARCHAR) AS list, count(*) AS n FROM k JOIN stop USING (list) WHERE page_id % 23 <> 0 AND (stop IS NULL OR k.page <= stop) GROUP BY 1 HAVING count(*) >= 5")
def paged_at_the_cap(t):
    return paged.at_the_cap(paged.pages(*listed(t), "page_id long, list string", 5), 5)


# Season toplists: an order is a mark of its customer; a priority is a discipline, a year of orders a file.

EVENT = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'men_100m' WHEN '2' THEN 'men_800m' WHEN '3' THEN 'women_LJ' WHEN '4' THEN 'women_800m' ELSE 'men_SP' END"
#: The mark in hundredths, as text of the event: minutes, metres or plain; one in thirteen did not finish.
TOP_SQL = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, {EVENT} AS discipline, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 10) % 9000 + 6100 AS BIGINT) AS h, CAST(floor(o_totalprice / 100) AS BIGINT) AS points FROM orders),
top AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'DNF' WHEN discipline LIKE '%800m' THEN (h // 6000) || ':' || lpad(CAST(h % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') WHEN discipline IN ('women_LJ', 'men_SP') THEN (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 'm' ELSE (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') END AS mark,
 CASE WHEN k % 13 <> 0 THEN h / 100e0 END AS value, CASE WHEN k % 17 <> 0 THEN d END AS day, CASE WHEN k % 7 <> 0 THEN points END AS score, CASE WHEN k % 5 = 0 THEN 'Oslo (i)' ELSE 'Rome (ITA)' END AS venue FROM o)"""


def toplist_rows(t):
    """Text columns of a toplist page: marks as m:ss, metres or plain, DNF, dates in upper case or none."""
    k, h = F.col("o_orderkey"), (F.floor(F.col("o_totalprice") / 10) % 9000 + 6100).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    event = marks.in_order("o_orderpriority", [("^1", "men_100m"), ("^2", "men_800m"), ("^3", "women_LJ"), ("^4", "women_800m")], "men_SP")
    plain = F.concat(F.floor(h / 100).cast("string"), F.lit("."), two(h % 100))
    clock = F.concat(F.floor(h / 6000).cast("string"), F.lit(":"), two(F.floor(h % 6000 / 100)), F.lit("."), two(h % 100))
    o = t("orders").withColumn("discipline", event)
    field, run = F.col("discipline").isin("women_LJ", "men_SP"), F.col("discipline").endswith("800m")
    return o.select(
        F.lit("1").alias("Rank"),
        F.when(k % 13 == 0, "DNF").when(run, clock).when(field, F.concat(plain, F.lit("m"))).otherwise(plain).alias("Mark"),
        F.lit("+0.3").alias("WIND"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Competitor"),
        F.lit("5 JAN 1970").alias("DOB"),
        F.lit("GBR").alias("Nat"),
        F.when(k % 3 == 0, F.concat((k % 9 + 1).cast("string"), F.lit("h2"))).otherwise((k % 9 + 1).cast("string")).alias("Pos"),
        F.lit("").alias("_"),
        F.when(k % 5 == 0, "Oslo (i)").otherwise("Rome (ITA)").alias("Venue"),
        F.when(k % 17 == 0, "n/a").otherwise(F.upper(F.date_format("o_orderdate", "d MMM yyyy"))).alias("Date"),
        F.when(k % 7 != 0, F.floor(F.col("o_totalprice") / 100).cast("string")).alias("Results Score"),
        "discipline",
        F.year("o_orderdate").cast("string").alias("year"),
        F.concat(F.lit("x/c-"), F.col("o_custkey").cast("string")).alias("ProfileURL"),
    )


def toplist_files(t):
    """Files DISCIPLINE_YEAR.csv, each a folder of parts, for men and for women."""
    rows = toplist_rows(t).withColumn("file", F.concat("discipline", F.lit("_"), "year", F.lit(".csv")))
    spark, path = rows.sparkSession, scratch(rows, "toplists")
    rows.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return spark, path


@query(f"""WITH {TOP_SQL} SELECT CASE WHEN discipline LIKE 'men%' THEN 'world' ELSE 'area' END AS list, discipline, y AS file_year, 'C' || c AS athlete, mark, round(value, 2) AS value, day AS date, score, k % 5 = 0 AS indoor FROM top WHERE score IS NOT NULL""")
def toplist_seasons(t):
    """Every discipline's files of two lists, as they are on pages, to scored rows flagged indoor or not."""
    spark, path = toplist_files(t)
    top = readers.toplists(spark, f"{path}/file=men*", {"area": f"{path}/file=women*", "missing": f"{path}/file=none*"})
    return readers.season_scores(top).select("list", "discipline", "file_year", "athlete", "mark", F.round(marks.mark_value("mark"), 2).alias("value"), marks.result_date("date").alias("date"), "score", "indoor")


@query(f"""WITH {TOP_SQL} SELECT 'C' || c AS athlete, y AS year, score::DOUBLE AS score, day AS date, DATE '1970-01-05' AS dob, c AS athlete_id, discipline FROM top WHERE score IS NOT NULL AND day IS NOT NULL""")
def toplist_scoring_rows(t):
    spark, path = toplist_files(t)
    rows = readers.scoring_rows(readers.toplists(spark, f"{path}/file=*"))
    return rows.select("athlete", "year", "score", "date", "dob", F.col("athlete_id").cast("long").alias("athlete_id"), "discipline")


@query(f"""WITH {TOP_SQL}, s AS (SELECT *, CASE k % 4 WHEN 0 THEN 'worldwide' WHEN 1 THEN 'circuit' ELSE 'history' END AS source, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS pr, (k % 9 + 1) AS place FROM top),
n AS (SELECT *, row_number() OVER (PARTITION BY discipline, c, day, mark ORDER BY pr, CASE WHEN k % 3 = 0 THEN NULL ELSE place END NULLS LAST, venue) AS n FROM s)
SELECT discipline, 'C' || c AS athlete, mark, round(value, 2) AS value, day AS date, y AS year, venue AS meeting, source FROM n WHERE n = 1 AND k % 3 <> 0""")
def race_log_of_text(t):
    """Three sources with clock times, metres, non-finishers, heats and bad dates, to one log of finals."""
    k, names = F.col("o_orderkey") % 4, {"Competitor": "athlete", "Mark": "mark", "Pos": "pos", "Venue": "venue", "Date": "date"}
    parts = [("worldwide", k == 0), ("circuit", k == 1), ("history", k >= 2)]
    shape = lambda df: df.select("discipline", *(F.col(c).alias(n) for c, n in names.items()), F.col("year").cast("int").alias("year"))
    sources = [readers.normalised(shape(toplist_rows(lambda name, part=part: t(name).where(part))), name, i) for i, (name, part) in enumerate(parts)]
    return readers.race_log(sources).select("discipline", "athlete", "mark", F.round("value", 2).alias("value"), "date", "year", "meeting", "source")


@query(f"""WITH {TOP_SQL} SELECT y AS year, CAST(c AS VARCHAR) AS athlete_id, discipline AS event, mark, CASE WHEN k % 17 = 0 THEN 'n/a' ELSE upper(strftime(d, '%-d %b ')) || y END AS date, score::DOUBLE AS score FROM top""")
def season_documents(t):
    """A folder of {year}.json, a map of athletes to results by event on each line."""
    o = toplist_rows(t).withColumn("id", F.regexp_extract("ProfileURL", r"-(\d+)$", 1))
    spark = o.sparkSession
    result = F.struct(F.col("Mark").alias("mark"), F.col("Date").alias("date"), F.col("Results Score").cast("double").alias("resultScore"))
    by_event = o.groupBy("year", "id", "discipline").agg(F.collect_list(result).alias("rs"))
    lines = by_event.groupBy("year", "id").agg(F.map_from_entries(F.collect_list(F.struct("discipline", "rs"))).alias("m")).select(F.concat("year", F.lit(".json")).alias("file"), F.to_json(F.create_map("id", "m")).alias("value"))
    path = scratch(lines, "seasons")
    lines.repartition("file").write.partitionBy("file").text(path)
    return readers.seasons(spark, f"{path}/file=*", lines=True).select("year", "athlete_id", "event", "mark", "date", F.col("resultScore").alias("score"))


# Nested results of competitions: an order is a competition, its return flags are events, its lines are athletes in two races.

NESTED_SQL = """l AS (SELECT l_orderkey AS competition, year(l_shipdate) AS y, l_linestatus AS discipline, l_returnflag AS flag, l_suppkey AS id, 'S' || l_suppkey AS name, l_linenumber AS place, CAST(l_extendedprice AS VARCHAR) AS mark, CASE WHEN l_linenumber % 3 = 0 THEN 'Heat' ELSE 'Final' END AS race FROM lineitem),
e AS (SELECT *, min(flag) OVER (PARTITION BY competition, discipline) AS first FROM l)"""


def nested(t):
    """competition, year, events of discipline and races of results; a discipline may be listed several times."""
    x = t("lineitem").select(F.col("l_orderkey").alias("competition"), F.col("l_linestatus").alias("discipline"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") % 3 == 0, "Heat").otherwise("Final").alias("race"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_linenumber").cast("int").alias("place"), F.col("l_suppkey").alias("athlete_id"))
    # an athlete's id is missing from heats; born in the year of its number
    row = F.struct("name", "place", F.when(F.col("race") == "Final", F.col("athlete_id")).alias("athlete_id"), F.concat(F.lit("1 JAN "), (1970 + F.col("athlete_id") % 40).cast("string")).alias("birth_date"))
    races = x.groupBy("competition", "discipline", "flag", "race").agg(F.array_sort(F.collect_list(row)).alias("results"))
    events = races.groupBy("competition", "discipline", "flag").agg(F.array_sort(F.collect_list(F.struct("race", "results"))).alias("races"))
    lists = F.array_sort(F.collect_list(F.struct("flag", "discipline", "races")))
    return events.groupBy("competition").agg(F.transform(lists, lambda v: F.struct(v["discipline"].alias("discipline"), v["races"].alias("races"))).alias("events")).withColumn("year", F.lit(2026))


@query(f"""WITH {NESTED_SQL}, f AS (SELECT competition, discipline, min(flag) AS flag FROM l WHERE race = 'Final' GROUP BY 1, 2) SELECT l.competition, l.discipline, name, place::BIGINT AS place, count(*) AS n FROM l JOIN f USING (competition, discipline, flag) WHERE race = 'Final' AND id % 2 = 0 GROUP BY ALL""")
def finals_of_nested_results(t):
    """Final rounds, of an event listed twice the first, of known athletes."""
    known = t("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return readers.finals_of_competition(nested(t), known).groupBy("competition", "discipline", "name", "place").agg(F.count("*").alias("n"))


@query(f"""WITH {NESTED_SQL} SELECT DISTINCT competition, discipline, name, id AS athlete_id, '1 JAN ' || (1970 + id % 40) AS birth_date FROM l WHERE race = 'Final'""")
def athletes_of_nested_results(t):
    return readers.competition_athletes(nested(t)).drop("year")


@query("""SELECT o_orderpriority AS event, s_name AS name, 'N' || s_nationkey AS nation, s_suppkey AS id FROM (SELECT DISTINCT o_orderpriority, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority NOT LIKE '5%') JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT '5-LOW', NULL, NULL, NULL""")
def entries_of_documents(t):
    """Entry lists as nested documents; an event without entrants stays."""
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("event"))
    who = t("lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").where("NOT event LIKE '5%'").select("event", "l_suppkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lists = who.groupBy("event").agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation"), F.col("s_suppkey").alias("id"))).alias("athletes"))
    none = lists.limit(0).select("event", "athletes")
    docs = lists.unionByName(none).unionByName(t("orders").where("o_orderpriority LIKE '5%'").select(F.lit("5-LOW").alias("event"), F.lit(None).cast(lists.schema["athletes"].dataType).alias("athletes")).distinct())
    return readers.entries(docs)


# Documents of flags and of standings.


@query("""SELECT s_name AS athlete, CASE WHEN s_acctbal < 0 THEN 'remove' ELSE 'watch' END AS status, s_nationkey::BIGINT AS discipline, CASE WHEN s_suppkey % 2 = 0 THEN '"Story ' || s_suppkey || '" (Wire, 2026-01-0' || (s_suppkey % 9 + 1) || ')' END AS reason FROM supplier""")
def flags_of_document(t):
    """The athletes' map of a document of flags, each with its last story as evidence."""
    s = t("supplier")
    story = F.struct(F.concat(F.lit("Story "), F.col("s_suppkey").cast("string")).alias("headline"), F.lit("u").alias("url"), F.lit("Wire").alias("source"), F.array(F.lit("knee")).alias("keywords"), F.concat(F.lit("2026-01-0"), (F.col("s_suppkey") % 9 + 1).cast("string")).alias("published"))
    old = story.withField("headline", F.lit("Older"))
    value = F.struct(F.when(F.col("s_acctbal") < 0, "remove").otherwise("watch").alias("status"), F.array(F.col("s_nationkey").cast("string")).alias("disciplines"), F.when(F.col("s_suppkey") % 2 == 0, F.array(old, story)).otherwise(F.array().cast(f"array<{s.select(story.alias('x')).schema['x'].dataType.simpleString()}>")).alias("matches"))
    doc = s.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("s_name", value))).alias("athletes"))).alias("value"))
    path = scratch(doc, "flags")
    doc.write.text(path)
    return readers.flags(s.sparkSession, path).select("athlete", "status", F.element_at("disciplines", 1).cast("long").alias("discipline"), T.evidence(F.col("matches")).alias("reason"))


@query("""SELECT c_mktsegment AS discipline, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, c_name AS name, c_acctbal AS points, 8::BIGINT AS qual_limit FROM customer""")
def standings_of_document(t):
    """A document of standings, a map of disciplines to rows."""
    c = t("customer").withColumn("rank", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("c_name").alias("name"), F.lit("GBR").alias("country"), F.lit(3).alias("events"), F.col("c_acctbal").alias("points"))))
    by = c.groupBy("c_mktsegment").agg(F.struct(F.lit(8).alias("qualLimit"), rows.alias("standings")).alias("s"))
    doc = by.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "s"))).alias("disciplines"))).alias("value"))
    path = scratch(doc, "standings")
    doc.write.text(path)
    return readers.standings(c.sparkSession, path).select("discipline", "rank", "name", "points", "qual_limit")


@query("""WITH r AS (SELECT l_suppkey AS id, l_linestatus AS event, l_quantity * 20 AS score, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, l_orderkey AS k FROM lineitem)
SELECT id AS athlete_id, event AS discipline, max(score) AS score, arg_max(d, (score, -epoch(CAST(d AS TIMESTAMP)))) AS date FROM r WHERE n <> 1 AND n <> 2 AND n <> 3 AND k % 11 <> 0 AND d < DATE '1997-06-01' GROUP BY 1, 2""")
def profile_bests(t):
    """Nested profiles to each event's best score before a day: legal, outdoor, electronic and dated results only."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    result = F.struct(F.when(k % 11 == 0, "soon").otherwise(F.upper(F.date_format("l_shipdate", "d MMM yyyy"))).alias("date"), F.when(n == 2, "9.8h").otherwise("9.80").alias("mark"), F.lit("Rome").alias("venue"), F.when(n == 3, "Cup (i)").otherwise("Cup").alias("competition"), (n == 1).alias("notLegal"), (F.col("l_quantity") * 20).alias("resultScore"))
    by = t("lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.collect_list(result).alias("results"))
    profiles = by.groupBy(F.col("l_suppkey").alias("athlete_id")).agg(F.collect_list(F.struct(F.col("l_linestatus").alias("discipline"), F.lit(False).alias("indoor"), "results")).alias("resultsByEvent"))
    path = scratch(profiles, "profiles")
    profiles.write.json(path)
    rows = readers.profile_results(readers.profiles(profiles.sparkSession, path, lines=True))
    return readers.profile_best(rows, ["athlete_id", "discipline"], F.lit("1997-06-01").cast("date"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_shipdate AS DATE) END AS date, CASE WHEN l_orderkey % 17 <> 0 THEN round_even((CAST(l_shipdate AS DATE) - DATE '1970-01-05') / 365.25, 1)::DOUBLE END AS age, CASE l_linenumber % 2 WHEN 0 THEN 104.2e0 ELSE 9.5e0 END AS value, NULL::VARCHAR AS wind FROM lineitem WHERE l_linenumber % 5 <> 0""")
def cleaned_season(t):
    """A season's rows with dates, age and value; those without a mark go, and a missing wind column is added."""
    n = F.col("l_linenumber")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 17 == 0, "n/a").otherwise(F.date_format("l_shipdate", "d MMM yyyy")).alias("date"), F.lit("5 JAN 1970").alias("dob"), F.when(n % 5 != 0, F.when(n % 2 == 0, "1:44.20").otherwise("9.50")).alias("mark"))
    return readers.cleaned(rows).select("l_orderkey", "l_linenumber", "date", "age", "value", "wind")


# Results pages: an order is a page with a table of its lines.

CELL = "CASE l_linenumber % 4 WHEN 0 THEN 'Silver medal' ELSE l_linenumber || '.' END"


def result_pages(t):
    """Pages with headings, a results table (places as digits or medal pictures, non-finishers, header echoes, wind rows) and standings."""
    n = F.col("l_linenumber")
    place = F.when(n % 4 == 0, '<img alt="Silver medal">').otherwise(F.concat(n.cast("string"), F.lit(".")))
    mark = F.when(n == 5, "DNF").otherwise(F.col("l_quantity").cast("int").cast("string"))
    row = F.concat(F.lit("<tr><td>"), place, F.lit('</td><td><a href="/a-'), F.col("l_suppkey").cast("string"), F.lit('">Ann &amp; '), F.col("l_suppkey").cast("string"), F.lit("</a></td><td>"), mark, F.lit("</td></tr>"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_suppkey").alias("s"), row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    head = "<tr><th>Pos</th><th>Athlete</th><th>Mark</th></tr>"
    echo = "<tr><td>Pos</td><td>Athlete</td><td>Mark</td></tr><tr><td>Wind</td><td>+1.0</td><td></td></tr>"
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    points = F.concat(F.lit("<tr><td>"), (F.col("o_custkey") % 9).cast("string"), F.lit("</td><td>C"), F.col("o_custkey").cast("string"), F.lit("</td><td>GBR</td><td>4</td><td>"), F.format_number(F.floor("o_totalprice"), 0), F.lit("</td></tr><tr><td>-</td><td>x</td><td>y</td><td>1</td><td>2</td></tr>"))
    page = F.concat(F.lit("<h1>Meet</h1><h2>Old</h2><h2>Men</h2><h3>100 Metres</h3><table>"), F.lit(head), "rows", F.lit(echo), F.lit("</table><h2>Table</h2><table>"), points, F.lit("</table>"))
    return o.join(rows, "l_orderkey").select(F.col("l_orderkey").alias("page_id"), page.alias("html"))


@query("""SELECT l_orderkey AS page_id, 'Meet / Men / 100 Metres' AS race, CASE l_linenumber % 4 WHEN 0 THEN 2 ELSE l_linenumber END::BIGINT AS place, 'Ann & ' || l_suppkey AS athlete, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS mark FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 5""")
def html_results(t):
    """Results pages to placed rows with their section path; no non-finishers, header echoes or wind rows."""
    return html.results(html.table_rows(result_pages(t), ["page_id"]), ["page_id"])


@query("""SELECT o_orderkey AS page_id, o_custkey % 9 AS rank, 'C' || o_custkey AS name, 'GBR' AS country, 4::BIGINT AS events, floor(o_totalprice)::DOUBLE AS points FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def html_standings(t):
    """Standings among the pages' tables: five cells or more, a number for rank, points with separators."""
    return html.standings(html.table_rows(result_pages(t), ["page_id"]), ["page_id"])


# Careers.

CATEGORIES = ["Olympic Games", "World Championships", "World U20 Championships", "European Championships", "Asian Games", "National Championships", "Diamond League Final"]


@query(f"""WITH h AS (SELECT s_suppkey AS athlete, list_extract({CATEGORIES}, CAST(l_partkey % 7 + 1 AS INTEGER)) AS category, l_partkey % 7 AS c, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_linenumber END AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 10 = 0 OR l_partkey % 7 IN (2, 5) OR (s_suppkey % 2 = 0 AND l_partkey % 7 IN (3, 4))),
g AS (SELECT athlete, category, c, count(*) AS results, count(CASE WHEN place = 1 THEN 1 END) AS gold, count(CASE WHEN place = 2 THEN 1 END) AS silver, count(CASE WHEN place = 3 THEN 1 END) AS bronze, CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 14 END AS tier FROM h GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY tier, gold DESC, gold + silver + bronze DESC, category) AS honour_no FROM g),
b AS (SELECT athlete, tier, CASE tier WHEN 1 THEN 'Olympic' WHEN 2 THEN 'World' WHEN 3 THEN 'Diamond League Final' WHEN 5 THEN 'European' ELSE 'Asian Games' END AS label, CASE WHEN gold > 0 THEN gold WHEN silver > 0 THEN silver ELSE bronze END AS k, CASE WHEN gold > 0 THEN 'champion' WHEN silver > 0 THEN 'silver' ELSE 'bronze' END AS word FROM g WHERE tier < 14 AND gold + silver + bronze > 0),
d AS (SELECT athlete, string_agg(CASE WHEN k > 1 THEN k || '× ' ELSE '' END || label || ' ' || word, ' · ' ORDER BY tier) FILTER (j <= 3) AS headline FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY tier) AS j FROM (SELECT *, min(tier) OVER (PARTITION BY athlete) <= 4 AS world FROM b) WHERE NOT world OR tier <= 4) GROUP BY 1),
w AS (SELECT s_suppkey AS athlete, s_nationkey + 1 AS overall, 2::BIGINT AS n_events, s_suppkey % 7 + 1 AS best_place FROM supplier WHERE s_suppkey % 3 = 0),
p AS (SELECT l_suppkey AS athlete, count(*) AS bests, count(DISTINCT l_linestatus) AS event_count, count(CASE WHEN l_linenumber = 1 THEN 1 END) AS indoor FROM lineitem WHERE l_quantity = 50 GROUP BY 1),
k AS (SELECT athlete, string_agg(category || ' ' || gold || '-' || silver || '-' || bronze || '/' || results, '; ' ORDER BY honour_no) AS honours FROM n GROUP BY 1)
SELECT athlete, headline, honours, overall::BIGINT AS overall, n_events, best_place, coalesce(bests, 0) AS bests, event_count, indoor FROM k FULL JOIN d USING (athlete) FULL JOIN w USING (athlete) FULL JOIN p USING (athlete)""")
def career_blocks(t):
    """Honours by what the championship is, their headline, rankings and personal bests of each athlete."""
    l = t("lineitem").withColumn("c", F.col("l_partkey") % 7)  # noqa: E741
    names = F.array(*map(F.lit, CATEGORIES))
    s = F.col("l_suppkey")
    kept = l.where((s % 10 == 0) | F.col("c").isin(2, 5) | ((s % 2 == 0) & F.col("c").isin(3, 4)))
    honours = kept.select(s.alias("athlete"), F.element_at(names, (F.col("c") + 1).cast("int")).alias("category"), F.col("l_orderkey").cast("string").alias("competition"), F.lit("9.80").alias("mark"), F.when(F.col("l_orderkey") % 4 != 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("."))).alias("place"))
    ranks = t("supplier").where("s_suppkey % 3 = 0")
    rankings = ranks.select(F.col("s_suppkey").alias("athlete"), F.inline(F.array(F.struct(F.lit("Women's 100m").alias("event"), (F.col("s_suppkey") % 7 + 1).alias("place")), F.struct(F.lit("Women's 200m").alias("event"), F.lit(9).cast("long").alias("place")), F.struct(F.lit("Women's Overall Ranking").alias("event"), (F.col("s_nationkey") + 1).cast("long").alias("place")), F.struct(F.lit("Women's Relay").alias("event"), F.lit(None).cast("long").alias("place")))))
    bests = l.where("l_quantity = 50").select(s.alias("athlete"), F.col("l_linestatus").alias("discipline"), F.lit("9.80").alias("mark"), F.when(F.col("l_linenumber") == 1, "Oslo (i)").otherwise("Rome").alias("venue"), F.date_format("l_shipdate", "d MMM yyyy").alias("date"))
    out = C.career(honours, rankings, bests, ["athlete"])
    shown = F.array_join(F.transform("honours", lambda h: F.concat(h["category"], F.lit(" "), h["gold"].cast("string"), F.lit("-"), h["silver"].cast("string"), F.lit("-"), h["bronze"].cast("string"), F.lit("/"), F.size(h["results"]).cast("string"))), "; ")
    return out.select("athlete", "headline", shown.alias("honours"), "overall", F.size("events").cast("long").alias("n_events"), F.get("events", F.lit(0))["place"].cast("long").alias("best_place"), F.coalesce(F.size("bests"), F.lit(0)).cast("long").alias("bests"), "event_count", F.size(F.filter("bests", lambda b: b["indoor"])).cast("long").alias("indoor"))
