"""Marks, places, dates, names and nested documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlens.functions import marks, names
from meetlens.plans.base import query
from meetlens.sources import html


@query("""WITH m AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN CAST(l_quantity AS VARCHAR) WHEN 1 THEN '1:' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') || '.20' WHEN 2 THEN CAST(l_quantity AS VARCHAR) || 'm' ELSE 'NM' END AS mark FROM lineitem)
SELECT l_orderkey, l_linenumber, mark, CASE WHEN mark LIKE '%m' THEN TRY_CAST(left(mark, length(mark) - 1) AS DOUBLE) WHEN mark LIKE '%:%' THEN TRY_CAST(split_part(mark, ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part(mark, ':', 2) AS DOUBLE) ELSE TRY_CAST(mark AS DOUBLE) END AS value,
 CASE WHEN mark LIKE '%:%' THEN TRY_CAST(split_part(mark, ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part(mark, ':', 2) AS DOUBLE) ELSE TRY_CAST(mark AS DOUBLE) END AS clock FROM m""")
def mark_parse(t):
    q = F.col("l_quantity")
    mark = F.when(F.col("l_orderkey") % 4 == 0, q.cast("string")).when(F.col("l_orderkey") % 4 == 1, F.concat(F.lit("1:"), F.lpad(q.cast("int").cast("string"), 2, "0"), F.lit(".20"))).when(F.col("l_orderkey") % 4 == 2, F.concat(q.cast("string"), F.lit("m"))).otherwise("NM")
    return t("lineitem").select("l_orderkey", "l_linenumber", mark.alias("mark")).withColumns({"value": marks.mark_value("mark"), "clock": marks.clock_value("mark")})


@query("""WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS n, CASE l_orderkey % 6 WHEN 0 THEN l_linenumber || '' WHEN 1 THEN l_linenumber || '.' WHEN 2 THEN l_linenumber || 'f1' WHEN 3 THEN l_linenumber || 'h3' WHEN 4 THEN l_linenumber || 'sf2' ELSE '' END AS pos FROM lineitem)
SELECT l_orderkey, n, pos, CASE WHEN NOT regexp_matches(pos, '(?i)\\d\\s*(h|sf|qf|q|r)\\s*\\d*$') THEN TRY_CAST(regexp_extract(pos, '^(\\d+)', 1) AS BIGINT) END AS place, NOT regexp_matches(pos, '(?i)\\d\\s*(h|sf|qf|q|r)\\s*\\d*$') AS is_final,
 CASE WHEN regexp_matches(pos, '^\\d+(\\.0?)?$') THEN TRY_CAST(regexp_extract(pos, '^(\\d+)', 1) AS BIGINT) END AS whole FROM p""")
def place_parse(t):
    n, k = F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 6
    pos = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("."))).when(k == 2, F.concat(n, F.lit("f1"))).when(k == 3, F.concat(n, F.lit("h3"))).when(k == 4, F.concat(n, F.lit("sf2"))).otherwise("")
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), pos.alias("pos")).withColumns({"place": marks.place("pos"), "is_final": marks.is_final("pos"), "whole": marks.whole_place("pos")})


@query("""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS n, l_quantity + l_discount * 10 + l_linenumber * 40 AS v FROM lineitem) SELECT l_orderkey, n, printf('%.2fm', v) AS field, printf('%.2f', v) AS track,
CASE WHEN v >= 60 THEN CAST(CAST(floor(v / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(printf('%.2f', v - floor(v / 60) * 60), 5, '0') ELSE printf('%.2f', v) END AS clock FROM x""")
def format_mark(t):
    v = F.col("l_quantity") + F.col("l_discount") * 10 + F.col("l_linenumber") * 40
    x = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), v.alias("v"))
    no, yes = F.lit(False), F.lit(True)
    return x.select("l_orderkey", "n", marks.format_mark("v", yes, no).alias("field"), marks.format_mark("v", no, no).alias("track"), marks.format_mark("v", no, yes).alias("clock"))


@query("""SELECT DISTINCT p_size::BIGINT AS n, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM part""")
def ordinal(t):
    return t("part").select(F.col("p_size").alias("n")).distinct().withColumn("ordinal", marks.ordinal("n"))


@query("""SELECT o_orderkey, round_even(date_diff('day', DATE '1960-02-29' + CAST(o_custkey % 9000 AS INTEGER), CAST(o_orderdate AS DATE)) / 365.25::DOUBLE, 1) AS age FROM orders""")
def age_years(t):
    born = F.date_add(F.lit("1960-02-29").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return t("orders").select("o_orderkey", marks.age_years(born, "o_orderdate").alias("age"))


@query("""SELECT o_orderkey, CAST(least(20, greatest(0, floor(date_diff('day', make_date(year(o_orderdate), 5, 1), CAST(o_orderdate AS DATE)) / 7e0))) AS BIGINT) AS week FROM orders""")
def season_week(t):
    return t("orders").select("o_orderkey", marks.season_week("o_orderdate").alias("week"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN upper(strftime(o_orderdate, '%-d %b %Y')) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS c FROM orders) SELECT o_orderkey, c, CASE WHEN c <> 'soon' THEN coalesce(TRY_CAST(try_strptime(c, '%d %b %Y') AS DATE), TRY_CAST(try_strptime(c, '%Y-%m-%d') AS DATE)) END AS d FROM x""")
def date_parse(t):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    c = F.when(k == 0, F.upper(F.date_format(d, "d MMM yyyy"))).when(k == 1, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    return t("orders").select("o_orderkey", c.alias("c")).withColumn("d", marks.result_date("c"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS n, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN '+' || l_quantity / 10 ELSE '-' || l_quantity / 10 END AS wind FROM lineitem) SELECT l_orderkey, n, TRY_CAST(replace(wind, '+', '') AS DOUBLE) AS wind FROM x""")
def wind_parse(t):
    q = (F.col("l_quantity") / 10).cast("string")
    wind = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(F.lit("+"), q)).otherwise(F.concat(F.lit("-"), q))
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), marks.wind_reading(wind).alias("wind"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(trim(p_name)) AS name_key, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS field_key FROM part""")
def name_keys(t):
    return t("part").select("p_partkey", names.slug("p_name").alias("slug"), names.name_key("p_name").alias("name_key"), names.field_key("p_name").alias("field_key"))


@query("""WITH s AS (SELECT p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_name FROM part) SELECT p_brand, slug, count(DISTINCT p_name) AS names FROM (SELECT p_brand, left(slug, 6) AS slug, p_name FROM s) GROUP BY 1, 2 HAVING count(DISTINCT p_name) > 1""")
def slug_collisions(t):
    s = t("part").select("p_brand", F.substring(names.slug("p_name", names.fold_latin), 1, 6).alias("slug"), "p_name")
    return s.groupBy("p_brand", "slug").agg(F.count_distinct("p_name").alias("names")).where("names > 1")


@query("""WITH v AS (SELECT c_custkey, 'Stadium ' || c_custkey || ', ' || n_name || ' (' || upper(left(n_name, 3)) || ')' || CASE WHEN c_custkey % 5 = 0 THEN ' (i)' ELSE '' END AS venue FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, trim(regexp_extract(regexp_replace(venue, '\\s*\\([^)]*\\)', '', 'g'), '([^,]*)$', 1)) AS city, nullif(regexp_extract(venue, '\\(([A-Z]{3})\\)\\s*(?:\\(i\\))?\\s*$', 1), '') AS country, c_custkey % 5 = 0 AS indoor FROM v""")
def venue_split(t):
    n = t("nation").select("n_nationkey", "n_name")
    venue = F.concat(F.lit("Stadium "), F.col("c_custkey"), F.lit(", "), F.col("n_name"), F.lit(" ("), F.upper(F.substring("n_name", 1, 3)), F.lit(")"), F.when(F.col("c_custkey") % 5 == 0, " (i)").otherwise(""))
    v = t("customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", venue.alias("venue"))
    return v.select("c_custkey", marks.city("venue").alias("city"), marks.country_code("venue").alias("country"), marks.is_indoor("venue").alias("indoor"))


@query("""SELECT l_suppkey AS athlete, round(least(greatest(count(*), 1), 5) / 5e0 * greatest(0, 1 - coalesce(stddev_samp(l_quantity), 0) * 2 / 50), 6) AS consistency FROM lineitem WHERE l_linenumber = 1 AND l_discount = 0 GROUP BY 1""")
def consistency(t):
    g = t("lineitem").where("l_linenumber = 1 AND l_discount = 0").groupBy(F.col("l_suppkey").alias("athlete")).agg(F.count("*").alias("n"), (F.stddev_samp("l_quantity") * 2).alias("s"))
    return g.select("athlete", F.round(marks.consistency("n", "s"), 6).alias("consistency"))


@query("""SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def json_profile_flatten(t):
    return t("events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))


def _text(x):
    """Twin of an element's text: tags out, entities decoded, white space collapsed."""
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{c}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _elements(pattern):
    return f"SELECT page_id, unnest(range(len(m))) AS n, unnest(m) AS e FROM (SELECT page_id, regexp_extract_all(html, '{pattern}') AS m FROM pages)"


@query(f"""WITH x AS ({_elements('<a href="[^"]*">.*?</a>')}) SELECT page_id, n AS link_no, {_text("regexp_extract(e, 'href=\"([^\"]*)\"', 1)")} AS href, {_text("e")} AS anchor FROM x""")
def html_links(t):
    """Links of every page, by the UDTF; the twin holds for the pages' plain markup."""
    return html.links(t("pages"), ["page_id"])


@query(f"""WITH x AS ({_elements("<h[1-6]>.*?</h[1-6]>")}) SELECT page_id, n AS heading_no, CAST(substr(e, 3, 1) AS BIGINT) AS depth, {_text("e")} AS heading FROM x""")
def html_headings(t):
    return html.headings(t("pages"), ["page_id"])


@query()
def html_tables(t):
    return html.table_rows(t("pages"), ["page_id"])


@query("SELECT venue, count(*) AS n FROM (SELECT l_partkey AS venue FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY 1")
def venue_counts(t):
    from meetlens.sources.readers import venue_counts as counts

    return counts([t("lineitem").withColumnRenamed("l_partkey", "venue"), t("part").withColumnRenamed("p_partkey", "venue")])


@query("SELECT DISTINCT l_suppkey AS venue, CAST(l_shipdate AS DATE) AS date FROM lineitem")
def venue_dates(t):
    from meetlens.sources.readers import distinct_pairs

    return distinct_pairs([t("lineitem").select(F.col("l_suppkey").alias("venue"), F.to_date("l_shipdate").alias("date"))])


@query("""SELECT athlete, d, v, score FROM (SELECT o_custkey AS athlete, CAST(o_orderdate AS DATE) AS d, floor(o_totalprice / 50000) AS v, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS score, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE), floor(o_totalprice / 50000) ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END NULLS LAST) AS n FROM orders) WHERE n = 1""")
def season_history(t):
    o = t("orders").select(F.col("o_custkey").alias("athlete"), F.to_date("o_orderdate").alias("date"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("mark"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("score"))
    w = Window.partitionBy("athlete", "date", "mark").orderBy(F.asc_nulls_last("score"))
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("athlete", F.col("date").alias("d"), F.col("mark").alias("v"), "score")


# Dates, labels and identifiers as they are shown

@query("""SELECT o_orderkey, strftime(o_orderdate, '%d %b') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS iso,
CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS number, CAST(o_orderdate AS DATE) AS season_date, CAST(o_orderdate AS DATE) AS last_date
FROM orders""")
def shown_dates(t):
    d = F.col("o_orderdate")
    o = t("orders").withColumns({"dm": F.date_format(d, "dd MMM"), "y": F.year(d)})
    text = F.concat(F.lit("from 3 May 1990 to "), F.date_format(d, "d MMMM"), F.lit(", as said"))
    found = {"shown": marks.day_month(d), "iso": marks.iso(d), "number": marks.date_number(d), "season_date": marks.season_date("dm", "y"), "last_date": marks.last_date_in(text, "y")}
    return o.select("o_orderkey", *[c.alias(k) for k, c in found.items()])


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT *, CASE WHEN k <= 1 THEN d END AS known FROM o)
SELECT o_orderkey, strftime(known, '%d %b') AS shown, strftime(known, '%Y-%m-%d') AS iso, coalesce(CAST(strftime(known, '%Y%m%d') AS BIGINT), 0) AS number, CASE WHEN k = 5 THEN CAST(year(d) AS VARCHAR) WHEN k = 0 THEN strftime(d, '%Y-%m-%d') END AS born,
 CASE WHEN known IS NOT NULL THEN least(20, greatest(0, floor((d - make_date(year(d), 5, 1)) / 7.0)))::BIGINT END AS week, round_even((DATE '1999-06-01' - known) / 365.25, 1)::DOUBLE AS age,
 CASE WHEN k IN (0, 7) THEN d END AS last_date FROM f""")
def uneven_dates(t):
    """Dates as pages show them: upper case, ISO, a year alone, an impossible day, running text, a word, nothing, null."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    shown = F.date_format(d, "d MMM yyyy")
    text = F.when(k == 0, F.concat(F.upper(F.substring_index(shown, " ", 2)), F.lit(" "), F.year(d).cast("string"))).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, "").when(k == 3, "DNF")
    text = text.when(k == 5, F.year(d).cast("string")).when(k == 6, F.concat(F.lit("31 FEB "), F.year(d).cast("string"))).when(k == 7, F.concat(F.lit("on 3 May and then "), F.date_format(d, "d MMMM"), F.lit(" at Rome")))
    o = t("orders").select("o_orderkey", text.alias("text"), F.year(d).alias("y"), F.when(k == 0, F.initcap(text)).otherwise(text).alias("running"))
    found = {"shown": marks.day_month("text"), "iso": marks.iso("text"), "number": marks.date_number("text"), "born": marks.birth_date("text"), "week": marks.season_week("text"), "age": marks.age_years("text", F.lit("1999-06-01")), "last_date": marks.last_date_in("running", "y")}
    return o.select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query("""SELECT o_orderkey, CAST(o_orderkey % 1000 AS BIGINT) AS digits, o_totalprice AS loose, o_orderkey % 2 = 0 AS is_number,
CASE WHEN o_orderkey % 3 = 0 THEN 'Cup ' || year(o_orderdate) ELSE 'Cup ' || year(o_orderdate) END AS label,
greatest(0.01, least(0.99, (o_orderkey % 100) / 100.0))::DOUBLE AS clamped, 0.9 * pow(0.8, o_orderkey % 4)::DOUBLE AS weight,
CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) / 100.0 ELSE (o_orderkey % 100)::DOUBLE END::DOUBLE AS share FROM orders""")
def loose_scalars(t):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    o = t("orders").withColumns({
        "place": F.concat((k % 1000).cast("string"), F.lit(". heat")),
        "price": F.format_number("o_totalprice", 2),
        "text": F.when(k % 2 == 0, "12.5").otherwise("DNF"),
        "cup": F.when(k % 3 == 0, F.concat(F.lit("Cup "), y)).otherwise("Cup"),
        "y": y, "p": (k % 100) / 100, "ago": k % 4 + 1,
        "pct": F.concat((k % 100).cast("string"), F.when(k % 2 == 0, "%").otherwise("")),
    })
    found = {"digits": marks.leading_digits("place"), "loose": marks.loose_number("price"), "is_number": marks.is_number("text"), "label": marks.labelled_with_year("cup", "y")}
    found |= {"clamped": marks.clamped("p"), "weight": marks.fade_weight("ago", 0.9, 0.8), "share": marks.percent("pct")}
    return o.select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query("""SELECT p_partkey, p_partkey AS slug_id, p_partkey AS path_id, '100 metres' AS event, '100m' AS event_key, true AS matches,
false AS other, p_brand || ' / ' || p_type AS heading FROM part""")
def event_labels(t):
    k, sex = F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "Women's ").otherwise("Men's ")
    p = t("part").withColumns({"slug": F.concat(F.lit("a-name-"), k), "url": F.concat(F.lit("https://x/athletes/a-b-"), k, F.lit("/all")), "e": F.concat(sex, F.lit("100 metres")), "l": F.concat(sex, F.lit("100m 2"))})
    matches = names.label_matches(F.lit("Final 100m 2"), F.lit("final 100m"))
    found = {"slug_id": names.id_after_hyphen("slug"), "path_id": names.id_in_path("url", "athletes"), "event": names.without_gender("e"), "event_key": names.event_key("e"), "matches": matches}
    found |= {"other": names.label_matches("l", F.lit("200m")), "heading": names.heading_label(F.array("p_brand", "p_type"))}
    return p.select("p_partkey", *[c.alias(n) for n, c in found.items()])


@query("""SELECT s_suppkey, 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') AS title, 'supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') || ' o neil' AS matched,
['neil', 'o', 'supplier#' || lpad(s_suppkey::VARCHAR, 9, '0')] AS token_set, ['supplier#' || lpad(s_suppkey::VARCHAR, 9, '0'), 'o', 'neil'] AS tokens FROM supplier""")
def name_words(t):
    odd = F.concat(F.lit("  "), F.upper("s_name"), F.lit("  O'Neil "))
    found = {"title": names.title_name(F.upper("s_name")), "matched": names.match_text(odd), "token_set": names.token_set(odd), "tokens": names.tokens(odd)}
    return t("supplier").select("s_suppkey", *[c.alias(n) for n, c in found.items()])
