"""Headline, alias and mention queries over documents: texts as headlines, frequent long words as names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlens.functions import text as T
from meetlens.operators import aggregates as A
from meetlens.operators import mentions as M
from meetlens.plans.base import query

HARD, SOFT = ["idiot", "loser", "scum"], ["clown", "trash", "pathetic"]
CODES = "WITH h AS (SELECT doc_id, lower(text) AS x, source, lang, n_chars FROM documents)"


def _heads(t):
    return t("documents").select("doc_id", F.lower("text").alias("x"), "source", "lang", "n_chars")


def _hits(words):
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda k: regexp_matches(x, '\\b' || k || '\\b'))"


@query(f"{CODES} SELECT doc_id, array_to_string({_hits(HARD)}, ',') AS hard, array_to_string({_hits(SOFT)}, ',') AS soft FROM h WHERE len({_hits(HARD + SOFT)}) > 0")
def keyword_hits(t):
    out = _heads(t).select("doc_id", T.whole_word_hits("x", HARD).alias("hard"), T.whole_word_hits("x", SOFT).alias("soft"))
    return out.where((F.size("hard") > 0) | (F.size("soft") > 0)).withColumns({c: F.array_join(c, ",") for c in ("hard", "soft")})


@query("""WITH tok AS (SELECT s_suppkey AS id, unnest(string_split(lower(s_name) || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN 'star' || (s_suppkey // 2) ELSE 'common' END, ' ')) AS tk FROM supplier)
SELECT tk AS alias, min(id) AS id FROM tok WHERE length(tk) >= 3 AND tk <> 'star4' GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def alias_unique_tokens(t):
    name = F.concat(F.lower("s_name"), F.lit(" "), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("star"), F.floor(F.col("s_suppkey") / 2).cast("string"))).otherwise("common"))
    return M.unique_tokens(t("supplier").select(F.col("s_suppkey").alias("id"), name.alias("name")), "id", "name", ["star4"])


ALIASES = "a AS (SELECT n_nationkey AS id, list_extract(['idiot','loser','scum','clown','trash','pathetic','worthless','moron','stupid','disgusting'], n_nationkey + 1) AS alias FROM nation WHERE n_nationkey < 10)"


def _aliases(t):
    words = F.array(*map(F.lit, ["idiot", "loser", "scum", "clown", "trash", "pathetic", "worthless", "moron", "stupid", "disgusting"]))
    return t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.element_at(words, (F.col("n_nationkey") + 1).cast("int")).alias("alias"))


@query(f"""{CODES}, {ALIASES} SELECT doc_id, CAST(id AS BIGINT) AS id, alias FROM h JOIN a ON regexp_matches(x, '\\b' || alias || '\\b')""")
def mention_join(t):
    return M.mentions(_heads(t), "doc_id", "x", _aliases(t), "id", "alias")


@query("""WITH items AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' ') AS w FROM benchmark),
a AS (SELECT DISTINCT item_id AS id, array_to_string(w[k:k + n - 1], ' ') AS alias FROM items, (VALUES (1, 2), (2, 3), (4, 5)) AS v(k, n) WHERE len(w) >= k + n - 1),
d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS x FROM documents)
SELECT doc_id, id, alias FROM d JOIN a ON contains(x, ' ' || alias || ' ')""")
def mention_phrases(t):
    """Aliases of two, three and five words: phrases of the benchmark's items, wherever a document has them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), F.lit(1))
    phrases = F.array(*(F.when(F.size(words) >= k + n - 1, F.array_join(F.slice(words, k, n), " ")) for k, n in ((1, 2), (2, 3), (4, 5))))
    aliases = t("benchmark").select(F.col("item_id").alias("id"), F.explode(phrases).alias("alias")).where("alias IS NOT NULL")
    return M.mentions(_heads(t), "doc_id", "x", aliases, "id", "alias")


@query(f"""{CODES}, n AS (SELECT doc_id, x, unnest(['loser','scum','clown','moron']) AS name, strpos(x, 'idiot') AS kp FROM h WHERE contains(x, 'idiot')), p AS (SELECT *, strpos(x, name) AS pos FROM n WHERE contains(x, name))
SELECT doc_id, arg_min(name, (abs(pos - kp), pos)) AS nearest FROM p GROUP BY 1""")
def keyword_nearest(t):
    names = F.array(*map(F.lit, ["loser", "scum", "clown", "moron"]))
    return _heads(t).where(F.contains("x", F.lit("idiot"))).select("doc_id", T.nearest_name("x", names, F.lit("idiot")).alias("nearest")).where("nearest IS NOT NULL")


STATUS = f"CASE WHEN len({_hits(HARD)}) > 0 THEN 'remove' WHEN len({_hits(SOFT)}) > 0 THEN 'watch' END"


def _articles(t):
    h = _heads(t).withColumns({"hard": T.whole_word_hits("x", HARD), "soft": T.whole_word_hits("x", SOFT)})
    return h.withColumns({"status": T.decision(F.col("hard"), F.col("soft"), F.lit(False), F.lit(True)), "keywords": F.concat("hard", "soft"), "url": F.concat("lang", F.lit("-"), (F.col("n_chars") % 500).cast("string")), "headline": F.substring("x", 1, 40)}).where("status IS NOT NULL")


@query(f"""{CODES}, m AS (SELECT *, {STATUS} AS status, list_concat({_hits(HARD)}, {_hits(SOFT)}) AS kw, lang || '-' || (n_chars % 500) AS url, left(x, 40) AS headline FROM h),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY doc_id DESC, headline) AS k FROM m WHERE status IS NOT NULL) WHERE k = 1)
SELECT source, count(*) AS articles, string_agg(headline, ' | ' ORDER BY doc_id DESC, headline DESC) AS headlines, array_to_string(list_sort(list_distinct(flatten(list(kw)))), ',') AS keywords, CASE max(CASE status WHEN 'remove' THEN 2 ELSE 1 END) WHEN 2 THEN 'remove' ELSE 'watch' END AS status, max(doc_id) AS newest FROM o GROUP BY 1""")
def news_rollup(t):
    out = A.news_rollup(_articles(t), ["source"], "url", "headline", "doc_id", "status", "keywords")
    return out.withColumns({"headlines": F.array_join("headlines", " | "), "keywords": F.array_join("keywords", ",")})


@query(f"""{CODES}, f AS (SELECT source, max(doc_id) AS flagged FROM h WHERE {STATUS} IS NOT NULL GROUP BY 1), r AS (SELECT source, max(doc_id) AS back FROM h WHERE contains(x, 'mit license') GROUP BY 1) SELECT f.source, f.flagged FROM f LEFT JOIN r USING (source) WHERE back IS NULL OR back <= flagged""")
def supersede_flags(t):
    flags = _articles(t).groupBy("source").agg(F.max("doc_id").alias("flagged"))
    returns = _heads(t).where(F.contains("x", F.lit("mit license"))).select("source", F.col("doc_id").alias("back"))
    return M.superseded(flags, returns, ["source"], "flagged", "back")


@query(f"""{CODES} SELECT doc_id, length(x) AS n FROM h WHERE contains(x, 'clown') AND regexp_matches(substr(x, strpos(x, 'clown') + 5, 40), '\\bthe\\b')""")
def keyword_behind_name(t):
    near = F.regexp_like(F.substring(F.col("x"), F.position(F.lit("clown"), F.col("x")) + 5, F.lit(40)), F.lit(r"\bthe\b"))
    return _heads(t).where(F.contains("x", F.lit("clown")) & near).select("doc_id", F.length("x").alias("n"))


@query("""SELECT doc_id, source, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id) AS k FROM (SELECT doc_id, source, n_chars AS n FROM documents WHERE contains(lower(text), 'license'))) WHERE k <= 3""")
def results_articles(t):
    d = t("documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "source", F.col("n_chars").alias("n"))
    return d.orderBy(F.desc("n"), "doc_id").limit(3)


@query("""SELECT source, count(DISTINCT lang) AS langs, count(*) AS n, count(CASE WHEN n <= 2 THEN 1 END) AS firsts FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) GROUP BY 1""")
def honours_rollup(t):
    d = t("documents").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return d.groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count("*").alias("n"), F.count_if(F.col("n") <= 2).alias("firsts"))


PARTS = {"knee": (6, 20), "hamstring": (3, 12), "back": (2, 8), "ankle": (3, 20)}
STORY_SQL = """h AS (SELECT o_orderkey AS k, 'Tara Davis' || CASE k % 4 WHEN 0 THEN '-Woodhall' WHEN 1 THEN ' - Woodhall' WHEN 2 THEN '' ELSE '\u2013Woodhall' END || CASE k % 5 WHEN 0 THEN ' tears knee' WHEN 1 THEN ' has hamstring and ankle trouble' WHEN 2 THEN ' is back' WHEN 3 THEN ' kneels' ELSE ' hamstring' END
 || CASE k % 3 WHEN 0 THEN ', surgery next' WHEN 1 THEN ', minor' ELSE '' END || CASE k % 2 WHEN 0 THEN ' and dnf' ELSE ', a long way behind all others in it: dnf' END AS x FROM (SELECT *, o_orderkey AS k FROM orders)),
w AS (SELECT *, CASE k % 5 WHEN 0 THEN [6, 20] WHEN 1 THEN [3, 20] WHEN 2 THEN [2, 8] WHEN 4 THEN [3, 12] END AS r FROM h)"""


@query(f"""WITH {STORY_SQL} SELECT k, k % 4 IN (0, 3) AS half, CASE WHEN r IS NULL THEN NULL WHEN k % 3 = 0 THEN greatest(r[1], 12) WHEN k % 3 = 1 THEN greatest(r[1] // 2, 1) ELSE r[1] END::BIGINT AS low, CASE WHEN r IS NULL THEN NULL WHEN k % 3 = 0 THEN greatest(r[2], 26) WHEN k % 3 = 1 THEN greatest(r[2] // 2, 1) ELSE r[2] END::BIGINT AS high,
regexp_matches(substr(x, strpos(x, 'Davis') + 5, 40), '\\bdnf\\b') AS dnf, substr(x, 1, 11) AS near FROM w""")
def story_rules(t):
    """Halves of double names, weeks of recovery by body part and severity, non-finishers behind a name, text about it."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Tara Davis"), F.when(k % 4 == 0, "-Woodhall").when(k % 4 == 1, " - Woodhall").when(k % 4 == 2, "").otherwise("\u2013Woodhall"))
    hurt = F.when(k % 5 == 0, " tears knee").when(k % 5 == 1, " has hamstring and ankle trouble").when(k % 5 == 2, " is back").when(k % 5 == 3, " kneels").otherwise(" hamstring")
    end = F.when(k % 3 == 0, ", surgery next").when(k % 3 == 1, ", minor").otherwise("")
    o = t("orders").select(k.alias("k"), F.concat(name, hurt, end, F.when(k % 2 == 0, " and dnf").otherwise(", a long way behind all others in it: dnf")).alias("x"))
    weeks = T.recovery_weeks("x", PARTS, ["surgery", "rupture"], ["minor", "slight"])
    return o.select("k", T.part_of_double_name("x", F.lit("davis")).alias("half"), weeks["low"].alias("low"), weeks["high"].alias("high"), T.did_not_finish_near("x", F.lit("Davis")).alias("dnf"), T.around("x", F.lit("Davis"), 100, 6).alias("near"))
