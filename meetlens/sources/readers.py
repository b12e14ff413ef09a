"""Readers: files of the logical tables as DataFrames. A missing file is an empty frame with the schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlens import schemas
from meetlens.functions import marks


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv(spark: SparkSession, path: str, schema: str, by_position: bool = True) -> DataFrame:
    """CSV with a header; the schema goes by position, since one column of toplists has a blank name. Bad fields are null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", by_position).option("mode", "PERMISSIVE").csv(path)


def with_discipline(df: DataFrame) -> DataFrame:
    """The discipline and season from the file's name (men_100m_2026.csv), which may be a folder of part files."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)\.csv(?:/part-[^/]*)?$", 1)
    return df.withColumns({"discipline": F.regexp_replace(name, r"(_\d{4})?(_meetings)?$", ""), "file_year": F.regexp_extract(name, r"_(\d{4})", 1).try_cast("int")})


def toplists(spark: SparkSession, path: str, lists: dict[str, str] | None = None) -> DataFrame:
    """Season toplists of every discipline, and of further lists (name: path); every row is kept, with its list."""
    frames = [with_discipline(csv(spark, p, schemas.TOPLIST).select("*", "_metadata") if exists(spark, p) else csv(spark, p, schemas.TOPLIST).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))).drop("_metadata").withColumn("list", F.lit(n)) for n, p in ({"world": path} | (lists or {})).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def season_scores(toplist: DataFrame, year: int | None = None) -> DataFrame:
    """Scored rows with a name, flagged indoor or not."""
    rows = toplist.dropna(subset=["score", "athlete"]).withColumn("indoor", marks.is_indoor("venue"))
    return rows if year is None else rows.where(F.col("year") == year)


def scoring_rows(toplist: DataFrame) -> DataFrame:
    """Rows without another source, with numbers, date and athlete id; those without year, score or date go."""
    from meetlens.functions.names import id_after_hyphen

    rows = toplist.where(F.col("source").isNull() | (F.col("source") == "toplist")) if "source" in toplist.columns else toplist
    return rows.select("athlete", "nat", F.col("year").try_cast("int").alias("year"), F.col("score").try_cast("double").alias("score"), marks.result_date("date").alias("date"), marks.result_date("dob").alias("dob"), id_after_hyphen("profile_url").alias("athlete_id"), "discipline").dropna(subset=["year", "score", "date"])


def normalised(df: DataFrame, source: str, priority: int, tier: Column | None = None) -> DataFrame:
    """Any source in the race log's shape: mark and place parsed, year from the date, meeting from the venue where missing."""
    have = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    date = have("date", "date") if dict(df.dtypes).get("date") == "date" else marks.result_date(have("date"))
    out = df.select(have("discipline").alias("discipline"), F.col("athlete"), have("mark").alias("mark"), marks.mark_value(have("mark")).alias("value"), marks.place(have("pos")).alias("place"), marks.is_final(have("pos")).alias("is_final"), date.alias("date"), have("year", "int").alias("year"), have("venue").alias("venue"), have("meeting").alias("meeting"), (tier if tier is not None else have("tier")).alias("tier"))
    return out.withColumns({"year": F.coalesce("year", F.year("date")), "meeting": F.coalesce("meeting", "venue"), "source": F.lit(source), "source_priority": F.lit(priority)})


def race_log(sources: list[DataFrame]) -> DataFrame:
    """One log of finals: of rows with one (discipline, athlete, date, mark) the source with the least priority stays."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    w = Window.partitionBy("discipline", "athlete", "date", "mark").orderBy("source_priority", F.asc_nulls_last("place"), "meeting")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND is_final").drop("_n")


def profiles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Profiles, a document a file, or a line each."""
    return spark.read.schema(schemas.PROFILE).option("multiLine", not lines).json(path) if exists(spark, path) else spark.createDataFrame([], schemas.PROFILE)


def profile_results(df: DataFrame) -> DataFrame:
    """A row per result of nested profiles."""
    events = df.select("athlete_id", F.explode("resultsByEvent").alias("e"))
    return events.select("athlete_id", F.col("e.discipline").alias("discipline"), F.col("e.indoor").alias("indoor"), F.explode("e.results").alias("r")).select("athlete_id", "discipline", "indoor", "r.*")


def seasons(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files {year}.json, each a map of athlete id to results by event: year, athlete_id, event, result. Text that is no such map gives
    none. lines: each line is a map of its own, so that a season of any size is read in parts; the file may be a folder of part files.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})\.json(?:/part-[^/]*)?$", 1).cast("int").alias("year"), F.from_json("value", f"map<string,map<string,array<{schemas.RESULT}>>>").alias("m"))
    return raw.select("year", F.explode("m").alias("athlete_id", "events")).select("year", "athlete_id", F.explode("events").alias("event", "rs")).select("year", "athlete_id", "event", F.explode("rs").alias("r")).select("year", "athlete_id", "event", "r.*")


def flags(spark: SparkSession, path: str) -> DataFrame:
    """Availability flags, a row per athlete; a missing or broken document gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "athlete string, status string, disciplines array<string>, matches array<struct<headline:string,url:string,source:string,keywords:array<string>,published:string>>")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"athletes {schemas.FLAGS}").alias("d"))
    return doc.select(F.explode("d.athletes").alias("athlete", "f")).select("athlete", "f.*")


def standings(spark: SparkSession, path: str) -> DataFrame:
    """Standings of every discipline: a map of discipline to rows, with its field size."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.STANDINGS)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "disciplines map<string,struct<qualLimit:int,standings:array<struct<rank:int,name:string,country:string,events:int,points:double>>>>").alias("d"))
    return doc.select(F.explode("d.disciplines").alias("discipline", "s")).select("discipline", F.explode("s.standings").alias("r"), F.col("s.qualLimit").alias("qual_limit")).select("discipline", "r.*", "qual_limit")


def finals_of_competition(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Nested competition results to rows of the final round; of one event listed twice the first; known names only.

    df: competition, year, events array<struct<discipline, races array<struct<race, results array<struct<name, place, mark>>>>>>.
    """
    rows = df.select("competition", "year", F.posexplode("events").alias("event_no", "e")).select("competition", "year", "event_no", F.col("e.discipline").alias("discipline"), F.explode("e.races").alias("r")).where("r.race = 'Final'").select("competition", "year", "event_no", "discipline", F.explode("r.results").alias("x")).select("competition", "year", "event_no", "discipline", "x.*")
    first = rows.withColumn("_m", F.min("event_no").over(Window.partitionBy("competition", "year", "discipline"))).where("event_no = _m").drop("_m", "event_no")
    return first if known is None else first.join(known.select("name").distinct(), "name", "left_semi")


def competition_athletes(df: DataFrame) -> DataFrame:
    """The first id and birth date of each (discipline, name) in a competition's nested results (as finals_of_competition)."""
    rows = df.select("competition", "year", F.posexplode("events").alias("_e", "e")).select("competition", "year", "_e", F.col("e.discipline").alias("discipline"), F.posexplode("e.races").alias("_r", "r")).select("competition", "year", "_e", "_r", "discipline", F.posexplode("r.results").alias("_i", "x")).select("*", "x.*")
    order = F.struct("_e", "_r", "_i")
    return rows.where("athlete_id IS NOT NULL").groupBy("competition", "year", "discipline", "name").agg(F.min_by("athlete_id", order).alias("athlete_id"), F.min_by("birth_date", order).alias("birth_date"))


def entries(df: DataFrame) -> DataFrame:
    """A row per entrant of nested entry lists (event, athletes array<struct<name, nation, id>>)."""
    return df.select("event", F.explode_outer("athletes").alias("a")).select("event", "a.*")


def entry_list(text: DataFrame, page: str = "text", event: str = r"^(.+?) \((\d+)\)$", athlete: str = r"^(\d+)\s+(.+)\s+[A-Z]{3}\b", sex: str = r"^(MEN|WOMEN)$") -> DataFrame:
    """Entry lists in running text to (event, athlete) rows, by patterns for the lines that name a sex, an event with its count
    and an athlete. A document in which any count disagrees with the rows found gives none."""
    import pandas as pd

    def one(batches):
        for rows in batches:
            out = []
            for doc, body in zip(rows["doc"], rows[page]):
                now, found, wanted = [None, None], {}, {}
                for line in map(str.strip, (body or "").splitlines()):
                    if m := re.match(sex, line.upper()):
                        now = [m[1].title(), None]
                    elif now[0] and (m := re.match(event, line)):
                        now[1] = f"{now[0]}'s {m[1].strip()}"
                        wanted[now[1]], found[now[1]] = int(m[2]), []
                    elif now[1] and (m := re.match(athlete, line)):
                        found[now[1]].append(m[2].strip())
                if all(len(v) == wanted[k] for k, v in found.items()):
                    out += [(doc, k, name) for k, v in found.items() for name in v]
            yield pd.DataFrame(out, columns=["doc", "event", "athlete"])

    return text.select(F.col("doc").cast("string").alias("doc"), page).mapInPandas(one, "doc string, event string, athlete string")


def calendar(meetings: DataFrame, indoor: str = r"(?i)\bindoor\b") -> DataFrame:
    """Meetings of month-by-month pages, once per id, without indoor ones."""
    return meetings.where(~F.coalesce(F.col("name").rlike(indoor), F.lit(False))).groupBy("id").agg(*(F.min(c).alias(c) for c in meetings.columns if c != "id"))


def cleaned(df: DataFrame) -> DataFrame:
    """A season's rows with parsed dates, the age at the race to one decimal and a mark; those without a mark go."""
    wind = F.col("wind") if "wind" in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({"wind": wind, "date": marks.result_date("date"), "dob": marks.result_date("dob")})
    return rows.withColumns({"age": marks.age_years("dob", "date"), "value": marks.clock_value("mark")}).dropna(subset=["mark"])


def profile_best(results: DataFrame, keys: list[str], cutoff: Column, hand_times: bool = False, season: Column | None = None) -> DataFrame:
    """Best score of legal, outdoor, dated results before a cut-off (of one season, if given), and its date; the earliest of equal ones."""
    day = marks.result_date("date")
    rows = results.withColumn("_d", day).where((F.col("_d") < cutoff) & ~F.coalesce("notLegal", F.lit(False)) & ~marks.result_is_indoor("indoor", "venue", "competition") & F.col("resultScore").isNotNull())
    if not hand_times:
        rows = rows.where(~F.coalesce(F.col("mark").endswith("h"), F.lit(False)))
    if season is not None:
        rows = rows.where(F.year("_d") == season)
    return rows.groupBy(*keys).agg(F.max("resultScore").alias("score"), F.max_by("_d", F.struct("resultScore", (-F.unix_date("_d")).alias("t"))).alias("date"))


def resolved_event(events: DataFrame, dimension: DataFrame, mile_as_1500: bool = False) -> DataFrame:
    """The discipline key of (gender, event) by the dimension's names; the mile counts as the 1500 m only where asked."""
    from meetlens.functions.names import event_key

    key = F.when(F.lit(mile_as_1500) & (event_key("event") == "mile"), F.lit("1500m")).otherwise(event_key("event"))
    own = dimension.select(F.col("gender"), F.lower("event").alias("_k"), F.col("key").alias("discipline"))
    return events.withColumn("_k", key).join(own, ["gender", "_k"], "left").drop("_k")


def registry(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One registry entry; an unknown key is an error."""
    found = rows.where(F.col(key) == value)
    if not found.limit(1).count():
        raise KeyError(value)
    return found


def distinct_pairs(logs: list[DataFrame]) -> DataFrame:
    """Distinct (venue, date) of several logs, of these two columns only."""
    return reduce(DataFrame.union, [x.select("venue", "date") for x in logs]).dropna().distinct()


def venue_counts(logs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [x.select("venue") for x in logs]).dropna().groupBy("venue").agg(F.count("*").alias("n"))


def with_weather(logs: list[DataFrame], weather: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs).join(weather, ["venue", "date"])


def season_history(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Display history: of one (date, mark) the row with the lowest score, unscored last; in order of date."""
    w = Window.partitionBy(*keys, "date", "mark").orderBy(F.asc_nulls_last("score"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*keys, "date", "mark")


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read: a sink refuses to replace one that cannot."""
    try:
        spark.read.parquet(path).limit(1).count()
    except AnalysisException:
        return False
    return True
