"""Schemas of the logical tables and the dimension of disciplines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOPLIST = "rank int, mark string, wind string, athlete string, dob string, nat string, pos string, blank string, venue string, date string, score int, discipline string, year int, profile_url string"
RACE_LOG = "discipline string, athlete string, mark string, value double, place int, is_final boolean, date date, year int, venue string, meeting string, tier string, source string, source_priority int"
MEET_RESULTS = "meet string, year int, competition_level string, discipline string, race string, heat string, place int, athlete string, mark string"
MEET_DATES = "meet string, year int, competition_level string, date date"
FINALS = "competition string, competition_id long, tier string, year int, cutoff date, discipline string, athlete string, nat string, place int, mark string"
STANDINGS = "discipline string, rank int, name string, country string, events int, points double, qual_limit int"
RESULT = "struct<date:string,mark:string,wind:string,venue:string,competition:string,category:string,race:string,place:string,notLegal:boolean,resultScore:double>"
PROFILE = f"athlete_id long, resultsByEvent array<struct<discipline:string,indoor:boolean,results:array<{RESULT}>>>"
FLAGS = "map<string,struct<status:string,disciplines:array<string>,matches:array<struct<headline:string,url:string,source:string,keywords:array<string>,published:string>>>>"
PREDICTIONS = "discipline string, predicted_rank int, athlete string, nat string, season_best string, probability double, injury_watch boolean, profile_url string, as_of date, qualified boolean"

#: Event name, higher is better, field size, group, wind counts, minutes are written, points only.
_EVENTS = [
    ("100m", False, 8, "sprints", True, False, False),
    ("200m", False, 8, "sprints", True, False, False),
    ("400m", False, 8, "sprints", False, False, False),
    ("800m", False, 8, "distance", False, True, False),
    ("1500m", False, 10, "distance", False, True, False),
    ("5000m", False, 10, "distance", False, True, False),
    ("10000m", False, 10, "distance", False, True, True),
    ("3000mSC", False, 10, "distance", False, True, False),
    ("sprint_hurdles", False, 8, "sprints", True, False, False),
    ("400mH", False, 8, "sprints", False, False, False),
    ("HJ", True, 6, "jumps", False, False, False),
    ("PV", True, 6, "jumps", False, False, False),
    ("LJ", True, 6, "jumps", True, False, False),
    ("TJ", True, 6, "jumps", True, False, False),
    ("SP", True, 6, "throws", False, False, False),
    ("DT", True, 6, "throws", False, False, False),
    ("HT", True, 6, "throws", False, False, True),
    ("JT", True, 6, "throws", False, False, False),
]


def disciplines(spark: SparkSession) -> DataFrame:
    """One row per gender and event."""
    rows = [(f"{g}_{key}", g, key, *rest) for g in ("men", "women") for key, *rest in _EVENTS]
    return spark.createDataFrame(rows, "key string, gender string, event string, is_field boolean, qual_limit int, event_group string, wind boolean, is_clock boolean, points_only boolean")
