"""Column functions on marks, places, dates and winds. Each takes columns and returns one; none is a UDF.

A mark is text: seconds ("9.79"), minutes and seconds ("1:44.20"), metres ("8.52m"), or no mark ("NM", "DNF").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case city and meeting keywords are parameters of the functions that need them; these are defaults of the rules.
MAX_WEEK, WIND_FREE, WIND_PENALTY = 20, 1.0, 0.01


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column, kind: str = "double") -> Column:
    """The text as a number, else null."""
    return F.trim(col(c)).try_cast(kind)


def _clock(text: Column, parts: int | None) -> Column:
    piece = F.split(text, ":")
    value = number(F.get(piece, F.lit(0))) * 60 + number(F.get(piece, F.lit(1)))
    return value if parts is None else F.when(F.size(piece) == parts, value)


def mark_value(mark: str | Column) -> Column:
    """Seconds or metres: a trailing m is dropped, of m:ss the first two parts count; null on anything else."""
    text = F.trim(col(mark))
    return F.when(text.endswith("m"), number(F.substring(text, F.lit(1), F.length(text) - 1))).when(text.contains(":"), _clock(text, None)).otherwise(number(text))


def clock_value(mark: str | Column) -> Column:
    """Seconds of "s" or "m:ss"; text of three parts, or with a unit, is null."""
    text = F.trim(col(mark))
    return F.when(text.contains(":"), _clock(text, 2)).otherwise(number(text))


def strict_mark_value(mark: str | Column) -> Column:
    """As mark_value, but a text that is no mark fails the query."""
    value = mark_value(mark)
    return F.when(value.isNull() & col(mark).isNotNull(), F.raise_error(F.concat(F.lit("not a mark: "), col(mark))).cast("double")).otherwise(value)


def format_mark(value: str | Column, is_field: str | Column, is_clock: str | Column) -> Column:
    """"8.52m" for field events, "1:44.20" from a minute on for clock events, "9.79" else."""
    v = col(value)
    minutes = F.floor(v / 60)
    clock = F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_string("%.2f", v - minutes * 60), 5, "0"))
    plain = F.format_string("%.2f", v)
    return F.when(v.isNull(), None).when(col(is_field), F.concat(plain, F.lit("m"))).when(col(is_clock) & (v >= 60), clock).otherwise(plain)


def place(text: str | Column) -> Column:
    """The leading digits, unless the code is of a heat, semi-final or qualifying round."""
    return F.when(is_final(text), F.regexp_extract(F.trim(col(text)), r"^(\d+)", 1).try_cast("int"))


def is_final(text: str | Column) -> Column:
    """False for codes such as 2h3, 3sf2, 4q; true for digits, 1f1 and blank."""
    return ~F.coalesce(F.trim(col(text)), F.lit("")).rlike(r"(?i)\d\s*(h|sf|qf|q|r)\s*\d*$")


def whole_place(text: str | Column) -> Column:
    """"1", "1." and "1.0" as 1, else null."""
    t = F.trim(col(text))
    return F.when(t.rlike(r"^\d+(\.0?)?$"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("int"))


def leading_digits(text: str | Column) -> Column:
    return F.regexp_extract(col(text), r"^\s*(\d+)", 1).try_cast("int")


def result_date(text: str | Column) -> Column:
    """"5 JUN 2026" or an ISO date, as a date; null else."""
    c = F.trim(col(text))
    return F.coalesce(F.try_to_timestamp(c, F.lit("d MMM yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def season_date(day_month: str | Column, year: str | Column) -> Column:
    """"04 Sep" in a season."""
    return F.try_to_timestamp(F.concat_ws(" ", col(day_month), col(year).cast("string")), F.lit("d MMM yyyy")).cast("date")


def any_date(text: str | Column) -> Column:
    """"5 JUN 2026", an ISO date or time, a date: as a date; null for anything else."""
    c = F.trim(col(text).cast("string"))
    return F.coalesce(F.try_to_timestamp(c, F.lit("d MMM yyyy")), F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(c))).cast("date")


def last_date_in(text: str | Column, year: str | Column) -> Column:
    """The last "12 June" or "12 June 2026" in running text; the year is filled in where it is missing. Null without a date."""
    found = F.try_element_at(F.regexp_extract_all(col(text), F.lit(r"(\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?(?: \d{4})?)"), F.lit(1)), F.lit(-1))
    parts = F.split(found, " ")
    full = F.concat_ws(" ", F.get(parts, F.lit(0)), F.substring(F.get(parts, F.lit(1)), 1, 3), F.coalesce(F.get(parts, F.lit(2)), col(year).cast("string")))
    return F.try_to_timestamp(full, F.lit("d MMM yyyy")).cast("date")


def day_month(date: str | Column) -> Column:
    return F.date_format(any_date(date), "dd MMM")


def iso(date: str | Column) -> Column:
    """A shown date, "27 AUG 2026", as 2026-08-27; null for anything that is no date."""
    return F.date_format(any_date(date), "yyyy-MM-dd")


def birth_date(text: str | Column) -> Column:
    """A birth date as ISO text; of a year alone, that year; null for anything else."""
    c = F.trim(col(text).cast("string"))
    return F.when(c.rlike(r"^\d{4}$"), c).otherwise(F.date_format(F.try_to_timestamp(c, F.lit("d MMM yyyy")), "yyyy-MM-dd"))


def season_week(date: str | Column) -> Column:
    """Whole weeks since 1 May, from 0 to 20; null without a date."""
    d = any_date(date)
    return F.when(d.isNotNull(), F.least(F.lit(MAX_WEEK), F.greatest(F.lit(0), F.floor(F.datediff(d, F.make_date(F.year(d), F.lit(5), F.lit(1))) / 7)))).cast("int")


def age_years(born: str | Column, on: str | Column) -> Column:
    """Years to one decimal, ties to even."""
    return F.bround(F.datediff(any_date(on), any_date(born)) / 365.25, 1)


def wind_reading(text: str | Column) -> Column:
    """"+2.1" as 2.1, else null."""
    return number(F.replace(col(text), F.lit("+"), F.lit("")))


def wind_adjusted(mark: str | Column, wind: str | Column, is_field: str | Column) -> Column:
    """A mark made worse by 0.01 for each m/s above 1.0: added on the track, taken off in the field; unknown wind: as it is."""
    m, w = col(mark), col(wind)
    penalty = (w - WIND_FREE) * WIND_PENALTY
    return F.when(w.isNull() | (w <= WIND_FREE), m).otherwise(F.when(col(is_field), m - penalty).otherwise(m + penalty))


def loose_number(text: str | Column) -> Column:
    """Number with thousands commas, else null."""
    return number(F.replace(col(text), F.lit(","), F.lit("")))


def is_number(text: str | Column) -> Column:
    return number(text).isNotNull()


def ordinal(n: str | Column) -> Column:
    c = col(n)
    end = F.when((c % 100).between(11, 13), "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), end)


def date_number(date: str | Column) -> Column:
    """yyyymmdd; undated rows lowest."""
    return F.coalesce(F.date_format(any_date(date), "yyyyMMdd").cast("int"), F.lit(0))


def fade_weight(seasons_ago: str | Column, last_season: float, per_year: float) -> Column:
    return F.lit(last_season) * F.pow(F.lit(per_year), col(seasons_ago) - 1)


def consistency(races: str | Column, spread: str | Column) -> Column:
    """Races from 1 to 5 as a share of 5, times what a spread of up to 50 points leaves."""
    return F.least(F.greatest(col(races), F.lit(1)), F.lit(5)) / 5 * F.greatest(F.lit(0.0), 1 - F.coalesce(col(spread), F.lit(0.0)) / 50)


def labelled_with_year(name: str | Column, year: str | Column) -> Column:
    y = col(year).cast("string")
    return F.when(F.contains(col(name), y), col(name)).otherwise(F.concat_ws(" ", col(name), y))


def city(venue: str | Column) -> Column:
    """The last part of "Stadium, City (COUNTRY)", without what is in brackets."""
    plain = F.trim(F.regexp_replace(col(venue), r"\s*\([^)]*\)", ""))
    return F.trim(F.element_at(F.split(plain, ","), -1))


def country_code(venue: str | Column) -> Column:
    """"(GBR)" at the end of a venue; null if there is none."""
    return F.nullif(F.regexp_extract(col(venue), r"\(([A-Z]{3})\)\s*(?:\(i\))?\s*$", 1), F.lit(""))


def is_indoor(venue: str | Column) -> Column:
    return F.coalesce(col(venue).rlike(r"(?i)\(i\)\s*$|\bindoor\b"), F.lit(False))


def result_is_indoor(flag: str | Column, venue: str | Column, competition: str | Column) -> Column:
    token = r"(^|\s)\(i\)(\s|$)"
    return F.coalesce(col(flag), F.lit(False)) | F.coalesce(col(venue).rlike(token), F.lit(False)) | F.coalesce(col(competition).rlike(token), F.lit(False))


def clamped(p: str | Column, low: float = 0.01, high: float = 0.99) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(p)))


def percent(text: str | Column) -> Column:
    """"27%" as 0.27; a plain number as it is."""
    t = F.trim(col(text))
    return F.when(t.endswith("%"), number(F.regexp_replace(t, "%$", "")) / 100).otherwise(number(t))


def in_order(value: str | Column, cases: list[tuple[str, object]], otherwise=None) -> Column:
    """The result of the first pattern that matches: ordered classification of names into tiers, kinds or weights."""
    out = None
    for pattern, result in cases:
        hit = col(value).rlike(pattern)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


# Tiers of competitions by name, in order, and what weighs a mark by its venue.
TIERS = [
    (r"(?i)olympic|world (athletics )?championships", "global"),
    (r"(?i)european (athletics )?championships|continental cup", "continental"),
    (r"(?i)^diamond league final$", "dl_final"),
]
MAJOR_KEYWORDS = ["olympic", "world championship", "world athletics", "european championship"]
CIRCUIT_CITIES = ["doha", "shanghai", "suzhou", "shaoxing", "rabat", "florence", "paris", "oslo", "lausanne", "stockholm", "silesia", "monaco", "london", "zurich", "brussels", "eugene", "birmingham", "rome", "xiamen"]


def competition_tier(name: str | Column) -> Column:
    """global, continental, dl_final or tour; the first that matches."""
    return in_order(name, TIERS, "tour")


def competition_weight(venue: str | Column) -> Column:
    """1.3 at a major championship, 1.2 in a city of the circuit, else (and without a venue) 1.0."""
    v = F.lower(col(venue))
    has = lambda words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(v, w)), F.lit(False))
    return F.when(has(MAJOR_KEYWORDS), 1.3).when(has(CIRCUIT_CITIES), 1.2).otherwise(1.0)


def points_gap_reason(label: str | Column, status: str | Column, gap: str | Column) -> Column:
    """Why standings leave an entrant outside: out of reach, a gap (singular or plural) or level with the cut."""
    g = col(gap)
    points = F.when(g == 1, "point").otherwise("points")
    return F.when(col(status) == "out", F.concat(col(label), F.lit(" cannot reach the cut"))).when(g > 0, F.concat_ws(" ", col(label), F.lit("is"), F.format_string("%.0f", g), points, F.lit("behind the cut"))).otherwise(F.concat(col(label), F.lit(" is level with the cut")))
