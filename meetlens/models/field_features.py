"""The features of a field: every scored athlete of a final against the others, at its cut-off.

No feature depends on how many slower athletes share the field. Scores are divided by 100, so that a weight reads per 100 points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.models.plackett_luce import FADE_CAP, FADE_LAST_SEASON, FADE_PER_YEAR

FEATURES = ["gap_best", "gap_third", "pb_gap", "no_history", "sb_months", "yoy", "age", "sb_prior_season"]
RACE_FEATURES = ["form_gap", "recent_delta", "no_recent", "big_podiums", "h2h_top", "pb_gap_thin", "breakout_backed"]
LEVEL_FEATURES = ["consistency", "strength_gap_best", "strength_gap_third", "fade_gap_best", "fade_gap_third"]
#: A season of so many marks is thin; marks and points of span by which a season counts as consistent; an unknown age and months.
THIN_SEASON, CONSISTENT_RACES, CONSISTENT_SPREAD, AGE, MONTHS = 2, 5, 50.0, 25.0, 12.0


def consistency() -> Column:
    """How many marks there are, up to CONSISTENT_RACES, times how tightly the best of them sit: 0 to 1."""
    races = F.least(F.greatest(F.coalesce(F.col("races"), F.lit(1)), F.lit(1)), F.lit(CONSISTENT_RACES)) / CONSISTENT_RACES
    return races * F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.coalesce(F.col("form_spread"), F.lit(0.0))) / CONSISTENT_SPREAD)


def strength() -> Column:
    """Form and career best blended: form weighs 0.5 and half the consistency; alone where it is as good as the career best."""
    new, old = F.coalesce("form_score", "sb_score"), F.col("career_best")
    weight = 0.5 + 0.5 * consistency()
    return F.when(old.isNull() | (new >= old), new).otherwise(weight * new + (1 - weight) * old)


def faded_level(final: list[str], cutoff: str, last_season: float, per_year: float, cap: float) -> Column:
    """This season's level, lifted by the largest faded part of an older best above it, by at most cap of what the leader is ahead."""
    now = F.coalesce("form_score", "sb_score")
    ago = F.greatest(F.lit(3), F.year(F.to_date(cutoff)) - F.col("older_seasons_best_year"))
    lift = F.lit(0.0)
    for years, best in ((F.lit(1), "prev_season_best"), (F.lit(2), "two_seasons_ago_best"), (ago, "older_seasons_best")):
        weight = last_season * F.pow(F.lit(float(per_year)), (years - 1).cast("double"))
        lift = F.greatest(lift, F.coalesce(weight * F.greatest(F.lit(0.0), F.col(best) - now), F.lit(0.0)))
    room = F.greatest(F.lit(0.0), F.max(now).over(Window.partitionBy(*final)) - now) * cap
    return now + F.least(lift, room)


def field_features(rows: DataFrame, final: list[str], cutoff: str, last_season: float = FADE_LAST_SEASON, per_year: float = FADE_PER_YEAR, cap: float = FADE_CAP) -> DataFrame:
    """rows with a season score, and the twenty features (FEATURES, RACE_FEATURES, LEVEL_FEATURES).

    Wants what asof.as_of_states and asof.record_against_strongest give, and dob. An unknown age is the field's median, failing that AGE.
    """
    w = Window.partitionBy(*final)
    s, form = F.col("sb_score"), F.coalesce("form_score", "sb_score")

    def third(c: str) -> Column:
        """The third best of a field, or its last."""
        order = F.sort_array(F.collect_list(c).over(w), asc=False)
        return F.element_at(order, F.least(F.size(order), F.lit(3)))

    age = F.datediff(F.to_date(cutoff), F.to_date("dob")) / 365.25
    scored = rows.where(s.isNotNull()).withColumns({"__strength": strength(), "__level": faded_level(final, cutoff, last_season, per_year, cap), "__age": age, "__best": F.max(s).over(w)})
    pb_gap = F.coalesce((F.col("career_best") - s) / 100, F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    made = {
        "gap_best": (s - F.col("__best")) / 100,
        "gap_third": (s - third("sb_score")) / 100,
        "pb_gap": pb_gap,
        "no_history": F.col("career_best").isNull().cast("double"),
        "sb_months": F.coalesce(F.datediff(F.to_date(cutoff), "sb_date") / 30.44, F.lit(MONTHS)),
        "yoy": F.when(zero("sb_prior_season") == 0, zero((s - F.col("prev_season_best")) / 100)).otherwise(0.0),
        "age": F.coalesce("__age", F.median("__age").over(w), F.lit(AGE)),
        "sb_prior_season": zero("sb_prior_season"),
        "form_gap": (form - F.col("__best")) / 100,
        "recent_delta": zero((F.col("recent_score") - form) / 100),
        "no_recent": F.col("recent_score").isNull().cast("double"),
        "big_podiums": zero("big_podiums"),
        "h2h_top": zero("h2h_top"),
        "pb_gap_thin": F.when(F.coalesce("races", F.lit(0)) <= THIN_SEASON, pb_gap).otherwise(0.0),
        "breakout_backed": zero(F.when(F.col("career_best").isNotNull(), F.greatest(F.lit(0.0), form - F.col("career_best")) / 100)),
        "consistency": consistency(),
        "strength_gap_best": (F.col("__strength") - F.max("__strength").over(w)) / 100,
        "strength_gap_third": (F.col("__strength") - third("__strength")) / 100,
        "fade_gap_best": (F.col("__level") - F.max("__level").over(w)) / 100,
        "fade_gap_third": (F.col("__level") - third("__level")) / 100,
    }
    own = [c for c in rows.columns if c not in made]
    return scored.select(*own, *(c.alias(name) for name, c in made.items()))
