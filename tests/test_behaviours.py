"""Small hand-made inputs that pin the edge semantics."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meetlens.functions import marks, names, text
from meetlens.models import evaluation, field_features, plackett_luce as pl
from meetlens.operators import aggregates as A
from meetlens.operators import h2h as H
from meetlens.operators import joins as J
from meetlens.operators import mentions as M
from meetlens.operators import ranking as R
from meetlens.operators import reports as Q


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def table(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


# Scalars


@pytest.mark.parametrize("mark, value", [("9.79", 9.79), ("1:44.20", 104.2), ("8.52m", 8.52), ("NM", None), ("DNF", None), (None, None), (" 10.1 ", 10.1)])
def test_mark_value(spark, mark, value):
    got = one(spark, marks.mark_value(F.lit(mark).cast("string")))[0]
    assert got is None if value is None else math.isclose(got, value)


def test_clock_rejects_hours_and_units(spark):
    assert list(one(spark, marks.clock_value(F.lit("1:02:03")), marks.clock_value(F.lit("8.52m")), marks.clock_value(F.lit("2:01.5")))) == [None, None, 121.5]


def test_dates_that_are_none(spark):
    """No date function fails on a text without a date."""
    for text in (None, "", "x", "DNF", "31 FEB 2026", "2026", "June", "12 June"):
        c = F.lit(text).cast("string")
        got = one(spark, marks.any_date(c), marks.iso(c), marks.day_month(c), marks.season_week(c), marks.age_years(c, F.lit("2026-01-01")), marks.date_number(c), marks.birth_date(c), marks.last_date_in(c, F.lit(2026)))
        assert list(got) == [None] * 5 + [0, "2026" if text == "2026" else None, date(2026, 6, 12) if text == "12 June" else None]
    shown = F.lit("27 AUG 2026")
    assert list(one(spark, marks.iso(shown), marks.day_month(shown), marks.birth_date(shown), marks.season_week(shown), marks.iso(F.lit("2026-08-27 10:00:00")), marks.iso(F.lit(date(2026, 8, 27))))) == ["2026-08-27", "27 Aug", "2026-08-27", 16, "2026-08-27", "2026-08-27"]


def test_standings_of_few_groups(spark):
    """Exact places, ties and quantiles, equal to windows; null groups and values count."""
    from meetlens.operators import order as O

    rows = [(g, v, i) for i, (g, v) in enumerate([("a", i % 7 * 1.0) for i in range(300)] + [("b", float(i)) for i in range(50)] + [(None, 2.0), (None, None), ("c", None)])]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(7)
    w = Window.partitionBy("g").orderBy("v")
    want = df.withColumns({"below": F.rank().over(w) - 1, "ties": F.count("*").over(Window.partitionBy("g", "v")), "size": F.count("*").over(Window.partitionBy("g"))})
    assert sorted(map(str, map(tuple, O.with_standing(df, ["g"], F.col("v")).collect()))) == sorted(map(str, map(tuple, want.collect())))
    got = {r.g: (r.lo, r.mid) for r in O.quantiles(df, ["g"], F.col("v"), {"lo": 0.1, "mid": 0.5}).collect()}
    by = {g: np.array([v for x, v, _ in rows if x == g and v is not None]) for g in ("a", "b", None)}
    assert set(got) == set(by) and all(np.allclose(got[g], np.quantile(by[g], [0.1, 0.5])) for g in by)
    assert O.with_standing(df.limit(0), ["g"], F.col("v")).count() == 0 and O.quantiles(df.limit(0), ["g"], F.col("v"), {"m": 0.5}).count() == 0
    placed = O.numbered(df, ["g", "v"], "at").collect()
    assert [r.at for r in sorted(placed, key=lambda r: r.at)] == list(range(len(rows)))
    key = lambda r: ((r.g is not None, r.g or ""), (r.v is not None, r.v or 0))
    ordered = sorted(placed, key=lambda r: r.at)
    assert [key(r) for r in ordered] == sorted(key(r) for r in placed)


def test_phrases_by_position(spark):
    texts = spark.createDataFrame([(1, "ann lee ran; ann ran lee"), (2, "lee ann"), (3, None), (4, "the long jump of ann lee jones")], "id int, x string")
    named = spark.createDataFrame([(7, "ann lee"), (8, "ann lee jones"), (9, "ran"), (10, "no such name"), (11, ""), (12, "ann ann")], "k int, alias string")
    got = {(r.id, r.k) for r in M.mentions(texts, "id", "x", named, "k", "alias").collect()}
    assert got == {(1, 7), (4, 7), (4, 8), (1, 9)}


def test_strict_mark_fails(spark):
    with pytest.raises(Exception, match="not a mark"):
        one(spark, marks.strict_mark_value(F.lit("NM")))


@pytest.mark.parametrize("code, want", [("1", (1, True)), ("1.", (1, True)), ("1.0", (1, True)), ("1f1", (1, True)), ("2h3", (None, False)), ("3sf2", (None, False)), ("", (None, True)), (None, (None, True))])
def test_place(spark, code, want):
    c = F.lit(code).cast("string")
    assert tuple(one(spark, marks.place(c), marks.is_final(c))) == want


def test_formats(spark):
    no, yes = F.lit(False), F.lit(True)
    assert list(one(spark, marks.format_mark(F.lit(8.5), yes, no), marks.format_mark(F.lit(104.2), no, yes), marks.format_mark(F.lit(9.79), no, yes), marks.format_mark(F.lit(121.0), no, yes))) == ["8.50m", "1:44.20", "9.79", "2:01.00"]
    assert [one(spark, marks.ordinal(F.lit(n)))[0] for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]


def test_dates(spark):
    assert list(one(spark, marks.result_date(F.lit("5 jun 2026")), marks.result_date(F.lit("16 MAY 2026")), marks.result_date(F.lit("soon")), marks.last_date_in(F.lit("3 May to 12 June at Rome"), F.lit(2026)))) == [date(2026, 6, 5), date(2026, 5, 16), None, date(2026, 6, 12)]
    assert [one(spark, marks.season_week(F.lit(d)))[0] for d in ("2026-04-01", "2026-05-08", "2026-12-31")] == [0, 1, 20]


def test_wind(spark):
    field, track = F.lit(True), F.lit(False)
    got = one(spark, marks.wind_adjusted(F.lit(8.0), F.lit(2.0), field), marks.wind_adjusted(F.lit(10.0), F.lit(2.0), track), marks.wind_adjusted(F.lit(10.0), F.lit(1.0), track), marks.wind_adjusted(F.lit(10.0), F.lit(None).cast("double"), track))
    assert [round(x, 4) for x in got] == [7.99, 10.01, 10.0, 10.0]


def test_names(spark):
    got = one(spark, names.name_key(F.lit(" José Čeh ")), names.field_key(F.lit("O'Neil-Šmith")), names.title_name(F.lit("anna  o'NEIL-smith")), names.slug(F.lit("Ána  O'Neil!")), names.match_text(F.lit("O’Neil-Smith, J.")), names.id_after_hyphen(F.lit("a/jo-smith-14201")), names.same_person(F.lit("Anna Maria SMITH"), F.lit("Anna SMITH")), names.same_person(F.lit("Anna SMITH"), F.lit("Eva SMITH")))
    assert list(got) == ["JOSE CEH", "ONEILSMITH", "Anna O'Neil-Smith", "ana-o-neil", "o neil smith, j", 14201, True, False]


# Direction, ranks, gaps


def test_best_direction(spark):
    df = spark.createDataFrame([("t", 10.1), ("t", 9.9)], "k string, v double")
    assert A.best_per_group(df, ["k"], "v", False).first().best == 9.9 and A.best_per_group(df, ["k"], "v", True).first().best == 10.1


def test_average_rank(spark):
    df = spark.createDataFrame([("d", 5.0, i) for i in range(2)] + [("d", 7.0, 3)], "d string, v double, i int")
    got = sorted((r.v, r.season_rank, round(r.percentile, 4)) for r in R.with_season_rank(df, ["d"], "v", False).collect())
    assert got == [(5.0, 1.5, 0.8333), (5.0, 1.5, 0.8333), (7.0, 3.0, 0.3333)]


def test_field_gap_without_spread(spark):
    for rows in ([("d", 5.0), ("d", 5.0)], [("d", 5.0)]):
        assert {r.field_gap for r in A.field_gap(spark.createDataFrame(rows, "d string, v double"), ["d"], "v", True).collect()} == {0.0}


def test_trend_is_positive_when_worse(spark):
    df = spark.createDataFrame([("a", date(2026, 5, d), v) for d, v in ((1, 10.0), (2, 10.2), (3, 10.4))] + [("b", date(2026, 5, 1), 9.0)], "a string, d date, v double")
    track, field = (table(R.trend(df, ["a"], "d", "v", up), "a") for up in (False, True))
    assert round(track["a"].recent_trend, 4) == 0.4 and round(field["a"].recent_trend, 4) == -0.4 and track["b"].recent_trend == 0.0


def test_gaps_and_days(spark):
    df = spark.createDataFrame([("a", date(2026, 5, d)) for d in (1, 3, 8)] + [("b", date(2026, 5, 1)), ("c", None)], "a string, d date")
    assert {k: round(r.gap_deviation, 4) for k, r in table(R.gap_variability(df, ["a"], "d"), "a").items()} == {"a": 2.1213, "b": 0.0}
    assert {k: r.days_since_last for k, r in table(R.days_since(df, ["a"], "d", F.lit("2026-05-10").cast("date")), "a").items()} == {"a": 2, "b": 9, "c": 999}


def test_form_ratio(spark):
    rows = [("x", "a", date(2026, 3, 1), 10.0), ("x", "a", date(2026, 6, 1), 10.2), ("x", "b", date(2026, 1, 1), 10.1)]
    got = table(R.form_ratio(spark.createDataFrame(rows, "f string, a string, d date, v double"), ["a"], ["f"], "d", "v", F.lit("2026-06-10").cast("date"), False), "a")
    assert got["a"].peak_age_days == 101 and round(got["a"].recent_ratio, 4) == 1.02 and round(got["b"].recent_ratio, 4) == 1.02


def test_variation_needs_three(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "a string, v double")
    got = table(A.form_by_season(df, ["a"], "v", True), "a")
    assert got["a"].variation is None and round(got["b"].variation, 3) == 40.825


def test_tercile(spark):
    assert [one(spark, R.tercile(F.lit(r), F.lit(n)))[0] for r, n in ((1, 2), (1, 4), (2, 4), (3, 4), (2, 6))] == [None, "deep", "middle", "thin", "deep"]


def test_counts_with_and_without_log(spark):
    a = spark.createDataFrame([("a", 5), ("b", 6)], "athlete string, n int")
    log = spark.createDataFrame([("a",), ("a",)], "athlete string")
    assert {k: r.meets for k, r in table(A.event_counts(a, log, ["athlete"], "n"), "athlete").items()} == {"a": 2, "b": 0}
    assert {k: r.meets for k, r in table(A.event_counts(a, None, ["athlete"], "n"), "athlete").items()} == {"a": 5, "b": 6}


def test_cutoff_is_strict(spark):
    log = spark.createDataFrame([("d", "a", date(2026, 8, 1), 2026, 5.0), ("d", "a", date(2026, 9, 1), 2026, 9.0), ("d", "a", date(2025, 9, 1), 2025, 7.0), ("d", "b", date(2025, 1, 1), 2025, 3.0)], "g string, athlete string, date date, year int, value double")
    finals = spark.createDataFrame([("d", 2026, date(2026, 9, 1))], "g string, year int, cutoff date")
    rows = A.season_features(log, finals, ["g"], ["athlete"], True).collect()
    assert len(rows) == 1 and (rows[0].season_best, rows[0].career_best, rows[0].meets, rows[0].year_on_year) == (5.0, 7.0, 1, -2.0)


# Head to head


def races(spark, rows):
    return spark.createDataFrame(rows, "meet string, heat string, athlete string, place int")


def test_dead_heat_and_heats(spark):
    df = races(spark, [("m", None, "a", 1), ("m", None, "b", 1), ("m", None, "c", 3), ("m", "2", "d", 1), ("m", None, "c", 13)])
    got = {(r.athlete_a, r.athlete_b): r.a_wins for r in H.pairwise(df, ["meet", "heat"], "athlete", "place").collect()}
    assert got == {("a", "c"): 1, ("c", "a"): 0, ("b", "c"): 1, ("c", "b"): 0}


def test_rates_mirror(spark):
    df = races(spark, [("m1", "", "a", 1), ("m1", "", "b", 2), ("m2", "", "a", 2), ("m2", "", "b", 1), ("m3", "", "a", 1), ("m3", "", "b", 5)])
    got = table(H.rates(H.pairwise(df, ["meet", "heat"], "athlete", "place")), "athlete_a", "athlete_b")
    assert got["a", "b"].wins + got["b", "a"].wins == got["a", "b"].meetings == 3


def test_versus_counts_draws(spark):
    df = races(spark, [("m1", "", "a", 1), ("m1", "", "b", 1), ("m2", "", "a", 1), ("m2", "", "b", 2)]).withColumn("d", F.lit("2026-01-01").cast("date"))
    r = H.versus(df, ["meet", "heat"], "athlete", "place", "d", F.col("athlete") == "a").first()
    assert (r.wins, r.losses, r.draws, r.meetings, r.win_rate) == (1, 0, 1, 2, 50.0)


def test_never_met(spark):
    field = spark.createDataFrame([("g", "a", 3.0), ("g", "b", 2.0)], "g string, n string, s double")
    pairs = spark.createDataFrame([], "athlete_a string, athlete_b string, wins long, meetings long, win_rate double")
    cells = H.matrix(field, pairs.drop("win_rate"), ["g"], "n").collect()
    assert len(cells) == 2 and all(c.wins is None and c.win_rate is None for c in cells)
    assert {r.h2h_mean for r in H.field_mean(field, pairs, ["g"], "n").collect()} == {0.5}
    none = spark.createDataFrame([], "race int, n string, place int")
    assert {r.h2h_top for r in H.net_against_top(field, none, ["g"], "n", "s", ["race"], "place").collect()} == {0.0}


def test_as_of_excludes_the_day_and_undated(spark):
    rows = [("a", "b", 1, date(2026, 5, 1)), ("a", "b", 0, date(2026, 6, 1)), ("a", "b", 1, date(2026, 7, 1)), ("a", "b", 1, None)]
    rec = spark.createDataFrame(rows, "athlete_a string, athlete_b string, a_wins int, d date")
    cuts = spark.createDataFrame([(date(2026, 6, 1),), (date(2026, 6, 2),), (date(2027, 1, 1),)], "cutoff date")
    got = {(r.cutoff, r.wins, r.meetings) for r in H.as_of_rates(rec, cuts, [], "d").collect()}
    assert got == {(date(2026, 6, 2), 1, 2), (date(2027, 1, 1), 2, 3)}
    assert J.dated(rec.withColumn("m", F.lit(1)), spark.createDataFrame([(1, None)], "m int, date date"), ["m"]).count() == 0


def test_top_three_others(spark):
    field = spark.createDataFrame([("g", n, s) for n, s in zip("abcde", (9.0, 8.0, 7.0, 6.0, 5.0))], "g string, n string, s double")
    got = {}
    for r in H.top_rivals(field, ["g"], "n", "s").collect():
        got.setdefault(r.n, set()).add(r.rival)
    assert got["a"] == {"b", "c", "d"} and got["e"] == {"a", "b", "c"} and got["c"] == {"a", "b", "d"}


def standings(spark, points):
    return spark.createDataFrame([("d", f"n{i}", p, i + 1, 2) for i, p in enumerate(points)], "d string, n string, p double, rk int, q int")


def test_qualification(spark):
    got = table(H.qualification(standings(spark, [30.0, 20.0, 12.0, 4.0, None]), ["d"], "n", "p", "rk", "q", F.lit(1)), "n")
    assert [got[f"n{i}"].status for i in range(5)] == ["safe", "in", "chasing", "out", "unknown"]
    assert (got["n1"].cut, got["n2"].gap) == (20.0, 8.0)


def test_tie_at_the_ceiling_is_not_out(spark):
    got = table(H.qualification(standings(spark, [20.0, 20.0, 12.0]), ["d"], "n", "p", "rk", "q", F.lit(1)), "n")
    assert got["n2"].status == "chasing" and got["n2"].above == 0
    assert got["n1"].status == "in"  # a rival can draw level, which is enough against safe


# Joins


def test_match_tiers(spark):
    h = spark.createDataFrame([(1, "X", "A"), (None, "Y", "A"), (None, "Y", "B"), (None, "Z", "C")], "wid int, name string, nat string")
    e = spark.createDataFrame([(1, 1, "Q", "Q"), (2, None, "Y", "A"), (3, None, "Y", "Q"), (4, None, "Z", "Q")], "e int, wid int, name string, nat string")
    got = {k: (r.matched_name, r.matched_nation, r.matched_by) for k, r in table(J.tiered_match(e, h, "e", "wid", "name", "nat"), "e").items()}
    assert got == {1: ("X", "A", "id"), 2: ("Y", "A", "name+nation"), 3: (None, None, "none"), 4: ("Z", "C", "name")}


def test_score_fallback(spark):
    ev = spark.createDataFrame([("a", date(2026, 6, 1), 2026, None), ("b", date(2026, 6, 1), 2026, 50.0), ("c", date(2026, 6, 1), 2026, None), ("d", date(2026, 6, 1), 2026, None)], "k string, cut date, y int, prof double")
    hist = spark.createDataFrame([("a", date(2026, 5, 1), 2026, 40.0), ("a", date(2026, 6, 1), 2026, 99.0), ("c", date(2025, 5, 1), 2025, 30.0)], "k string, d date, yr int, s double")
    got = {k: (r.sb_score, r.sb_source, r.sb_prior_season) for k, r in table(J.asof_best(ev, hist, ["k"], "cut", "d", "yr", "y", "s", "prof"), "k").items()}
    assert got == {"a": (40.0, "toplist", False), "b": (50.0, "profile", False), "c": (30.0, "last_season", True), "d": (None, None, False)}


def test_labels_default(spark):
    f = spark.createDataFrame([(1,), (2,)], "k int")
    got = table(J.with_labels(f, spark.createDataFrame([(1, "major", 1)], "k int, tier string, l int"), ["k"], F.col("l")), "k")
    assert (got[1].label, got[1].tier, got[2].label, got[2].tier) == (1, "major", 0, "tour")


# Text


def test_attribution(spark):
    h = "smith wins as jones out with injury"
    both = F.array(F.lit("smith"), F.lit("jones"))
    assert one(spark, text.nearest_name(F.lit(h), both, F.lit("injury")))[0] == "jones"
    joined = "smith and jones out with injury"
    assert list(one(spark, text.is_about(F.lit(joined), F.lit("smith"), both, F.lit("injury"), ["and"]), text.is_about(F.lit(h), F.lit("smith"), both, F.lit("injury"), ["and"]))) == [True, False]


def test_alias_table(spark):
    a = spark.createDataFrame([(1, "Ann Lee Park"), (2, "Bea Park"), (3, "Cy Xu")], "i int, n string")
    got = {(r.alias, r.i, r.surname_only) for r in M.aliases(a, "i", "n").collect()}
    assert got == {("ann lee park", 1, False), ("bea park", 2, False), ("cy xu", 3, False), ("lee", 1, True)}
    texts = spark.createDataFrame([(1, "today bea park and ann lee parking"), (2, "lee")], "t int, x string")
    assert {(r.t, r.alias) for r in M.mentions(texts, "t", "x", M.aliases(a, "i", "n"), "i", "alias").collect()} == {(1, "bea park"), (1, "lee"), (2, "lee")}


def test_return_clears_a_flag(spark):
    f = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, f int")
    r = spark.createDataFrame([("a", 6), ("b", 5)], "k string, b int")
    assert {x.k for x in M.superseded(f, r, ["k"], "f", "b").collect()} == {"b", "c"}


def test_flag_pipeline(spark):
    aliases = spark.createDataFrame([(1, "ann lee", False), (1, "lee", True), (2, "bo park", False)], "athlete int, alias string, surname_only boolean")
    arts = spark.createDataFrame([(1, "ann lee withdraws with knee injury", 10), (2, "lee withdraws", 11), (3, "bo park has a knock", 12), (4, "weather report", 13)], "id int, text string, published int")
    back = spark.createDataFrame([(2, 20)], "athlete int, returned int")
    got = table(M.flagged(arts, aliases, back, ["withdraws"], ["knock"], []), "athlete")
    assert set(got) == {1} and got[1].status == "remove" and got[1].newest == 11


# Models


def test_chances(spark):
    rng = np.random.default_rng(0)
    for n in (4, 7, 30):
        assert math.isclose(pl.podium_probabilities(rng.normal(size=n) * 3).sum(), 3, abs_tol=1e-9)
    assert pl.podium_probabilities(np.array([1.0, 2.0, 3.0])).tolist() == [1, 1, 1]
    df = spark.createDataFrame([("f", float(i)) for i in range(5)], "f string, u double")
    assert math.isclose(pl.win_chances(df, ["f"], "u").agg(F.sum("win_chance")).first()[0], 1)
    a = sorted(r.podium_chance for r in pl.podium_chances(df, ["f"], "u").collect())
    b = sorted(r.podium_chance for r in pl.podium_chances_by_joins(df.withColumn("a", F.col("u")), ["f"], "a", "u").collect())
    assert np.allclose(a, b)


def test_fit_recovers_and_control_fails():
    rng, finals = np.random.default_rng(0), []
    for k in range(240):
        x = rng.normal(size=(8, 2))
        finals.append(((k, 2000 + k // 60), x, np.argsort(-(x @ [1.5, 0.0] + rng.gumbel(size=8)))[:3]))
    m = pl.fit([(x, t) for _, x, t in finals], ["a", "b"], 0.001)
    assert m.converged and 1.1 < m.weights[0] < 2 and abs(m.weights[1]) < 0.25
    w, eps = rng.normal(size=2), 1e-6
    data = [(x, t) for _, x, t in finals[:5]]
    f, g = pl.loss_and_gradient(w, data, 0.1)
    assert np.allclose(g, [(pl.loss_and_gradient(w + eps * e, data, 0.1)[0] - f) / eps for e in np.eye(2)], atol=1e-4)
    assert pl.fit([(x, t) for _, x, t in finals], ["a", "b"], 0.001, bounds=(None, 0)).weights.max() <= 0


def test_old_mark_never_passes_the_leader(spark):
    df = spark.createDataFrame([("f", "a", 100.0, 100.0), ("f", "b", 80.0, 500.0), ("f", "c", 90.0, 95.0)], "f string, a string, now double, old double")
    got = table(pl.faded_level(df, ["f"], "now", [("old", F.lit(1))]), "a")
    assert got["a"].level == 100.0 and got["b"].level == 95.0 and got["c"].level == 91.75


def test_slower_entrant_changes_no_gap(spark):
    """Nor does the order of rows; an unknown age is the field's median, failing that 25."""
    s = "f string, a string, sb_score double, sb_date date, sb_prior_season double, career_best double, prev_season_best double, two_seasons_ago_best double, older_seasons_best double, older_seasons_best_year int, form_score double, form_spread double, recent_score double, races int, big_podiums double, h2h_top double, dob date, cutoff date"
    row = lambda n, v, born=date(2000, 1, 1): ("f", n, v, date(2026, 5, 1), 0.0, v + 5, v - 3, None, None, None, v - 1, 2.0, v, 6, 1.0, 0.5, born, date(2026, 6, 1))
    rows = [row("a", 90.0), row("b", 80.0), row("c", 70.0), ("f", "d", *[None] * 15, date(2026, 6, 1))]
    got = [table(field_features.field_features(spark.createDataFrame(r, s), ["f"], "cutoff"), "a") for r in (rows, [*rows, row("z", 1.0)])]
    names = [*field_features.FEATURES, *field_features.RACE_FEATURES, *field_features.LEVEL_FEATURES]
    few, more = ({k: [r[n] for n in names] for k, r in g.items() if k != "z"} for g in got)
    assert few == more and set(few) == {"a", "b", "c"} and len(names) == 20
    a, b = got[0]["a"], got[0]["b"]
    assert (a.gap_best, b.gap_best, b.gap_third, a.no_history, b.form_gap, round(a.consistency, 6)) == (0, -0.1, 0.1, 0, -0.11, 0.96)
    bare = table(field_features.field_features(spark.createDataFrame([("f", "a", 50.0, *[None] * 14, date(2026, 6, 1)), ("f", "b", 40.0, *[None] * 14, date(2026, 6, 1))], s), ["f"], "cutoff"), "a")
    assert (bare["a"].age, bare["a"].sb_months, bare["a"].no_recent, bare["a"].no_history, bare["a"].pb_gap_thin, bare["a"].consistency) == (25, 12, 1, 1, 0, 0.2)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, False), (0.05, True), (1.0, True)], "p double, o boolean")
    assert {(r.bin, r.n, r.observed) for r in evaluation.calibration(df, "p", F.col("o")).collect()} == {(1, 2, 0.5), (10, 1, 1.0)}


# Reports


def test_non_finisher(spark):
    res = spark.createDataFrame([("f", "a", 1), ("f", "b", None)], "f string, a string, place int")
    call = spark.createDataFrame([("f", "a", 3)], "f string, a string, predicted int")
    got = table(Q.compare(res, call, ["f"], "a", "place", "predicted", 8), "a")
    assert (got["a"].status, got["a"].delta, got["a"].state) == ("finished", 2, "field") and (got["b"].status, got["b"].state) == ("dnf", "unseen")


def test_field_falls_back_without_standings(spark):
    df = spark.createDataFrame([(g, f"{g}{i}", 100.0 - i) for g in "xy" for i in range(9)], "g string, n string, v double")
    q = spark.createDataFrame([("x", "x3"), ("x", "x8")], "g string, n string")
    got = table(R.field_and_near_miss(df, q, ["g"], ["n"], [F.desc("v"), F.asc("n")], 3), "g", "n")
    assert {n for (g, n), r in got.items() if g == "x" and r.in_field} == {"x3", "x8"} and got["x", "x8"].predicted_rank == 2 and got["x", "x0"].predicted_rank is None
    assert {n for (g, n), r in got.items() if g == "y" and r.in_field} == {"y0", "y1", "y2"} and sum(g == "y" for g, _ in got) == 7


def test_short_query_finds_nothing(spark):
    df = spark.createDataFrame([("Anna", 1)], "n string, r int")
    assert R.search(df, "n", "a", [F.asc("r")]).count() == 0 and R.search(df, "n", "NN", [F.asc("r")]).count() == 1


def test_tiers_and_weights(spark):
    got = one(spark, *[marks.competition_tier(F.lit(c)) for c in ("World Championships 2019", "IAAF Continental Cup", "Diamond League Final", "Golden Spike")], *[marks.competition_weight(F.lit(v).cast("string")) for v in ("Olympic Stadium", "Bislett, Oslo (NOR)", "Ostrava", None)])
    assert list(got) == ["global", "continental", "dl_final", "tour", 1.3, 1.2, 1.0, 1.0]


def test_meeting_order(spark):
    df = spark.createDataFrame([("c", i, date(2026, 5, i)) for i in range(1, 6)], "c string, i int, d date")
    got = {k: r.status for k, r in table(R.meeting_status(df, ["c"], "d", F.lit("2026-05-03").cast("date"), F.col("i") == 5, ["i"]), "i").items()}
    assert got == {1: "done", 2: "done", 3: "next", 4: "upcoming", 5: "final"}


def test_matrices_make_no_cells_to_join(spark):
    """Matrix, coverage and mean rates of fields with a name twice, without a name, of one athlete: as by the grid; no grid is joined or sorted."""
    from meetlens.operators import h2h

    names = [("x", i % 7) for i in range(9)] + [("x", None), ("y", 3), (None, 1), (None, 2), ("z", 8), ("z", 9)]
    met = [(a, b, a % 2, 2 + b % 3) for a in range(9) for b in range(9) if a != b and (a * b) % 3 == 1]
    field = spark.createDataFrame(names, "grp string, athlete int")
    pairs = spark.createDataFrame(met, "athlete_a int, athlete_b int, wins long, meetings long")
    at = {(a, b): (w, m) for a, b, w, m in met}
    grid = [(g, a, b, *at.get((a, b), (None, None))) for g, a in names for h, b in names if g == h and g is not None and None not in (a, b) and a != b]
    order = lambda rows: sorted(rows, key=str)
    cells = h2h.matrix(field, pairs, ["grp"], "athlete")
    assert order(tuple(r)[:5] for r in cells.collect()) == order(grid)
    want = {g: (round(100 * sum(c[4] is not None for c in own) / len(own), 1), len(own)) for g in "xz" if (own := [c for c in grid if c[0] == g])}
    assert {r.grp: (r.coverage, r.pairs) for r in h2h.coverage(field, pairs, ["grp"], "athlete").collect()} == want == {r.grp: (r.coverage, r.pairs) for r in h2h.matrix_coverage(cells, ["grp"]).collect()}
    means = h2h.field_mean(field, pairs.withColumn("win_rate", F.col("wins") / F.col("meetings")), ["grp"], "athlete")
    for r in means.collect():
        own = [c[3] / c[4] for c in grid if c[:2] == (r.grp, r.athlete) and c[4]]
        assert abs(r.h2h_mean - (sum(own) / len(own) if own else 0.5)) < 1e-12
    assert means.count() == len(names)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(__names") < plan.index("Join") and plan.count("Join") == 2
