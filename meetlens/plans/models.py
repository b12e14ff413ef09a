"""Features of fields at their cut-offs, and rank-order models walked forward over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meetlens.models import field_features as FF
from meetlens.models import rank_order as RO
from meetlens.models.plackett_luce import FieldModel
from meetlens.operators import asof
from meetlens.operators import reports as Q
from meetlens.plans.base import PLACED_SQL, query, runs

ALL = [*FF.FEATURES, *FF.RACE_FEATURES, *FF.LEVEL_FEATURES]
BORN = "CASE WHEN athlete % 11 <> 0 THEN DATE '1970-01-01' + CAST(athlete * 37 % 9000 AS INTEGER) END"


def fields(t):
    """Urgent orders are the finals; all orders are the races that came before."""
    r = runs(t)
    entries = r.where(F.col("tier").startswith("1")).select(F.col("race").alias("final"), "athlete", F.col("d").alias("cutoff"), "y", "place", "tier")
    entries = entries.withColumn("dob", F.when(F.col("athlete") % 11 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (F.col("athlete") * 37 % 9000).cast("int"))))
    races = r.select("race", "athlete", "d", "y", "v", "place", "tier")
    states = asof.as_of_states(entries, races, [], "athlete", "cutoff", "d", "y", "v", "place", F.col("tier").startswith("2"))
    return asof.record_against_strongest(states, races, ["final"], [], "athlete", "cutoff", "y", "sb_score", ["race"], "d", "place")


def featured(t):
    return FF.field_features(fields(t), ["final"], "cutoff")


#: States, records and levels of every scored entrant of every final, in SQL.
FIELDS_SQL = f"""WITH {PLACED_SQL}, e AS (SELECT race AS final, athlete, d AS cutoff, y, place FROM runs WHERE tier LIKE '1%'),
x AS (SELECT e.final, e.athlete, any_value(e.cutoff) AS cutoff, any_value(e.y) AS y, max(CASE WHEN r.y = e.y THEN r.v END) AS now, arg_max(r.d, (r.v, -epoch(CAST(r.d AS TIMESTAMP)))) FILTER (r.y = e.y) AS now_date,
 max(CASE WHEN r.y = e.y - 1 THEN r.v END) AS prev, arg_max(r.d, (r.v, -epoch(CAST(r.d AS TIMESTAMP)))) FILTER (r.y = e.y - 1) AS prev_date, max(CASE WHEN r.y = e.y - 2 THEN r.v END) AS two, max(CASE WHEN r.y <= e.y - 3 THEN r.v END) AS older,
 arg_max(r.y, (r.v, r.y)) FILTER (r.y <= e.y - 3) AS older_year, max(CASE WHEN r.y < e.y THEN r.v END) AS career, (list(r.v ORDER BY r.v DESC) FILTER (r.y = e.y))[1:3] AS top,
 max(CASE WHEN r.y = e.y AND r.d >= e.cutoff - 42 THEN r.v END) AS recent, count(CASE WHEN r.y = e.y THEN 1 END) AS races, least(5, count(CASE WHEN r.y = e.y AND r.tier LIKE '2%' AND r.place <= 3 THEN 1 END)) AS podiums
 FROM e LEFT JOIN runs r ON r.athlete = e.athlete AND r.d < e.cutoff GROUP BY 1, 2),
s AS (SELECT *, coalesce(now, prev) AS s, CASE WHEN now IS NULL THEN prev_date ELSE now_date END AS sd, CASE WHEN now IS NULL THEN 1e0 ELSE 0e0 END AS prior, list_aggregate(top, 'avg') AS form, {BORN} AS dob FROM x WHERE now IS NOT NULL OR prev IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY final ORDER BY s DESC, athlete) AS n FROM s),
p AS (SELECT * FROM (SELECT a.final, a.athlete, a.cutoff, a.y, b.athlete AS rival, row_number() OVER (PARTITION BY a.final, a.athlete ORDER BY b.n) AS j FROM k a JOIN k b ON a.final = b.final AND a.athlete <> b.athlete) WHERE j <= 3),
h AS (SELECT p.final, p.athlete, count(CASE WHEN m.place < o.place THEN 1 END) AS w, count(CASE WHEN m.place > o.place THEN 1 END) AS l FROM p JOIN runs m ON m.athlete = p.athlete AND m.y = p.y AND m.d < p.cutoff JOIN runs o ON o.race = m.race AND o.athlete = p.rival GROUP BY 1, 2),
c AS (SELECT k.*, coalesce((w - l)::DOUBLE / nullif(w + l, 0), 0) AS h2h, coalesce(form, s) AS f, least(greatest(races, 1), 5) / 5e0 * greatest(0, 1 - coalesce(list_max(top) - list_min(top), 0) / 50e0) AS cons FROM k LEFT JOIN h USING (final, athlete)),
g AS (SELECT *, CASE WHEN career IS NULL OR f >= career THEN f ELSE (0.5 + 0.5 * cons) * f + (0.5 - 0.5 * cons) * career END AS strong,
 f + least(greatest(0, coalesce(0.35 * greatest(0, prev - f), 0), coalesce(0.35 * 0.3 * greatest(0, two - f), 0), coalesce(0.35 * pow(0.3, greatest(3, y - older_year) - 1) * greatest(0, older - f), 0)), 0.75 * greatest(0, max(f) OVER w - f)) AS level FROM c WINDOW w AS (PARTITION BY final)),
z AS (SELECT *, list(s) OVER w AS ss, list(strong) OVER w AS gs, list(level) OVER w AS ls, date_diff('day', dob, cutoff) / 365.25 AS years FROM g WINDOW w AS (PARTITION BY final)),
u AS (SELECT *, list_reverse_sort(ss)[least(3, len(ss))] AS s3, list_reverse_sort(gs)[least(3, len(ss))] AS g3, list_reverse_sort(ls)[least(3, len(ss))] AS l3, median(years) OVER (PARTITION BY final) AS mid FROM z)"""


@query(f"""{FIELDS_SQL}
SELECT final, athlete, {", ".join(f"round({sql}, 6)::DOUBLE AS {name}" for name, sql in {
    "gap_best": "(s - list_max(ss)) / 100", "gap_third": "(s - s3) / 100", "pb_gap": "coalesce((career - s) / 100, 0)", "no_history": "CASE WHEN career IS NULL THEN 1 ELSE 0 END", "sb_months": "date_diff('day', sd, cutoff) / 30.44",
    "yoy": "CASE WHEN prior = 0 THEN coalesce((s - prev) / 100, 0) ELSE 0 END", "age": "coalesce(years, mid, 25)", "sb_prior_season": "prior", "form_gap": "(f - list_max(ss)) / 100", "recent_delta": "coalesce((recent - f) / 100, 0)",
    "no_recent": "CASE WHEN recent IS NULL THEN 1 ELSE 0 END", "big_podiums": "podiums", "h2h_top": "h2h", "pb_gap_thin": "CASE WHEN races <= 2 THEN coalesce((career - s) / 100, 0) ELSE 0 END", "breakout_backed": "coalesce(CASE WHEN career IS NOT NULL THEN greatest(0, f - career) / 100 END, 0)",
    "consistency": "cons", "strength_gap_best": "(strong - list_max(gs)) / 100", "strength_gap_third": "(strong - g3) / 100", "fade_gap_best": "(level - list_max(ls)) / 100", "fade_gap_third": "(level - l3) / 100"}.items())} FROM u""")
def field_feature_matrix(t):
    """All features of every athlete of every final, from races strictly before its day."""
    return featured(t).select("final", "athlete", *(F.round(c, 6).alias(c) for c in ALL))


def packed(t, features):
    rows = featured(t).withColumns({"competition": F.date_format("cutoff", "yyyy-MM"), "grp": F.when(F.month("cutoff") <= 6, "spring").otherwise("autumn")})
    return RO.pack(rows, ["final"], "athlete", "place", "sb_score", features, ["competition"], "y", ["grp"])


YEARS = list(range(1995, 1999))


@query()
def field_model_backtest(t):
    """Rank-order model refitted for every season on the seasons before it, beside its control (features permuted in each final). Rows only."""
    names = [*FF.FEATURES, *FF.RACE_FEATURES]
    settings = [RO.Spec("model"), RO.Spec("control", shuffled=list(range(len(names))))]
    found = RO.walk_forward(packed(t, names), ["final"], names, YEARS, "y", settings=settings)
    return found.groupBy("setting", "y").agg(F.count("*").alias("finals"), F.sum("hits").alias("hits"), F.sum("points_hits").alias("points_hits"), F.count_if("winner").alias("winners"), F.avg("log_likelihood").alias("log_likelihood"))


@query()
def field_model_by_group(t):
    """A model for each group and season, fitted side by side, and whether each group's would ship. Rows only."""
    final, years, groups = ["final"], YEARS, ["spring", "autumn"]
    settings = [RO.Spec("model"), RO.Spec("control", shuffled=list(range(len(FF.FEATURES))))]
    found = RO.materialise(RO.walk_forward(packed(t, FF.FEATURES), final, FF.FEATURES, years, "y", "grp", groups, settings), "judged")
    side = lambda s: found.where(F.col("setting") == s)
    return RO.ship_decisions(side("model"), side("control"), "grp", final, F.col("final") % 5 == 0, 1000)


@query()
def field_model_grid(t):
    """Penalties and families of features, all fitted and judged at once over the same seasons. Rows only."""
    names = [*FF.FEATURES, *FF.RACE_FEATURES, *FF.LEVEL_FEATURES]
    at = lambda cs: [names.index(c) for c in cs]
    families = {"basic": at(FF.FEATURES), "races": at([*FF.FEATURES, *FF.RACE_FEATURES]), "levels": at([*FF.LEVEL_FEATURES, "no_history", "sb_months", "age", "recent_delta"])}
    grid = [RO.Spec(f"{family}-{l2}", l2=l2, columns=c) for family, c in families.items() for l2 in (0.001, 0.01, 0.1)]
    found = RO.walk_forward(packed(t, names), ["final"], names, YEARS[-2:], "y", settings=grid)
    return found.groupBy("setting").agg(F.sum("hits").alias("hits"), F.count_if("winner").alias("winners"), F.sum("log_likelihood").alias("log_likelihood"))


CALL = FieldModel(["gap_best", "form_gap", "h2h_top"], np.zeros(3), np.ones(3), np.array([0.012, 0.008, 0.5]))


@query(f"""{FIELDS_SQL}, v AS (SELECT final, athlete, s, count(*) OVER (PARTITION BY final) AS n, 0.012 * (s - list_max(ss)) / 100 + 0.008 * (f - list_max(ss)) / 100 + 0.5 * h2h AS x FROM u),
q AS (SELECT *, exp(x - max(x) OVER (PARTITION BY final)) AS e FROM v), r AS (SELECT *, sum(e) OVER (PARTITION BY final) AS t FROM q),
pb AS (SELECT a.final, a.athlete, sum(b.e / b.t * a.e / (a.t - b.e)) AS p FROM r a JOIN r b ON a.final = b.final AND a.athlete <> b.athlete GROUP BY 1, 2),
pc AS (SELECT a.final, a.athlete, sum(b.e / b.t * c.e / (b.t - b.e) * a.e / (a.t - b.e - c.e)) AS p FROM r a JOIN r b ON a.final = b.final AND a.athlete <> b.athlete JOIN r c ON c.final = a.final AND c.athlete <> a.athlete AND c.athlete <> b.athlete GROUP BY 1, 2),
z2 AS (SELECT r.*, CASE WHEN n <= 3 THEN 1 ELSE r.e / t + pb.p + pc.p END AS podium FROM r LEFT JOIN pb USING (final, athlete) LEFT JOIN pc USING (final, athlete))
SELECT final, athlete, 'model' AS called_by, row_number() OVER (PARTITION BY final ORDER BY round(podium, 9) DESC, s DESC, athlete) AS rank, round(100 * podium, 4) AS podium_chance, round(100 * e / t, 4) AS win_chance, NULL AS reason FROM z2 WHERE n >= 3
UNION ALL SELECT final, athlete, 'points', row_number() OVER (PARTITION BY final ORDER BY s DESC, athlete), NULL, NULL, NULL FROM z2 WHERE n < 3
UNION ALL SELECT e.final, e.athlete, 'unranked', NULL, NULL, NULL, CASE WHEN e.athlete % 7 = 0 THEN 'injured' ELSE 'noMark' END FROM e ANTI JOIN u ON u.final = e.final AND u.athlete = e.athlete""")
def event_reports(t):
    """Every final called before it was run: by the model where three entrants are scored, else by points; the others with a reason."""
    rows = RO.materialise(fields(t), "fields")
    flags = t("supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("athlete"), F.lit("remove").alias("status"), F.lit("injured").alias("reason"))
    out = Q.event_report(rows, FF.field_features(rows, ["final"], "cutoff"), ["final"], "athlete", "sb_score", CALL, flags)
    return out.select("final", "athlete", "called_by", "rank", *(F.round(100 * F.col(c), 4).alias(c) for c in ("podium_chance", "win_chance")), "reason")


@query()
def field_model_compare(t):
    """A candidate's features against a baseline's on the same held-out finals: sums overall, by tier, group and season, with the
    verdict of the rule on every row. Rows only."""
    names = [*FF.FEATURES, *FF.RACE_FEATURES]
    base, new = list(range(len(FF.FEATURES))), list(range(len(FF.FEATURES), len(names)))
    settings = [RO.Spec("baseline", columns=base), RO.Spec("candidate"), *(RO.Spec(f"control{i}", shuffled=new, seed=i) for i in range(2))]
    found = RO.materialise(RO.walk_forward(packed(t, names), ["final"], names, YEARS[-2:], "y", settings=settings, keep=["grp"]), "judged")
    side = lambda s: found.where(F.col("setting") == s)
    verdict = RO.compare(side("baseline"), side("candidate"), [side("control0"), side("control1")], ["final"], F.col("final") % 5 == 0, 500)
    return RO.blocks(found.where(F.col("setting").isin("baseline", "candidate")), ["setting"], ["grp", "y"]).withColumn("ships", F.lit(verdict["ships"]))
