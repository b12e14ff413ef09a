"""Distributed fits, walk-forward, controls and bootstrap against small numpy forms of the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlens.models import plackett_luce as pl
from meetlens.models import rank_order as ro
from meetlens.operators import asof

FEATURES = ["a", "b", "c"]
SCHEMA = "meet string, y int, tier string, grp string, athlete string, place int, score double, a double, b double, c double"


def finals_of(rng, n=60, unscored=0.04):
    """Rows of made-up finals whose order follows a and, less, b; c is noise. Some starters have no score."""
    rows = []
    for f in range(n):
        starters = int(rng.integers(6, 10))
        x = rng.normal(size=(starters, 3)) * [1, 2, 3] + [5, 0, 1]
        u = 1.5 * x[:, 0] + 0.4 * x[:, 1] + rng.gumbel(size=starters)
        place = np.argsort(np.argsort(-u)) + 1
        for i in range(starters):
            none = rng.random() < unscored
            rows.append((f"m{f % 7}", 2000 + f % 6, "asia" if f % 3 else "world", "gh"[f % 2], f"n{i:02d}-{f}", int(place[i]), None if none else float(x[i, 0]), *(None if none or (k == 2 and rng.random() < 0.1) else float(x[i, k]) for k in range(3))))
    return rows


@pytest.fixture(scope="module")
def packed(spark):
    rows = finals_of(np.random.default_rng(4))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("final", F.split("athlete", "-")[1]).repartition(5)
    return ro.pack(df, ["meet", "y", "final"], "athlete", "place", "score", FEATURES, ["meet", "y"], "y", ["tier", "grp"]).cache()


def plain(packed):
    """The packed finals as numpy, missing values as nan."""
    return [(r, np.array(r.x, float).reshape(-1, 3)) for r in packed.collect()]


def numpy_fit(finals, spec):
    """The driver's own fit on the same finals; missing values are the mean over known ones."""
    own = [(ro.matrix(r.x, 3, spec, f"{r.meet}|{r.y}|{r.final}"), np.array(r.top)) for r, _ in finals if r.trainable and spec.takes(r.y, r.grp)]
    mean = np.nanmean(np.concatenate([x for x, _ in own]), 0)
    std = np.nanstd(np.concatenate([x for x, _ in own]), 0)
    z = [(np.nan_to_num((x - mean) / std), top) for x, top in own]
    low, high = zip(*(spec.bounds.get(j, (None, None)) for j in range(z[0][0].shape[1])))
    low, high = (np.array([e if v is None else v for v in side]) for side, e in ((low, -np.inf), (high, np.inf)))
    w = np.zeros(len(mean))
    for _ in range(3000):  # plain projected gradient steps
        w = np.clip(w - 0.5 * pl.loss_and_gradient(w, z, spec.l2)[1], low, high)
    return mean, std, w, len(own)


def test_pack(spark, packed):
    rows = packed.collect()
    assert {"final", "x", "names", "medal", "won", "top", "possible", "match", "trainable"} <= set(packed.columns)
    for r in rows:
        assert list(r.names) == sorted(r.names) and len(r.x) == 3 * len(r.names) and r.possible == 3
        assert sum(r.medal) == (3 if r.top is not None else sum(r.medal)) and all(s is not None for s in r.scores)
        assert r.top is None or [r.won[i] for i in r.top] == [True, False, False]
    few = spark.createDataFrame([("m", 2000, "t", "g", f"n{i}-1", p, s, 1.0, 1.0, 1.0) for i, (p, s) in enumerate([(1, 1.0), (2, 1.0), (None, 1.0), (4, 1.0), (5, 1.0)])], SCHEMA).withColumn("final", F.lit("1"))
    assert ro.pack(few, ["final"], "athlete", "place", "score", FEATURES, ["meet", "y"], "y").count() == 0
    tie = spark.createDataFrame([("m", 2000, "t", "g", f"n{i}-1", p, s, 1.0, 1.0, None) for i, (p, s) in enumerate([(1, 1.0), (2, 1.0), (3, 1.0), (3, None), (5, 1.0), (6, 2.0)])], SCHEMA).withColumn("final", F.lit("1"))
    r = ro.pack(tie, ["final"], "athlete", "place", "score", FEATURES, ["meet", "y"], "y").first()
    assert (r.possible, list(r.top), round(r.match, 4), r.trainable, r.x[2]) == (4, [0, 1, 2], 0.8333, False, None)


def test_fits_equal_numpy(packed):
    """Models of seasons, of a group, with bounds, of some features and of permuted ones, fitted side by side."""
    specs = [ro.Spec("all"), ro.Spec("early", before=2003), ro.Spec("g", before=2004, group="g"), ro.Spec("bound", bounds={0: (None, 0.5), 1: (0.2, None)}), ro.Spec("two", columns=[1, 2], l2=0.1), ro.Spec("control", shuffled=[0, 1], seed=3)]
    finals, models = plain(packed), ro.fit_many(packed, ["meet", "y", "final"], FEATURES, specs, "y", "grp")
    for spec in specs:
        m, (mean, std, w, n) = models[spec.name], numpy_fit(finals, spec)
        assert m.finals == n and m.converged
        np.testing.assert_allclose(m.mean, mean, atol=1e-9)
        np.testing.assert_allclose(m.std, std, atol=1e-9)
        np.testing.assert_allclose(m.weights, w, atol=1e-4)
    assert models["all"].weights[0] > 0.8 and abs(models["all"].weights[2]) < 0.4
    assert models["bound"].weights[0] == 0.5
    none = ro.fit_many(packed, ["meet", "y", "final"], FEATURES, [ro.Spec("none", before=1990)], "y")
    assert none == {}


def test_walk_forward(packed):
    """Each test season is judged by models of the seasons before it only; the control does worse."""
    final, years = ["meet", "y", "final"], [2003, 2004, 2005]
    found = ro.walk_forward(packed, final, FEATURES, years, "y", "grp", ["g", "h"], [ro.Spec("model"), ro.Spec("control", shuffled=[0, 1, 2])], ["tier"]).cache()
    rows, finals = found.collect(), {(r.meet, r.y, r.final): (r, x) for r, x in plain(packed)}
    assert len(rows) == 2 * sum(y in years for _, y, _ in finals)
    for r in rows[::5]:
        spec = ro.Spec("x", r.y, r.grp, shuffled=[0, 1, 2] if r.setting == "control" else None)
        mean, std, w, _ = numpy_fit([finals[k] for k in finals], spec)
        own, _ = finals[r.meet, r.y, r.final]
        u = np.nan_to_num((ro.matrix(own.x, 3, spec, f"{r.meet}|{r.y}|{r.final}") - mean) / std) @ w
        np.testing.assert_allclose(r.chances, pl.podium_probabilities(u), atol=1e-3)
        assert r.hits == sum(own.medal[i] for i in np.argsort(-np.array(r.chances), kind="stable")[:3])
        assert (r.log_likelihood is None) == (own.top is None)
    hits = {s: sum(r.hits for r in rows if r.setting == s) for s in ("model", "control")}
    assert hits["model"] > hits["control"]
    assert [s for s, *_ in ro.best_setting(found)] == ["model", "control"]


def test_grid_of_54_settings(packed):
    """All settings side by side choose what each one alone would."""
    columns = [[0], [1], [2], [0, 1], [0, 2], [0, 1, 2]]
    grid = [ro.Spec(f"{l2}-{'abc'[c[0]]}{len(c)}{c[-1]}", l2=l2, columns=c) for l2 in (0.0001, 0.001, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0) for c in columns]
    final = ["meet", "y", "final"]
    found = ro.best_setting(ro.walk_forward(packed, final, FEATURES, [2004, 2005], "y", settings=grid))
    assert len(found) == 54
    alone = [ro.best_setting(ro.walk_forward(packed, final, FEATURES, [2004, 2005], "y", settings=[s]))[0] for s in grid if s.name in {x[0] for x in found[:2]}]
    assert sorted(alone, key=lambda r: (-r[1], -r[2], -r[3], r[0]))[0][0] == found[0][0]


def test_permutations_differ_between_finals(spark, packed):
    orders = {tuple(ro.permutation(8, 0, f"m|{i}")) for i in range(30)}
    assert len(orders) > 25 and (ro.permutation(8, 0, "m|1") == ro.permutation(8, 0, "m|1")).all()
    df = spark.createDataFrame([(g, f"n{i}", i, 10 * i) for g in range(30) for i in range(6)], "g int, athlete string, v int, w int")
    rows = ro.permuted(df, ["g"], "athlete", ["v", "w"], 1).collect()
    assert all(r.w == 10 * r.v for r in rows)
    by = {g: tuple(r.v for r in sorted(rows, key=lambda r: r.athlete) if r.g == g) for g in range(30)}
    assert all(sorted(v) == list(range(6)) for v in by.values()) and len(set(by.values())) > 20
    again = ro.permuted(df.repartition(7, "v"), ["g"], "athlete", ["v", "w"], 1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_bootstrap_is_close_to_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {"p": rng.normal(0.3, 1, 200), "q": rng.normal(-0.1, 2, 80), None: np.array([1.0])}
    df = spark.createDataFrame([(g, i, float(v)) for g, d in groups.items() for i, v in enumerate(d)] + [("p", 999, None)], "g string, i int, v double")
    found = {r.g: r for r in ro.bootstrap_lower(df.repartition(6), "v", ["g", "i"], draws=4000, by=["g"]).collect()}
    for g, d in groups.items():
        want = np.quantile(rng.choice(d, (4000, len(d))).mean(1), 0.1)
        assert found[g].n == len(d) and abs(found[g].mean - d.mean()) < 1e-9 and abs(found[g].lower - want) < 0.04
    again = {r.g: r.lower for r in ro.bootstrap_lower(df.repartition(2), "v", ["g", "i"], draws=4000, by=["g"]).collect()}
    assert all(abs(again[g] - found[g].lower) < 1e-9 for g in groups)
    assert ro.bootstrap_lower(df.limit(0), "v", ["i"], draws=10).first().lower is None


def test_choose(spark):
    rows = spark.createDataFrame([("a", 5, 1, True), ("b", 5, 2, True), ("c", 9, 9, False), ("d", 5, 2, True)], "setting string, hits int, winners int, ok boolean")
    assert ro.choose(rows, ["hits", "winners"], F.col("ok")).first().setting == "b" and ro.choose(rows, ["hits"]).first().setting == "c"
    assert ro.choose(rows, ["hits"], F.lit(False)).count() == 0


def test_blocks(spark):
    rows = spark.createDataFrame([("m", "g", 2000 + i % 2, i % 3, 1, 3, i % 2 == 0, -1.0, 0.5) for i in range(12)], "setting string, grp string, y int, hits int, points_hits int, possible int, winner boolean, log_likelihood double, favourite_win double")
    got = {(r.grp, r.y): (r.finals, r.hits, r.winners, r.favourite_won) for r in ro.blocks(rows, ["setting"], ["grp", "y"]).collect()}
    assert got == {(None, None): (12, 12, 6, 0.5), ("g", None): (12, 12, 6, 0.5), (None, 2000): (6, 6, 6, 1.0), (None, 2001): (6, 6, 0, 0.0)}


def test_rules(spark):
    results = spark.createDataFrame([(i, "g", "asia" if i % 2 else "world", 3, 1, -2.0) for i in range(30)] + [(i, "h", "asia", 1, 1, -2.0) for i in range(30, 60)], "k int, grp string, tier string, hits int, points_hits int, log_likelihood double")
    control = results.withColumn("hits", F.lit(1))
    ships = {r.grp: r for r in ro.ship_decisions(results, control, "grp", ["k"], F.col("tier") == "asia", 200).collect()}
    assert ships["g"].passed and not ships["h"].passed and ships["g"].mean_gain == 2 and ships["g"].hits == 90
    better = results.withColumns({"log_likelihood": F.col("log_likelihood") + 1})
    verdict = ro.compare(results, better, [results], ["k"], F.col("tier") == "asia", 200)
    assert verdict["ships"] and verdict["finals"] == 60 and verdict["mean_gain"] == 1
    assert not ro.compare(results, better, [better], ["k"], F.col("tier") == "asia", 200)["ships"]


def test_podium_chances_take_finals_by_the_batch(spark, monkeypatch):
    """Finals of all sizes at once, in few calls of Python; each as alone, with its own rows' columns."""
    rng = np.random.default_rng(5)
    rows = [(f if f else None, i, float(rng.normal()), "x") for f in range(400) for i in range(1 + f % 9)]
    df = spark.createDataFrame(rows, "f int, i int, u double, more string").repartition(3)
    found = pl.podium_chances(df, ["f"], "u")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString() and found.columns == ["f", "i", "u", "more", "podium_chance"]
    got = {(r.f, r.i): r.podium_chance for r in found.collect()}
    assert len(got) == len(rows)
    for f in range(0, 400, 7):
        own = [r for r in rows if r[0] == (f or None)]
        u = np.array([r[2] for r in own])
        e = np.exp(u)
        n, t = len(e), e.sum()
        third = lambda i: sum(e[j] / t * e[k] / (t - e[j]) * e[i] / (t - e[j] - e[k]) for j in range(n) for k in range(n) if len({i, j, k}) == 3)
        want = [1.0 if n <= 3 else e[i] / t + sum(e[j] / t * e[i] / (t - e[j]) for j in range(n) if j != i) + third(i) for i in range(n)]
        np.testing.assert_allclose([got[r[0], r[1]] for r in own], want, atol=1e-12)


def test_finals_are_read_by_the_batch(packed, monkeypatch):
    """A step's Python work is in calls for sizes and models of a batch, not for each final; no task holds more than a batch."""
    seen, whole = [], ro.top3_loss
    monkeypatch.setattr(ro, "top3_loss", lambda u, top: seen.append(len(u)) or whole(u, top))
    rows = ro.encoded(packed, ["meet", "y", "final"], 3, [3, 5], "grp", "y").collect()
    want = [r for r in packed.collect() if r.trainable]
    assert len(rows) == len(want) and sum(r.n for r in rows) == sum(len(r.names) for r in want)
    found = {(r.season, r.grp, r.x): r for r in rows}
    for r in want:
        x = np.array(r.x, float)
        own = found[r.y, r.grp, x.tobytes()]
        assert list(np.frombuffer(own.top, np.int32)) == list(r.top)
        n, orders = own.n, np.frombuffer(own.orders, np.int32)
        assert list(orders[n:]) == list(ro.permutation(n, 5, f"{r.meet}|{r.y}|{r.final}"))
    u = np.random.default_rng(1).normal(size=(50, 6))
    top = np.array([np.random.default_rng(i).permutation(6)[:3] for i in range(50)])
    loss, slope = ro.top3_loss(u, top)
    for i in range(50):
        one = pl.loss_and_gradient(np.ones(1), [(u[i][:, None], top[i])], 0)[0]
        assert abs(one - loss[i]) < 1e-9 and abs(slope[i].sum()) < 1e-9
    assert seen == [50]


def test_records_come_from_meetings(spark):
    """Records against the strongest by brute force: own days and seasons, draws, several rows of a race; no join on all own races."""
    rng = np.random.default_rng(2)
    races = [(f"r{r}", "g" if r % 2 else "h", int(a), 2000 + r % 2 + int(r % 9 == 0 and a % 2 == 1), f"200{r % 2}-0{1 + r % 8}-1{int(r % 7 == 0 and a % 3 == 0)}", int(rng.integers(1, 5))) for r in range(60) for a in rng.choice(9, 5)]
    entries = [(f"f{f}", "g" if f % 2 else "h", int(a), f"200{f % 2}-05-11", 2000 + f % 2, float(rng.integers(0, 4)) if a % 4 else None) for f in range(12) for a in rng.choice(9, 6, replace=False)]
    e = spark.createDataFrame(entries, "final string, grp string, athlete int, cutoff string, y int, s double")
    r = spark.createDataFrame(races, "race string, grp string, athlete int, y int, d string, place int")
    found = asof.record_against_strongest(e, r, ["final"], ["grp"], "athlete", "cutoff", "y", "s", ["race"], "d", "place")
    got = {(x.final, x.athlete): x.h2h_top for x in found.collect()}
    assert len(got) == len(entries)
    decided = 0
    for final, grp, a, cutoff, y, _ in entries:
        field = sorted((-s, b) for f, _, b, _, _, s in entries if f == final and s is not None)
        rivals = [b for _, b in field if b != a][:3]
        met = [(m[5], o[5]) for m in races if m[1:4] == (grp, a, y) and m[4] < cutoff for o in races if o[:2] == m[:2] and o[2] in rivals]
        won, lost = sum(m < o for m, o in met), sum(m > o for m, o in met)
        decided += won + lost
        assert abs(got[final, a] - ((won - lost) / (won + lost) if won + lost else 0)) < 1e-12
    assert decided > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and "__a#" in x and "__b#" in x]
