"""The forest's folds get all races of their seasons, and the operator's own trees."""

import numpy as np
from pyspark.sql import functions as F

from meetlens.models import forest
from meetlens.plans import catalog
from meetlens.plans.base import runs


def test_forest_walk_forward_uses_every_race(spark, sf, monkeypatch):
    seen = {}

    def folds(df, features, final, athlete, place, season, years, **how):
        seen.update(rows=df, how=how)
        return df.select(F.lit(1997).alias("fold"), F.lit(1).alias("hits"), F.lit(3).alias("possible"), F.lit(1).alias("winner_named")).limit(1)

    monkeypatch.setattr(forest, "folds", folds)
    catalog.queries()["forest_walk_forward"](spark, sf)
    want = runs(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    past = want.where("y < 1996").select("athlete").distinct()
    assert seen["how"] == {}
    assert seen["rows"].select("race").distinct().count() == want.where("y >= 1996").join(past, "athlete").select("race").distinct().count()


def rows_of(spark, n=3000):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3)).round(1)
    won = rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] * x[:, 2]))
    return spark.createDataFrame([(i // 6, i, i % 6 + 1, 2000 + i % 3, *map(float, x[i]), int(won[i])) for i in range(n)], "race int, athlete int, place int, y int, a double, b double, c double, label int")


def test_trees_over_cells_are_the_pipelines(spark):
    """The folds' chances are those of the pipeline's forest but for the draws; a forest of other draws is as far from it."""
    df, features = rows_of(spark), ["a", "b", "c"]
    train, test = df.where("y < 2002"), df.where("y = 2002")
    how = {"trees": 60, "depth": 8}
    p = lambda d: {r.athlete: r.win_probability for r in d.collect()}
    own, again, theirs, other = (p(d) for d in (forest.fold(train, test, features, **how), forest.fold(train.repartition(7), test, features, **how), *(forest.chances(forest.fit(train, features, seed=s, **how), test, features) for s in (1, 2))))
    assert own == again and own.keys() == theirs.keys() and len(own) == 1000
    far = lambda a, b: float(np.mean([abs(a[k] - b[k]) for k in a]))
    assert far(own, theirs) < 1.5 * far(theirs, other) and abs(np.mean([own[k] - theirs[k] for k in own])) < 0.01


def test_a_tree_counts_every_row():
    """One cut that parts the label, found through counts; leaves hold least_leaf rows at least."""
    bins, counts = np.array([[0, 0], [1, 0], [2, 0], [3, 0]], np.uint8), np.array([[900, 0], [900, 0], [0, 900], [0, 900]])
    asked = np.array([[0, 5], [1, 5], [2, 5], [3, 5]], np.uint8)
    assert all((forest.grow(bins, counts, asked, t, 16, 4, 1) == [0, 0, 1, 1]).all() for t in range(40))
    assert np.allclose(forest.grow(bins, counts, bins, 0, 0, 4, 1), 0.5, atol=0.05)


def test_folds_fit_the_pipeline_beyond_the_cells(spark, monkeypatch):
    df, seen = rows_of(spark, 600), []
    fit = forest.fit
    monkeypatch.setattr(forest, "CELLS", 10)
    monkeypatch.setattr(forest, "fit", lambda rows, features, **how: seen.append((rows.count(), how)) or fit(rows, features, **how))
    assert forest.folds(df, ["a", "b", "c"], ["race"], "athlete", "place", "y", [2002], trees=3, depth=3).count() == 100
    assert seen == [(400, {"label": "label", "trees": 3, "depth": 3, "least_leaf": 4, "seed": 42})]
