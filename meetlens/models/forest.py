"""Forest model of podium places: a pipeline of vector, scaler and random forest, with expanding folds.

A tree of the pipeline reads a feature only as its bin (BINS by quantiles), and a row only as its weight in the tree's bootstrap, a
Poisson number. So rows of the same bins are one cell with two counts, of which Poisson numbers are drawn: the same trees in distribution,
over all rows, with a step's work in cells and not in rows. The folds grow them so, a share of the trees a task, while there are CELLS cells
at most; else they fit the pipeline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlens.sources.shared import materialise

Keys = list[str]
#: Bins of a feature, as the pipeline has them; most cells that a task holds.
BINS, CELLS = 32, 1 << 20


def pipeline(features: Keys, label: str = "label", trees: int = 300, depth: int = 16, least_leaf: int = 4, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), RandomForestClassifier(featuresCol="_scaled", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, seed=seed)])


def filled(df: DataFrame, features: Keys) -> DataFrame:
    return df.fillna(0.0, subset=features)


def fit(df: DataFrame, features: Keys, **how) -> PipelineModel:
    return pipeline(features, **how).fit(filled(df, features))


def chances(model: PipelineModel, df: DataFrame, features: Keys, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """win_probability of each row, within the display bounds."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(filled(df, features)).withColumn("win_probability", F.least(F.lit(high), F.greatest(F.lit(low), p))).drop("_raw", "_scaled", "rawPrediction", "probability", "prediction")


def binned(df: DataFrame, features: Keys, cuts: list[list[float]]) -> DataFrame:
    """Columns __b0, __b1, ...: how many cuts each feature is above."""
    below = lambda f: lambda x: x < F.col(f).cast("double")
    return df.withColumns({f"__b{i}": F.size(F.filter(F.array(*(F.lit(x) for x in own)).cast("array<double>"), below(f))).cast("int") for i, (f, own) in enumerate(zip(features, cuts))})


def grow(train: np.ndarray, counts: np.ndarray, test: np.ndarray, tree: int, depth: int, least_leaf: int, seed: int) -> np.ndarray:
    """The chance that one tree gives each test cell. train, test: bins, a row a cell; counts: rows without and with the label.

    Gini impurity; a node tries the root of the number of features, its own choice; a side of a split has least_leaf rows of the
    bootstrap at least.
    """
    rng, k = np.random.default_rng([seed, tree]), train.shape[1]
    weights, tried = rng.poisson(counts).astype(float), int(np.ceil(np.sqrt(k)))
    kept = weights.sum(1) > 0
    bins, weights, out = train[kept], weights[kept], np.zeros(len(test))
    node, goes, found, nodes = np.zeros(len(bins), np.int64), np.zeros(len(test), np.int64), np.arange(len(test)), 1
    for level in range(depth + 1):
        total = np.stack([np.bincount(node, weights[:, c], nodes) for c in (0, 1)], 1)
        rows = total.sum(1)
        out[found] = (total[:, 1] / np.maximum(rows, 1))[goes]
        if level == depth or not len(bins):
            break
        chosen = np.argsort(rng.random((nodes, k)), 1)[:, :tried]
        gain, feature, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        whole = (total * total).sum(1) / np.maximum(rows, 1)
        for f in range(k):
            at = node * BINS + bins[:, f]
            left = np.stack([np.bincount(at, weights[:, c], nodes * BINS).reshape(nodes, BINS).cumsum(1)[:, :-1] for c in (0, 1)])
            right = total.T[:, :, None] - left
            n, m = left.sum(0), right.sum(0)
            # impurity lost, times rows
            lost = (left * left).sum(0) / np.maximum(n, 1) + (right * right).sum(0) / np.maximum(m, 1) - whole[:, None]
            lost[(n < least_leaf) | (m < least_leaf) | ~(chosen == f).any(1)[:, None]] = 0
            best = lost.argmax(1)
            more = lost[np.arange(nodes), best] > gain + 1e-9
            gain[more], feature[more], cut[more] = lost[more, best[more]], f, best[more]
        splits = gain > 0
        number = np.cumsum(splits) - 1
        nodes = 2 * int(splits.sum())
        if not nodes:
            break
        down = lambda x, at: 2 * number[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
        on, far = splits[node], splits[goes]
        bins, weights, node = bins[on], weights[on], down(bins[on], node[on])
        found, goes = found[far], down(test[found[far]], goes[far])
    return out


def fold(train: DataFrame, test: DataFrame, features: Keys, label: str = "label", trees: int = 300, depth: int = 16, least_leaf: int = 4, seed: int = 42, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """test with win_probability by a forest of all rows of train, as `chances` of `fit` gives it."""
    rows, asked, keys = filled(train, features), filled(test, features), [f"__b{i}" for i in range(len(features))]
    at = [i / BINS for i in range(1, BINS)]
    marks = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(k) for f, k in zip(features, keys))).first()
    cuts = [sorted(set(m)) for m in marks]
    asked = binned(asked, features, cuts)
    cells = materialise(binned(rows, features, cuts).groupBy(*keys).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")), "cells")
    wanted = materialise(asked.select(*keys).distinct(), "wanted")
    if max(cells.count(), wanted.count()) > CELLS:
        return chances(fit(train, features, label=label, trees=trees, depth=depth, least_leaf=least_leaf, seed=seed), test, features, low, high)
    numpy = lambda df, columns: np.stack([df.column(c).to_numpy() for c in columns], 1)
    known, new = cells.orderBy(*keys).toArrow(), wanted.orderBy(*keys).toArrow()
    bins, counts, cells_asked = numpy(known, keys).astype(np.uint8), numpy(known, ["n0", "n1"]), numpy(new, keys).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells_asked))
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                total += grow(bins, counts, cells_asked, tree, depth, least_leaf, seed)
        yield pa.RecordBatch.from_arrays([*(pa.array(cells_asked[:, i].astype(np.int32)) for i in range(len(keys))), pa.array(total)], [*keys, "__p"])

    spark = train.sparkSession
    votes = spark.range(0, trees, 1, min(trees, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", __p double")
    p = votes.groupBy(*keys).agg(F.round(F.sum("__p") / trees, 12).alias("__p"))  # rounded, so that the order of the sum tells nothing
    return asked.join(p, keys).withColumn("win_probability", F.least(F.lit(high), F.greatest(F.lit(low), F.col("__p")))).drop(*keys, "__p")


def called(df: DataFrame, final: Keys, athlete: str) -> DataFrame:
    return df.withColumn("called", F.row_number().over(Window.partitionBy(*final).orderBy(F.desc("win_probability"), athlete)))


def folds(df: DataFrame, features: Keys, final: Keys, athlete: str, place: str, season: str, years: list[int], **how) -> DataFrame:
    """Per season a fit on all earlier ones: final, season, hits, possible, winner_named. The loop is over seasons, not rows."""
    from meetlens.models.evaluation import hits

    df, out = materialise(df, "races"), None
    for year in years:
        train, test = df.where(F.col(season) < year), df.where(F.col(season) == year)
        if not train.limit(1).count():
            continue
        scored = called(fold(train, test, features, **how), final, athlete)
        one = hits(scored, final, "called", place).withColumn("fold", F.lit(year))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no season has an earlier one to learn from")
    return out


def tune(df: DataFrame, grid: list[dict], **how) -> list[dict]:
    """Each setting of the grid with the hit rate of its folds, best first; equal rates keep the grid's order."""
    rows = []
    for setting in grid:
        r = folds(df, **how, **setting).agg(F.sum("hits").alias("h"), F.sum("possible").alias("p")).first()
        rows.append(setting | {"hit_rate": (r.h or 0) / (r.p or 1)})
    return sorted(rows, key=lambda r: -r["hit_rate"])


def save(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    (model.write().overwrite() if overwrite else model.write()).save(path)
