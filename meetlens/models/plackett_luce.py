"""Rank-order model of finals: chances as plans, fitting in numpy.

Chances of one final need only that final's rows. Win chances are windows. Podium chances are grouped by final and computed
with Arrow, in closed form over all ordered pairs, so a final of n costs n squared in one array and no join rows; finals of a size go together. `fit` is for finals
that one task holds; tables are fitted on the executors, by rank_order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.operators.order import join_null_safe

Keys = list[str]
#: Pairs of starters that are held at once.
PAIRS = 1 << 18


def win_chances(df: DataFrame, final: Keys, utility: str, name: str = "win_chance") -> DataFrame:
    """Softmax within each final."""
    w = Window.partitionBy(*final)
    e = F.exp(F.col(utility) - F.max(utility).over(w))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def podium_probabilities(u: np.ndarray) -> np.ndarray:
    """Probability of a place among the first three, exactly; all ones up to three starters. Sums to three."""
    return podiums(u[None])[0]


def podiums(u: np.ndarray) -> np.ndarray:
    """podium_probabilities of many finals with the same number of starters, a row each."""
    n = u.shape[1]
    if n <= 3:
        return np.ones(u.shape)
    out = np.empty(u.shape)
    for at in range(0, len(u), most := max(1, PAIRS // (n * n))):
        e = np.exp(u[at : at + most] - u[at : at + most].max(1, keepdims=True))
        total = e.sum(1, keepdims=True)
        first, rest, own = e / total, total - e, np.arange(n)
        pair = first[:, :, None] * (e[:, None, :] / rest[:, :, None])  # i first, j second
        pair[:, own, own] = 0
        left = rest[:, :, None] - e[:, None, :]
        left[:, own, own] = 1
        scaled = pair / np.maximum(left, 1e-300)
        third = e * (scaled.sum((1, 2))[:, None] - scaled.sum(2) - scaled.sum(1))
        out[at : at + most] = np.clip(first + pair.sum(1) + third, 0, 1)
    return out


def by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lists of the same length: the length, which lists, and where their items are in all lists, one after another."""
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, starts[at][:, None] + np.arange(n)


def podium_chances(df: DataFrame, final: Keys, utility: str, name: str = "podium_chance") -> DataFrame:
    """A final is a row while its chances are found, so that a batch of finals passes Python at once, not one by one."""

    @F.arrow_udf("array<double>")
    def chances(u: pa.Array) -> pa.Array:
        sizes, flat = u.value_lengths().to_numpy(zero_copy_only=False), u.flatten().to_numpy(zero_copy_only=False)
        out = np.ones(len(flat))
        for n, _, at in by_size(sizes):
            out[at] = podiums(flat[at])
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(out))

    finals = df.groupBy(*final).agg(F.collect_list(F.struct(*(F.col(c) for c in df.columns))).alias("__rows"))
    u = F.transform("__rows", lambda r: F.coalesce(r[utility].cast("double"), F.lit(float("nan"))))
    both = finals.select("__rows", chances(u).alias("__p")).select(F.explode(F.arrays_zip("__rows", "__p")).alias("__r"))
    return both.select("__r.__rows.*", F.col("__r.__p").alias(name))


def podium_chances_by_joins(df: DataFrame, final: Keys, athlete: str, utility: str, name: str = "podium_chance") -> DataFrame:
    """The same inside the JVM, for finals of a few starters: second place by one self-join, third by two."""
    w = Window.partitionBy(*final)
    e = df.withColumn("_e", F.exp(F.col(utility) - F.max(utility).over(w))).withColumns({"_t": F.sum("_e").over(w), "_n": F.count("*").over(w)})
    side = lambda i: e.select(*final, F.col(athlete).alias(f"_{i}"), F.col("_e").alias(f"_e{i}"))
    me = e.select(*final, athlete, "_e", "_t", "_n")
    two = me.join(side(1), final).where(F.col(athlete) != F.col("_1"))
    second = two.groupBy(*final, athlete).agg(F.sum(F.col("_e1") / F.col("_t") * F.col("_e") / (F.col("_t") - F.col("_e1"))).alias("_s"))
    three = two.join(side(2), final).where((F.col(athlete) != F.col("_2")) & (F.col("_1") != F.col("_2")))
    third = three.groupBy(*final, athlete).agg(F.sum(F.col("_e1") / F.col("_t") * F.col("_e2") / (F.col("_t") - F.col("_e1")) * F.col("_e") / (F.col("_t") - F.col("_e1") - F.col("_e2"))).alias("_d"))
    out = df.join(me.join(second, [*final, athlete], "left").join(third, [*final, athlete], "left").select(*final, athlete, F.when(F.col("_n") <= 3, F.lit(1.0)).otherwise(F.col("_e") / F.col("_t") + F.col("_s") + F.col("_d")).alias(name)), [*final, athlete])
    return out


def top3_log_likelihood(df: DataFrame, final: Keys, utility: str, place: str) -> DataFrame:
    """Log-probability of the observed first three of each final."""
    w = Window.partitionBy(*final)
    e = df.withColumn("_m", F.max(utility).over(w)).withColumn("_e", F.exp(F.col(utility) - F.col("_m")))
    p = F.col(place)
    sums = e.groupBy(*final).agg(F.sum("_e").alias("s1"), F.sum(F.when(p.isNull() | (p > 1), F.col("_e"))).alias("s2"), F.sum(F.when(p.isNull() | (p > 2), F.col("_e"))).alias("s3"), F.sum(F.when(p <= 3, F.col(utility) - F.col("_m"))).alias("u"), F.count_if(p <= 3).alias("k"))
    return sums.where("k = 3").select(*final, (F.col("u") - F.log("s1") - F.log("s2") - F.log("s3")).alias("log_likelihood"))


@dataclass
class FieldModel:
    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    converged: bool = True
    finals: int = 0
    notes: dict = field(default_factory=dict)

    def utility(self) -> Column:
        """Standardised features times weights, as one expression."""
        terms = [(F.coalesce(F.col(f), F.lit(float(m))) - float(m)) / float(s) * float(w) for f, m, s, w in zip(self.features, self.mean, self.std, self.weights)]
        return sum(terms[1:], terms[0])


def loss_and_gradient(w: np.ndarray, finals: list[tuple[np.ndarray, np.ndarray]], l2: float) -> tuple[float, np.ndarray]:
    """Negative mean log-likelihood of the first three plus L2. finals: (standardised rows, indices of the first three)."""
    loss, grad = 0.0, np.zeros_like(w)
    for x, top in finals:
        u = x @ w
        free = np.ones(len(u), bool)
        for i in top:
            e = np.where(free, np.exp(u - u[free].max()), 0)
            p = e / e.sum()
            loss -= np.log(p[i])
            grad -= x[i] - p @ x
            free[i] = False
    n = max(len(finals), 1)
    return loss / n + l2 * w @ w, grad / n + 2 * l2 * w


def fit(finals: list[tuple[np.ndarray, np.ndarray]], features: list[str], l2: float = 0.01, bounds: tuple[float | None, float | None] | None = None, steps: int = 300) -> FieldModel:
    """Standardises (population deviation, 1 where there is none) and minimises by BFGS with steps projected into the bounds."""
    rows = np.concatenate([x for x, _ in finals])
    mean, std = rows.mean(0), rows.std(0)
    std[std == 0] = 1
    data = [((x - mean) / std, top) for x, top in finals]
    low, high = ((-np.inf if b is None else b) if k == 0 else (np.inf if b is None else b) for k, b in enumerate(bounds or (None, None)))
    w, h, converged = np.clip(np.zeros(rows.shape[1]), low, high), np.eye(rows.shape[1]), False
    f, g = loss_and_gradient(w, data, l2)
    for _ in range(steps):
        if np.linalg.norm(np.clip(w - g, low, high) - w) < 1e-7:
            converged = True
            break
        step, size = -h @ g, 1.0
        if step @ g >= 0:
            step, h = -g, np.eye(len(w))
        while size > 1e-12:
            new = np.clip(w + size * step, low, high)
            nf, ng = loss_and_gradient(new, data, l2)
            if nf <= f + 1e-4 * (g @ (new - w)):
                break
            size /= 2
        else:
            break
        s, y = new - w, ng - g
        if s @ y > 1e-12:
            rho, eye = 1 / (s @ y), np.eye(len(w))
            h = (eye - rho * np.outer(s, y)) @ h @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        else:
            h = np.eye(len(w))
        w, f, g = new, nf, ng
    return FieldModel(features, mean, std, w, converged, len(finals))


# Levels of a field


def strength(form: str, career: str, consistency: Column) -> Column:
    """Form and career best blended by consistency: weight 0.5 + 0.5 of it on form; never above what was there if older is worse."""
    weight = 0.5 + 0.5 * consistency
    return F.when(F.col(career).isNull() | (F.col(form) >= F.col(career)), F.col(form)).otherwise(weight * F.col(form) + (1 - weight) * F.col(career))


#: How much last season's best lifts, what each further year leaves of it, and the share of the gap to the leader it may close.
FADE_LAST_SEASON, FADE_PER_YEAR, FADE_CAP = 0.35, 0.3, 0.75


def faded_level(df: DataFrame, final: Keys, now: str, old: list[tuple[str, Column]], last_season: float = FADE_LAST_SEASON, per_year: float = FADE_PER_YEAR, cap: float = FADE_CAP) -> DataFrame:
    """Season level plus the largest faded lift of older bests, at most `cap` of the gap to the field's best season level.

    old: (column of a best, how many seasons ago). lift_from is the column that lifts. The cap is on season levels, so an
    old mark never passes the leader.
    """
    lifts = F.array(*(F.struct(F.greatest(F.lit(0.0), F.coalesce((F.col(c) - F.col(now)) * last_season * F.pow(F.lit(per_year), ago - 1), F.lit(0.0))).alias("lift"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, (c, ago) in enumerate(old)))
    best = df.groupBy(*final).agg(F.max(now).alias("_best"))
    room = F.greatest(F.lit(0.0), F.col("_best") - F.col(now)) * cap
    out = join_null_safe(df, best, final).withColumn("_l", F.array_max(lifts)).withColumn("lift", F.least(F.col("_l.lift"), room))
    return out.withColumns({"level": F.col(now) + F.col("lift"), "lift_from": F.when(F.col("lift") > 0, F.col("_l.name"))}).drop("_l", "_best")


def old_mark_reason(now: str, lift: str = "lift", source: str = "lift_from") -> Column:
    """Which older best counted and what it closed, as text; null if none."""
    return F.when(F.col(lift) > 0, F.format_string("%s: +%.1f on %.1f", F.col(source), F.col(lift), F.col(now)))
