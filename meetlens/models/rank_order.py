"""Fitting and judging rank-order models of finals on the executors.

A final is one row (`pack`): its features as one array, its first three, its podium. Many models are fitted side by side: a model is a
set of training finals (seasons before one, perhaps of one event group), a penalty, bounds, and a permutation or none. Finals to learn from
are written once with their features as packed numbers; those of a batch with as many starters go together. Each step is one job: every task adds up the loss and gradient of all models over its finals, the sums come back as a row for each model, and each model makes
its own limited-memory quasi-Newton step, projected into its bounds. So a walk-forward over seasons, groups and settings takes as many
jobs as the slowest single fit, and nothing but sums and weights passes the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.models.plackett_luce import FieldModel, by_size, podiums
from meetlens.sources.shared import materialise

#: Fewest placed and scored starters of a final; share of scored starters of a competition that makes its finals fit for training.
LEAST_PLACED, LEAST_SCORED, LEAST_MATCH = 3, 5, 0.85
#: Penalty; bootstrap draws and the quantile they are read at.
L2, DRAWS, QUANTILE = 0.01, 10_000, 0.10
#: Pairs of steps and gradient changes that a model remembers.
MEMORY = 10


def pack(rows: DataFrame, final: list[str], athlete: str, place: str, score: str, features: list[str], competition: list[str], season: str, keep: list[str] = ()) -> DataFrame:
    """A row for each final with LEAST_PLACED placed and LEAST_SCORED scored starters, ordered by name, so that ties tell nothing.

    Columns: final, season, keep, x (the features of the scored starters, one after another), names, scores, medal and won (of the scored),
    top (positions of first, second and third; null if one of them has no score), possible (places on the podium), match (share of
    the competition's starters with a score) and trainable. Missing features are null in x: a model reads them as its training mean.
    """
    scored = F.col(score).isNotNull()
    matched = rows.groupBy(*competition).agg(F.avg(scored.cast("double")).alias("match"))
    item = F.struct(F.col(athlete).alias("name"), F.col(place).cast("int").alias("place"), F.col(score).cast("double").alias("score"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    groups = rows.groupBy(*dict.fromkeys([*final, *competition, season, *keep])).agg(F.sort_array(F.collect_list(F.when(scored, item))).alias("s"), F.count_if(F.col(place).between(1, 3)).alias("possible"))
    enough = groups.where((F.col("possible") >= LEAST_PLACED) & (F.size("s") >= LEAST_SCORED))
    at = [F.array_position(F.transform("s", lambda r: F.coalesce(r["place"], F.lit(0))), k).cast("int") - 1 for k in (1, 2, 3)]
    found = enough.select(
        *final,
        *(c for c in dict.fromkeys([*competition, season, *keep]) if c not in final),
        F.flatten(F.transform("s", lambda r: r["x"])).alias("x"),
        F.transform("s", lambda r: r["name"]).alias("names"),
        F.transform("s", lambda r: r["score"]).alias("scores"),
        F.transform("s", lambda r: F.coalesce(r["place"].between(1, 3), F.lit(False))).alias("medal"),
        F.transform("s", lambda r: F.coalesce(r["place"] == 1, F.lit(False))).alias("won"),
        F.when(F.least(*at) >= 0, F.array(*at)).alias("top"),
        F.col("possible").cast("int").alias("possible"),
    )
    return found.join(matched, competition).withColumn("trainable", F.col("top").isNotNull() & (F.col("match") >= LEAST_MATCH))


@dataclass
class Spec:
    """What a model is fitted on: finals of seasons before `before` (None: all), of `group` (None: all), with the features `columns`
    (positions, None: all). shuffled: these columns are permuted together within each final by `seed`, a control.
    """

    name: str
    before: int | None = None
    group: str | None = None
    l2: float = L2
    columns: list[int] | None = None
    bounds: dict[int, tuple[float | None, float | None]] = field(default_factory=dict)
    shuffled: list[int] | None = None
    seed: int = 0

    def takes(self, season: int, group: str | None) -> bool:
        return (self.before is None or season < self.before) and (self.group is None or self.group == group)


def permutation(n: int, seed: int, final: str) -> np.ndarray:
    """A final's own order of its starters: of the seed and its key, wherever its row is."""
    return np.random.default_rng([seed, zlib.crc32(final.encode())]).permutation(n)


def matrix(x: list, k: int, spec: Spec, final: str) -> np.ndarray:
    """The starters' features as a model reads them; missing ones stay nan."""
    m = np.array(x, float).reshape(-1, k)
    if spec.shuffled is not None:
        m[:, spec.shuffled] = m[permutation(len(m), spec.seed, final)][:, spec.shuffled]
    return m if spec.columns is None else m[:, spec.columns]


def top3_loss(u: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood of the observed first three of each final (a row of utilities), and its slope in every utility."""
    rows, free, loss, slope = np.arange(len(u)), np.ones(u.shape, bool), np.zeros(len(u)), np.zeros(u.shape)
    for i in top.T:
        e = np.where(free, u, -np.inf)
        e = np.exp(e - e.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        loss -= np.log(p[rows, i])
        slope += p
        slope[rows, i] -= 1
        free[rows, i] = False
    return loss, slope


def numbers(column: pa.Array) -> np.ndarray:
    """A flat numpy array; nan for null."""
    return np.asarray(column.to_numpy(zero_copy_only=False), float)


def joined(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of a column of packed ones, one row after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def parted(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of so many numbers each, packed."""
    ends = np.append(0, np.cumsum(sizes)) * numbers.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


def encoded(finals: DataFrame, final: list[str], k: int, seeds: list[int], group: str | None, season: str) -> DataFrame:
    """The finals to learn from with their features as packed numbers and every seed's permutation, which is drawn once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False) // k
            keys = batch.column("__key").to_pylist() if seeds else []
            drawn = [permutation(n, seed, key) for n, key in zip(sizes, keys) for seed in seeds]
            orders = np.concatenate(drawn).astype(np.int32) if drawn else np.zeros(0, np.int32)
            top = batch.column("top").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            packed = [parted(numbers(batch.column("x").flatten()), sizes * k), parted(top, np.full(len(sizes), 3)), parted(orders, sizes * len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column("__season"), batch.column("__group"), pa.array(sizes.astype(np.int32)), *packed], ["season", "grp", "n", "x", "top", "orders"])

    grouped = group or season
    rows = finals.where("trainable").select(F.concat_ws("|", *(F.col(c).cast("string") for c in final)).alias("__key"), "x", "top", F.col(season).cast("int").alias("__season"), F.col(grouped).cast("string").alias("__group"))
    return rows.mapInArrow(run, "season int, grp string, n int, x binary, top binary, orders binary")


class Search:
    """A bounded limited-memory quasi-Newton minimisation that is asked for points and told their loss and gradient."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high
        self.w = np.clip(np.zeros(len(low)), low, high)
        self.f, self.g = np.inf, np.zeros(len(low))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.size, self.asked = np.zeros(len(low)), 1.0, self.w
        self.done, self.converged = False, False

    def direction(self) -> np.ndarray:
        """Two loops over the remembered pairs, on the weights that a bound does not hold."""
        held = ((self.w <= self.low) & (self.g > 0)) | ((self.w >= self.high) & (self.g < 0))
        q, kept = np.where(held, 0, self.g), []
        for s, y in reversed(self.pairs):
            s, y = np.where(held, 0, s), np.where(held, 0, y)
            if s @ y > 1e-14:
                a = s @ q / (s @ y)
                q = q - a * y
                kept.append((s, y, a))
        if kept:
            q = q * (kept[0][0] @ kept[0][1]) / (kept[0][1] @ kept[0][1])
        for s, y, a in reversed(kept):
            q = q + (a - y @ q / (s @ y)) * s
        d = -np.where(held, 0, q)
        return d if d @ self.g < 0 else -np.where(held, 0, self.g)

    def tell(self, f: float, g: np.ndarray) -> None:
        """The loss and gradient at `asked`; sets the next point, or done."""
        moved = self.asked - self.w
        if np.isinf(self.f) or f <= self.f + 1e-4 * (self.g @ moved):
            if not np.isinf(self.f):
                y = g - self.g
                if moved @ y > 1e-14:
                    self.pairs = [*self.pairs[1 - MEMORY :], (moved, y)]
            little = not np.isinf(self.f) and self.f - f <= 1e-14 * max(1, abs(f))
            self.w, self.f, self.g = self.asked, f, g
            if np.abs(np.clip(self.w - g, self.low, self.high) - self.w).max(initial=0) < 1e-8 or little:
                self.done = self.converged = True
                return
            self.step, self.size = self.direction(), 1.0
            if not self.pairs:
                self.size = min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        else:
            self.size /= 2
            if self.size < 1e-12:
                self.done = True
                return
        self.asked = np.clip(self.w + self.size * self.step, self.low, self.high)


def _sums(rows: DataFrame, k: int, specs: list[Spec], seeds: list[int], of) -> dict[int, np.ndarray]:
    """By model, the sum of the vector of(model number, features, first three, the seed's permutations or none) over its finals.

    Finals of a batch with the same season, group and number of starters go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            x, top, orders = joined(batch.column("x"), float).reshape(-1, k), joined(batch.column("top"), np.int32).reshape(-1, 3), joined(batch.column("orders"), np.int32)
            own: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(batch.column("season").to_pylist(), batch.column("grp").to_pylist())):
                own.setdefault(key, []).append(row)
            sets: dict[tuple, list[int]] = {}  # the finals of seasons and groups that the same models take
            for (year, name), rows in own.items():
                sets.setdefault(tuple(i for i, spec in enumerate(specs) if spec.takes(year, name)), []).extend(rows)
            starts = np.cumsum(sizes) - sizes
            for models, rows in sets.items():
                rows = np.array(rows)
                for n, at, _ in by_size(sizes[rows] if models else sizes[:0]):
                    at = rows[at]
                    fields, first = x[starts[at][:, None] + np.arange(n)], top[at]
                    seeded = orders[(starts[at] * len(seeds))[:, None] + np.arange(len(seeds) * n)].reshape(len(at), len(seeds), n).astype(np.int64)
                    for i in models:
                        v = of(i, fields, first, None if specs[i].shuffled is None else seeded[:, seeds.index(specs[i].seed)])
                        if v is not None:
                            total[i] = total[i] + v if i in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["model", "v"])

    parts = rows.mapInArrow(run, "model int, v array<double>").select("model", F.posexplode("v").alias("at", "v"))
    sums = parts.groupBy("model", "at").agg(F.sum("v").alias("v"))  # a row for each model and weight
    out: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        out.setdefault(r.model, {})[r.at] = r.v
    return {i: np.array([v[j] for j in range(len(v))]) for i, v in out.items()}


def fit_many(finals: DataFrame, final: list[str], features: list[str], specs: list[Spec], season: str, group: str | None = None, steps: int = 200) -> dict[str, FieldModel]:
    """A model for each spec that has training finals. finals: as `pack` makes them; they are written once, packed.

    Features are standardised by the mean and population deviation over a model's own training starters (1 where there is none).
    """
    k = len(features)
    seeds = sorted({s.seed for s in specs if s.shuffled is not None})
    columns = [list(range(k)) if s.columns is None else list(s.columns) for s in specs]
    kept = materialise(encoded(finals, final, k, seeds, group, season), "finals").persist()
    try:

        def firsts(i: int, x: np.ndarray, top: np.ndarray, order: np.ndarray | None) -> np.ndarray:
            known = ~np.isnan(x)
            return np.concatenate([[len(x)], known.sum((0, 1)), np.where(known, x, 0).sum((0, 1))])

        means = {i: (int(v[0]), v[1 : 1 + k], v[1 + k :] / np.maximum(v[1 : 1 + k], 1)) for i, v in _sums(kept, k, specs, seeds, firsts).items()}

        def squares(i: int, x: np.ndarray, top: np.ndarray, order: np.ndarray | None) -> np.ndarray:
            d = np.nan_to_num(x - means[i][2])
            return (d * d).sum((0, 1))

        scales, searches = {}, {}
        for i, v in _sums(kept, k, specs, seeds, squares).items():
            n, known, mean = means[i]
            std = np.sqrt(v / np.maximum(known, 1))
            scales[i] = (mean[columns[i]], np.where(std < 1e-12, 1.0, std)[columns[i]], n)
            edge = [specs[i].bounds.get(j, (None, None)) for j in columns[i]]
            searches[i] = Search(np.array([-np.inf if a is None else a for a, _ in edge]), np.array([np.inf if b is None else b for _, b in edge]))
        for _ in range(steps):
            asked = {i: s.asked for i, s in searches.items() if not s.done}
            if not asked:
                break
            # by feature, for the columns that stay and for those that are permuted; the mean falls out of a softmax
            weights = {}
            for i, w in asked.items():
                by = np.zeros((k, 2))
                for j, v in zip(columns[i], w / scales[i][1]):
                    by[j, int(j in (specs[i].shuffled or ()))] += v
                weights[i] = by

            def losses(i: int, x: np.ndarray, top: np.ndarray, order: np.ndarray | None, weights=weights) -> np.ndarray | None:
                if i not in weights:
                    return None
                m, n, _ = x.shape
                flat = x.reshape(m * n, k) - means[i][2]
                if np.isnan(flat).any():
                    flat = np.nan_to_num(flat)
                if order is None:
                    loss, slope = top3_loss((flat @ weights[i][:, 0]).reshape(m, n), top)
                    grad = slope.reshape(-1) @ flat
                else:
                    stay, move = (flat @ weights[i]).T.reshape(2, m, n)
                    loss, slope = top3_loss(stay + np.take_along_axis(move, order, 1), top)
                    back = np.empty_like(slope)
                    np.put_along_axis(back, order, slope, 1)
                    grad = slope.reshape(-1) @ flat
                    grad[specs[i].shuffled] = (back.reshape(-1) @ flat)[specs[i].shuffled]
                return np.concatenate([[loss.sum()], grad[columns[i]] / scales[i][1]])

            told = _sums(kept, k, specs, seeds, losses)
            for i, w in asked.items():
                n, l2 = scales[i][2], specs[i].l2
                searches[i].tell(told[i][0] / n + l2 * w @ w, told[i][1:] / n + 2 * l2 * w)
    finally:
        kept.unpersist()
    names = [features if s.columns is None else [features[j] for j in s.columns] for s in specs]
    return {specs[i].name: FieldModel(names[i], *scales[i][:2], s.w, s.converged, scales[i][2]) for i, s in searches.items()}


def choose(settings: DataFrame, keys: list[str], passing: Column | None = None) -> DataFrame:
    """The one row, of those that pass, that is largest by the keys in order; ties go to the smallest setting. No row if none passes."""
    kept = settings if passing is None else settings.where(passing)
    return kept.orderBy(*(F.desc_nulls_last(k) for k in keys), "setting").limit(1)


RESULT = "model string, hits int, points_hits int, possible int, winner boolean, points_winner boolean, log_likelihood double, favourite_win double, chances array<double>"


def judge(finals: DataFrame, final: list[str], features: list[str], models: dict[str, FieldModel], specs: list[Spec], which: Column, season: str, keep: list[str] = ()) -> DataFrame:
    """Each final by each model named in the array `which`: medallists and winner named by the model and by the scores alone, the
    log-likelihood of the first three (null if one has no score), the favourite's chance to win, the chances of a podium.
    """
    known, k = {s.name: (s, models[s.name]) for s in specs if s.name in models}, len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = lambda c: batch.column(c).flatten()
            flags = lambda c: lists(c).to_numpy(zero_copy_only=False).astype(bool)
            x, scores, medal, won = numbers(lists("x")).reshape(-1, k), numbers(lists("scores")), flags("medal"), flags("won")
            sizes, asked = batch.column("scores").value_lengths().to_numpy(zero_copy_only=False), {}
            tops, keys, possible = batch.column("top").to_pylist(), batch.column("__key").to_pylist(), batch.column("possible").to_numpy(zero_copy_only=False)
            for row, names in enumerate(batch.column("__which").to_pylist()):
                for name in names:
                    asked.setdefault(name, []).append(row)
            for name, rows in asked.items():
                if name not in known:
                    continue
                (spec, m), rows = known[name], np.array(rows)
                for n, of, _ in by_size(sizes[rows]):
                    own = rows[of]
                    at = (np.cumsum(sizes) - sizes)[own][:, None] + np.arange(n)
                    z = x[at]
                    if spec.shuffled is not None:
                        order = np.array([permutation(n, spec.seed, keys[r]) for r in own])
                        z[:, :, spec.shuffled] = np.take_along_axis(z, order[:, :, None], 1)[:, :, spec.shuffled]
                    if spec.columns is not None:
                        z = z[:, :, spec.columns]
                    u = np.nan_to_num((z - m.mean) / m.std) @ m.weights
                    chance, e = podiums(u), np.exp(u - u.max(1, keepdims=True))
                    called, best = (np.argsort(-v, axis=1, kind="stable")[:, :3] for v in (chance, scores[at]))
                    hits, points = (np.take_along_axis(medal[at], picks, 1).sum(1).astype(np.int32) for picks in (called, best))
                    wins, points_wins = (np.take_along_axis(won[at], picks, 1)[:, 0] for picks in (np.argmax(chance, 1)[:, None], best))
                    none = np.array([tops[r] is None for r in own])
                    told = np.zeros(len(own))
                    if not none.all():
                        told[~none] = -top3_loss(u[~none], np.array([tops[r] for r in own[~none]]))[0]
                    made = [pa.array([name] * len(own)), pa.array(hits), pa.array(points), pa.array(possible[own].astype(np.int32)), pa.array(wins), pa.array(points_wins), pa.array(told, mask=none), pa.array(e.max(1) / e.sum(1)), pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * n, pa.array(chance.reshape(-1)))]
                    taken = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in held), *made], [*held, *(c.split()[0] for c in RESULT.split(", "))])

    held = list(dict.fromkeys([*final, season, *keep]))
    rows = finals.select(*held, F.concat_ws("|", *(F.col(c).cast("string") for c in final)).alias("__key"), which.alias("__which"), *(c for c in ("x", "scores", "medal", "won", "top", "possible") if c not in held))
    types = {c: finals.schema[c].dataType.simpleString() for c in held}
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + ", " + RESULT)


def walk_forward(finals: DataFrame, final: list[str], features: list[str], years: list[int], season: str, group: str | None = None, groups: list[str] | None = None, settings: list[Spec] | None = None, keep: list[str] = ()) -> DataFrame:
    """Every setting refitted for every test season on all seasons before it (and for each of groups on its own finals), then judged.

    A row for each final of the test seasons and setting; column setting. Finals whose model has no training finals are left out.
    """
    settings, specs = settings or [Spec("model")], []
    for s in settings:
        for year in years:
            for g in groups or [None]:
                specs.append(Spec(f"{s.name}/{year}/{'' if g is None else g}", year, g, s.l2, s.columns, s.bounds, s.shuffled, s.seed))
    kept = materialise(finals, "finals")
    models = fit_many(kept, final, features, specs, season, group)
    own = F.coalesce(F.col(group).cast("string"), F.lit("")) if groups else F.lit("")
    which = F.array(*(F.concat(F.lit(f"{s.name}/"), F.col(season).cast("int").cast("string"), F.lit("/"), own) for s in settings))
    found = judge(kept.where(F.col(season).isin(years)), final, features, models, specs, which, season, list(dict.fromkeys([*keep, *([group] if group else [])])))
    return found.withColumn("setting", F.split("model", "/")[0]).drop("model")


def best_setting(results: DataFrame) -> list[tuple]:
    """(setting, medallists named, winners named, log-likelihood) of each setting, the best first: by these in order, then by name."""
    sums = results.groupBy("setting").agg(F.sum("hits").alias("hits"), F.sum(F.col("winner").cast("int")).alias("winners"), F.sum("log_likelihood").alias("ll"))
    return sorted(((r.setting, r.hits, r.winners, r.ll) for r in sums.collect()), key=lambda r: (-r[1], -r[2], -(r[3] or 0), r[0]))


def bootstrap_lower(rows: DataFrame, value: str, key: list[str], draws: int = DRAWS, quantile: float = QUANTILE, seed: int = 0, by: list[str] = ()) -> DataFrame:
    """by, n, mean, lower: a low quantile of bootstrap means of value in each group.

    Each row's weights in all draws are Poisson numbers of the seed and the row's key, so a draw is the same however rows are dealt. A
    task sums weighted values and weights a draw; the quantile is read from the draws' means by order statistics, with interpolation.
    """
    names = [f"__b{i}" for i in range(len(by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = batch.to_pydict()
            for at, (own, v) in enumerate(zip(columns["__h"], columns["__v"])):
                group = tuple(columns[c][at] for c in names)
                weight = np.random.default_rng([seed, own & (1 << 63) - 1]).poisson(1.0, draws)
                add = np.stack([weight * v, weight.astype(float)])
                total[group] = total[group] + add if group in total else add
        for group, (sums, weights) in total.items():
            own = [pa.array([g] * draws, batch_types[c]) for c, g in zip(names, group)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(draws, dtype=np.int32)), pa.array(sums), pa.array(weights)], [*names, "draw", "s", "w"])

    from pyspark.sql.pandas.types import to_arrow_type

    picked = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.xxhash64(*key).alias("__h"), F.col(value).cast("double").alias("__v"))
    batch_types = {n: to_arrow_type(picked.schema[n].dataType) for n in names}
    schema = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in names) + "draw int, s double, w double"
    sums = picked.mapInArrow(run, schema).groupBy(*names, "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    lower = sums.where("w > 0").groupBy(*names).agg(F.percentile(F.col("s") / F.col("w"), quantile).alias("lower"))
    means = picked.groupBy(*names).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))
    both = means.join(lower, [means[n].eqNullSafe(lower[n]) for n in names], "left") if names else means.crossJoin(lower)
    return both.select(*(means[n].alias(c) for c, n in zip(by, names)), "n", "mean", "lower")


def ship_decisions(results: DataFrame, control: DataFrame, group: str, key: list[str], regional: Column, draws: int = DRAWS) -> DataFrame:
    """Per group: named medallists against the scores alone, the gain's lower bound, the regional finals' mean gain, the control's bound.

    passed: the bound is above 0, the regional mean is not below 0, and the control's bound is not above 0.
    """
    gain = results.withColumn("gain", F.col("hits") - F.col("points_hits"))
    own = bootstrap_lower(gain, "gain", key, draws, by=[group]).withColumnsRenamed({"mean": "mean_gain", "n": "finals"})
    there = gain.groupBy(F.col(group).alias("__g")).agg(F.avg(F.when(regional, F.col("gain"))).alias("regional_gain"), F.sum("hits").alias("hits"), F.sum("points_hits").alias("points_hits"))
    fails = bootstrap_lower(control.withColumn("gain", F.col("hits") - F.col("points_hits")), "gain", key, draws, by=[group]).select(F.col(group).alias("__c"), F.col("lower").alias("control_lower"))
    both = own.join(there, own[group].eqNullSafe(F.col("__g"))).join(fails, own[group].eqNullSafe(F.col("__c")), "left").drop("__g", "__c")
    passed = (F.col("lower") > 0) & F.coalesce(F.col("regional_gain") >= 0, F.lit(False)) & ~F.coalesce(F.col("control_lower") > 0, F.lit(False))
    return both.withColumn("passed", F.coalesce(passed, F.lit(False)))


def blocks(results: DataFrame, by: list[str], cuts: list[str]) -> DataFrame:
    """Per by, overall and by each cut (grouping sets): finals, medallists named by the model and by the scores, winners, places on the
    podium, mean log-likelihood, mean chance of the favourite and how often it won.
    """
    sets = [[F.col(c) for c in by], *([*(F.col(c) for c in by), F.col(cut)] for cut in cuts)]
    sums = [F.count("*").alias("finals"), F.sum("hits").alias("hits"), F.sum("points_hits").alias("points_hits"), F.sum("possible").alias("possible"), F.count_if("winner").alias("winners"), F.avg("log_likelihood").alias("log_likelihood"), F.avg("favourite_win").alias("favourite_win"), F.avg(F.col("winner").cast("double")).alias("favourite_won")]
    return results.groupingSets(sets, *(F.col(c) for c in [*by, *cuts])).agg(*sums, *(F.grouping(F.col(c)).alias(f"all_{c}") for c in cuts))


def compare(base: DataFrame, candidate: DataFrame, controls: list[DataFrame], key: list[str], regional: Column, draws: int = DRAWS) -> dict:
    """Candidate against baseline on the same finals: the bound of its mean gain in log-likelihood is above 0, it names as many
    medallists, its gain is not below 0 on regional finals, and no control (its new columns permuted) passes the first.
    """
    side = lambda df, n: df.select(*key, F.col("log_likelihood").alias(f"ll_{n}"), F.col("hits").alias(f"hits_{n}"))
    both = base.join(side(candidate, "c"), key).withColumns({"gain": F.col("ll_c") - F.col("log_likelihood"), "more": F.col("hits_c") - F.col("hits")})
    bound = bootstrap_lower(both, "gain", key, draws).first()
    sums = both.agg(F.count("*").alias("finals"), F.avg("more").alias("more"), F.avg(F.when(regional, F.col("gain"))).alias("regional")).first()
    lows = [bootstrap_lower(base.join(side(c, "c"), key).withColumn("gain", F.col("ll_c") - F.col("log_likelihood")), "gain", key, draws).first().lower for c in controls]
    checks = {"gain": (bound.lower or 0) > 0, "hits": sums.more is not None and sums.more >= 0, "regional": sums.regional is not None and sums.regional >= 0, "controls": not any(x is not None and x > 0 for x in lows)}
    return checks | {"finals": sums.finals, "mean_gain": bound.mean, "lower": bound.lower, "control_lower": lows, "ships": all(checks.values())}


def permuted(df: DataFrame, within: list[str], athlete: str, columns: list[str], seed: int) -> DataFrame:
    """The columns permuted together within each group, in an order of the seed, the group and the athlete: differs from group to group."""
    w = Window.partitionBy(*within)
    kept = df.withColumn("__i", F.row_number().over(w.orderBy(athlete)))
    moved = kept.select(*within, *columns, F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *(F.col(c) for c in within), athlete), athlete)).alias("__i"))
    return kept.drop(*columns).join(moved, [*within, "__i"]).drop("__i")
