"""Follow-the-regularised-leader logistic regression over hashed presence features, and the steps of its two users.

Both classifiers learn from a bounded sample of labelled rows (TRAIN_ROWS), chosen by the hash of the id, and score every
row. The sample is taken from the labels first, so the join that fetches its texts broadcasts a bounded side; the hashed
features are made on the executors and only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import hold, slices

TRAIN_ROWS = 6000


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.08
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    bits: int = 20


@dataclass
class Model:
    """Sparse weights: only the coordinates that the L1 penalty left."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, int]], settings: Settings, seed: int = 0) -> Model:
    """FTRL-proximal with per-coordinate rates, a document at a time; no rows give a model that answers one half."""
    n, z = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)
    nb = zb = 0.0
    s, order = settings, np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs if rows else 0):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            own_n, own_z = n[at], z[at]
            w, wb = weights(own_z, own_n), -zb / ((s.beta + np.sqrt(nb)) / s.alpha)
            g = float(sigmoid(w.sum() + wb)) - label
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / s.alpha
            z[at], n[at] = own_z + g - sigma * w, own_n + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / s.alpha * wb
            nb += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept].astype(np.float32), float(-zb / ((s.beta + np.sqrt(nb)) / s.alpha)), s.bits)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents. A doc_id labelled twice counts with its larger label."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn_from)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(sampled: DataFrame, features: Callable[[str | None], np.ndarray], settings: Settings, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the sample, where an id has several texts on the `rows` smallest hashes; texts become features where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "label", "at"])

    kind = sampled.schema["doc_id"].dataType.simpleString()
    made = sampled.mapInArrow(run, f"doc_id {kind}, label int, at binary")
    found = made.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(rows).collect()
    found.sort(key=lambda r: (r.doc_id, r.at))
    return train([(np.frombuffer(r.at, "<u4"), r.label) for r in found], settings)


def score(docs: DataFrame, model: Model, features: Callable[[str | None], np.ndarray], keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The kept columns (doc_id), then score double (under a prefix, if given): the sigmoid of a sparse dot product, for every row."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        w = model.dense()
        for batch in slices(batches):
            found = [float(sigmoid(model.bias + w[features(t)].sum(dtype=np.float64))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, f"{prefix}score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, f"{schema}, `{prefix}score` double")


_HASHES: dict[bytes, int] = {}


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """32-bit hashes; a worker remembers those of frequent tokens."""
    import xxhash

    hold("hashes", _HASHES.clear)
    known, of = _HASHES, xxhash.xxh32_intdigest
    if len(known) > 200_000:
        known.clear()
    try:
        return np.array([known[t] for t in tokens], np.uint32)
    except KeyError:
        for t in tokens:
            if t not in known:
                known[t] = of(t)
        return np.array([known[t] for t in tokens], np.uint32)


def grams(hashes: np.ndarray, spans: tuple[tuple[int, ...], ...], bits: int, first_salt: int = 0) -> np.ndarray:
    """Distinct hashed features: for each span, the tokens at these offsets, in order, under a salt of its own."""
    found = []
    for salt, span in enumerate(spans, first_salt):
        if (m := len(hashes) - span[-1]) <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * (salt + 1) & 0xFFFFFFFF, np.uint32)
        for k in span:
            h = (h ^ hashes[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32((1 << bits) - 1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)
