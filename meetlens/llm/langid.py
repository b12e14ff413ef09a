"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, across words and white space, in runs of RUN bytes, from a zero state in both directions, and
labels every position; a document's probabilities are the mean over the positions of its letters (ASCII letters and bytes of
longer characters), whole. The end of a last run is zero bytes, which the network has learned to read. Training is
backpropagation through time in numpy over the same runs, of a bounded sample of documents: for each language the ROWS
documents with the smallest hashes, however rare the language is. Of a document of more than RUNS runs, RUNS spread evenly
over the whole text are learned from. Languages are drawn alike; a pass over all runs is made, and STEPS updates at least.

One more label stands for text in no learned language. It is learned from runs of the same documents with their letters
exchanged, each by a permutation of its own. It takes no part in the prediction; its share of the positions is a column of
its own, `unknown`, by which a filter may reject a document.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; runs without a letter take no part;
rows with a null id are labelled and learned from like others; repeated rows are labelled alike; without any known
language every row is `und` with score 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.llm.common import hold, slices

UND = "und"
RUN, EMBED, HIDDEN, BATCH, RATE = 48, 8, 8, 128, 0.03
#: Bounds of the training sample: documents of a language, runs of a document; and the least number of updates.
ROWS, RUNS, STEPS = 300, 2048, 500
#: Runs that are read at a time.
LANES = 1024
LETTER = np.array([1.0 if b >= 0x80 or chr(b).isalpha() else 0.0 for b in range(256)], np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """One matrix set per direction: byte embedding times input weights (table), recurrent weights, output weights."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def initial(n: int, rng) -> dict[str, np.ndarray]:
    w = {"E": rng.normal(0, 0.3, (256, EMBED)), "Y": rng.normal(0, 0.3, (2 * HIDDEN, n)), "c": np.zeros(n)}
    for d in "fb":
        w |= {f"W{d}": rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def steps(w: dict, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction (time x runs x hidden) over bytes (time x runs), and what backpropagation needs."""
    t, n = x.shape
    table, u, two = w["E"] @ w[f"W{d}"] + w[f"b{d}"], w[f"U{d}"], 2 * HIDDEN
    h, out, kept = np.zeros((n, HIDDEN), np.float32), np.empty((t, n, HIDDEN), np.float32), []
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        a, b = table[x[k]], h @ u
        g = sigmoid(a[:, :two] + b[:, :two])
        r, z = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(a[:, two:] + r * b[:, two:])
        kept.append((k, h, r, z, c, b[:, two:]))
        h = c + z * (h - c)
        out[k] = h
    return out, kept


def back(w: dict, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction."""
    u = w[f"U{d}"]
    each, du, dh = np.empty((*x.shape, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(dout.shape[1:], np.float32)
    for k, h, r, z, c, bc in reversed(kept):
        dh = dh + dout[k]
        dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
        each[k] = np.concatenate([dc * bc * r * (1 - r), dz, dc], 1)
        db = np.concatenate([each[k, :, : 2 * HIDDEN], dc * r], 1)
        du += h.T @ db
        dh = dh * z + db @ u.T
    order = np.argsort(x, axis=None, kind="stable")
    read = x.ravel()[order]
    first = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
    dtable = np.zeros((256, 3 * HIDDEN), np.float32)
    dtable[read[first]] = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    grad[f"U{d}"], grad[f"b{d}"] = du, dtable.sum(0)
    grad[f"W{d}"] = w["E"].T @ dtable
    grad["E"] = grad.get("E", 0) + dtable @ w[f"W{d}"].T


def gradient(w: dict, x: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean cross-entropy of the letters' positions; x: time x runs, labels: the runs' languages."""
    (hf, kf), (hb, kb) = steps(w, "f", x), steps(w, "b", x)
    h = np.concatenate([hf, hb], 2)
    d = h @ w["Y"] + w["c"]
    d = np.exp(d - d.max(2, keepdims=True))
    d /= d.sum(2, keepdims=True)
    d[:, np.arange(len(labels)), labels] -= 1
    weight = LETTER[x]
    d *= (weight / max(weight.sum(), 1))[:, :, None]
    flat = d.reshape(-1, d.shape[2])
    grad = {"Y": h.reshape(len(flat), -1).T @ flat, "c": flat.sum(0)}
    dh = d @ w["Y"].T
    back(w, "f", x, kf, dh[:, :, :HIDDEN], grad)
    back(w, "b", x, kb, dh[:, :, HIDDEN:], grad)
    return grad


def exchanged(run: np.ndarray, rng) -> np.ndarray:
    """The run with its ASCII letters exchanged, small and capital alike."""
    table, order = np.arange(256, dtype=np.uint8), rng.permutation(26)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1] = ord("a") + order, ord("A") + order
    return table[run]


def train(runs: list[np.ndarray], languages: list[str], seed: int = 0) -> Model:
    """runs: of each language, bytes (runs x RUN). Adam; each update takes BATCH runs, of languages in turn."""
    rng, n = np.random.default_rng(seed), len(languages)
    w = initial(n + 1, rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    many = max(STEPS, -(-sum(map(len, runs)) // BATCH))
    decks: list[list[int]] = [[] for _ in runs]
    for t in range(1, many + 1):
        labels, own = np.arange(t, t + BATCH) % (n + 1), []
        for i, k in enumerate(labels.tolist()):
            k = k if k < n else (t + i) // (n + 1) % n
            decks[k] = decks[k] or rng.permutation(len(runs[k])).tolist()
            own.append(runs[k][decks[k].pop()] if labels[i] < n else exchanged(runs[k][rng.integers(len(runs[k]))], rng))
        rate = RATE * min(1, 2 * (1 - t / (many + 1)))
        for k, g in gradient(w, np.ascontiguousarray(np.array(own).T), labels).items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return Model(languages, w)


def cut(raw: bytes, run: int = RUN) -> np.ndarray:
    """A text's bytes in runs, the last one filled with zero bytes; runs without a letter are left out."""
    own = np.frombuffer(raw + bytes(-len(raw) % run), np.uint8).reshape(-1, run)
    return own[LETTER[own].any(1)]


def lettered(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


class Reader:
    """Probabilities of texts, whole. Weights are laid out so that a gate costs one exponential, in buffers used again."""

    def __init__(self, model: Model):
        self.model = model
        if model.languages:
            w, two, n = model.weights, 2 * HIDDEN, len(model.languages) + 1
            scale = np.array([-1.0] * two + [-2.0] * HIDDEN, np.float32)
            laid = lambda x: np.ascontiguousarray(x.T)
            self.parts = [(laid((w["E"] @ w[f"W{d}"] + w[f"b{d}"]) * scale), laid(w[f"U{d}"] * scale), laid(w["Y"][at])) for d, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, two)))]
            self.buffers = [np.empty(k * LANES, np.float32) for k in (3 * HIDDEN, 3 * HIDDEN, HIDDEN, n, RUN * n)]

    def probabilities(self, runs: np.ndarray) -> np.ndarray:
        """Sums of the label probabilities over each run's letters, for LANES runs at most."""
        n, two, x = len(runs), 2 * HIDDEN, np.ascontiguousarray(runs.T).astype(np.intp)
        a, b, h, y, logits = (v[: len(v) // LANES * n].reshape(-1, n) for v in self.buffers)
        logits = logits.reshape(RUN, -1, n)
        logits[:] = self.model.weights["c"][:, None]
        for (table, u, out), order in zip(self.parts, (range(RUN), range(RUN - 1, -1, -1))):
            h[:] = 0
            gates, reset, update, new = a[:two], a[:HIDDEN], a[HIDDEN:two], a[two:]
            for k in order:
                np.take(table, x[k], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=b)
                gates += b[:two]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                reset *= b[two:]
                new += reset
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                h -= new
                h *= update
                h += new
                logits[k] += np.matmul(out, h, out=y)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (LETTER[x] / logits.sum(1))[:, None]
        return logits.sum(0, dtype=np.float64).T

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text: the language, its share among the learned ones, and the share of the label for none of them."""
        languages, out = self.model.languages, [(UND, 0.0, 1.0)] * len(texts)
        known = [(i, cut(t.encode())) for i, t in enumerate(texts) if languages and t and lettered(t)]
        if not known:
            return out
        runs, owner = np.concatenate([r for _, r in known]), np.repeat(np.arange(len(known)), [len(r) for _, r in known])
        total = np.zeros((len(known), len(languages) + 1))
        for k in range(0, len(runs), LANES):
            np.add.at(total, owner[k : k + LANES], self.probabilities(runs[k : k + LANES]))
        unknown = total[:, -1] / np.maximum(total.sum(1), 1e-300)
        share = total[:, :-1] / np.maximum(total[:, :-1].sum(1, keepdims=True), 1e-300)
        for (i, _), own, none in zip(known, share, unknown.tolist()):
            best = int(own.argmax())
            out[i] = (languages[best], min(1.0, float(own[best])), min(1.0, none))
        return out


def fit(docs: DataFrame, learn_from: Column, rows: int = ROWS, runs: int | None = RUNS) -> Model:
    """Fits on at most `rows` documents of each language (those with the smallest hashes of id and language) that meet learn_from.

    Of each document `runs` runs are learned from, spread evenly over it; None: all of them.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn_from).withColumn("_h", F.xxhash64("doc_id", "lang"))
    place = F.rank().over(Window.partitionBy("lang").orderBy("_h"))  # hashes alone, so that no task gathers texts it will not use
    least = known.select("lang", "_h").withColumn("_k", place).where(F.col("_k") <= rows).select("lang", "_h").distinct()
    chosen = known.join(F.broadcast(least), ["lang", "_h"]).groupBy("_h", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                own = cut(text.encode()) if lettered(text) else np.zeros((0, RUN), np.uint8)
                found.append(own[np.linspace(0, len(own) - 1, runs).astype(int) if runs and len(own) > runs else slice(None)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_h"), pa.array(found, pa.binary())], ["lang", "h", "runs"])

    found: dict[str, list] = {}
    for r in chosen.mapInArrow(run, "lang string, h long, runs binary").toLocalIterator():
        if r.runs:
            found.setdefault(r.lang, []).append((r.h, bytes(r.runs)))
    languages = sorted(found)
    if not languages:
        return Model([], {})
    return train([np.frombuffer(b"".join(x for _, x in sorted(found[k])), np.uint8).reshape(-1, RUN) for k in languages], languages)


def label(docs: DataFrame, model: Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The kept columns (doc_id), then lang_pred string, score double, unknown double; a prefix keeps these apart from kept ones."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bytes", lambda: None)
        own = Reader(shared.value)
        for batch in slices(batches):
            found = own(batch.column("text").to_pylist())
            made = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}unknown"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    own = f"`{prefix}lang_pred` string, `{prefix}score` double, `{prefix}unknown` double"
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, f"{schema}, {own}")
