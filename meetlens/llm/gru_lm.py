"""Gated recurrent language model with a class-factored softmax, for log-likelihoods of complete documents.

A text is its words (A-Z lower-cased, split at ASCII white space) and one end token. A token is read as a unit: the end, the
unknown word, each of the CLUSTERS * SIZE most frequent words, and, for all rarer words, the band of counts and the group of
word endings that they are in. P(token | what came before) = P(class | state) x P(word | class, state): the state of a gated
recurrent network over the units gives a softmax over the classes and, inside a class of frequent words (SIZE neighbours in
frequency), a softmax over its words. A class of rare words is one unit; inside it a word has the share of its count, since
a softmax over all rare words would need weights in proportion to the vocabulary. Words that training lacks are one class
with one member, as in the add-one base score.

Four steps. Workers turn runs of documents (a block: BLOCK bytes of text at most) into local word numbers and one
dictionary a block, written to the shared folder. One shuffle by word sums the dictionaries' training counts, so a word costs a
row per block and never a row per occurrence. Each block meets its counts again, and its documents become base scores,
in-class shares and two bytes per token, its unit. The network is trained on every training document by truncated
backpropagation in numpy: every partition trains a copy, with one optimiser's state, and copies are averaged in two levels, in
ROUNDS rounds that take different documents. A training token's target is the unit it would have were it not counted itself,
so that the unknown class gets the rate at which words are new. Scoring carries the state across windows of a document.
Counts do not depend on how the rows are dealt; weights do, as far as the average of copies does.

Defined cases: null and empty texts are one end token; repeated rows are scored alike; a null id counts as empty text for
the fold; with no training documents every word is unknown and N is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.llm.common import ascii_words, materialise, slices

BLOCK, CLUSTERS, SIZE, BANDS, GROUPS = 24 << 20, 16, 64, (1, 2, 4, 16, 256), 8
END, UNKNOWN, FIRST, TOP = 0, 1, 2, CLUSTERS * SIZE
UNITS, CLASSES = FIRST + TOP + len(BANDS) * GROUPS, FIRST + CLUSTERS + len(BANDS) * GROUPS
#: Marks a unit whose word would be in the band below, were this token not counted.
EDGE = 1 << 15
EMBED, HIDDEN, SPAN, LANES, ROUNDS, RATE, TOKENS = 16, 16, 32, 512, 2, 0.02, 4_000_000
#: Positions whose class scores are held at a time, in one buffer that is used again: fresh memory costs more than the sums.
CHUNK = 2048


def group_of(word: bytes) -> int:
    """The group of a word's ending."""
    return zlib.crc32(word[-3:]) % GROUPS


def rare_unit(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Units of words that are not among the most frequent."""
    band = np.searchsorted(BANDS, counts, side="right") - 1
    return np.where(band < 0, UNKNOWN, FIRST + TOP + band * GROUPS + groups)


def class_of(units: np.ndarray) -> np.ndarray:
    units = np.asarray(units, np.int32)
    return np.where(units < FIRST, units, np.where(units < FIRST + TOP, FIRST + (units - FIRST) // SIZE, units - TOP + CLUSTERS))


def targets_of(codes: np.ndarray) -> np.ndarray:
    """The unit of each token, were it not counted itself; codes: units, with EDGE where that is another one."""
    units = (codes & (EDGE - 1)).astype(np.int32)
    below = np.where(units < FIRST + TOP + GROUPS, UNKNOWN, units - GROUPS)
    return np.where(codes & EDGE, below, units)


# Blocks


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of two kinds: a document (doc_id, held_out, ids) or a block's dictionary (words, counts, groups)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, id_type = TaskContext.get().partitionId() << 24, 0, pa.null()
        at: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)

        def dictionary() -> pa.RecordBatch:
            row = [[block], [None], [None], [None], [[w.decode() for w in at]], [counts[: len(at)].tolist()], [[group_of(w) for w in at]]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types(id_type))], NAMES)

        for batch in slices(batches):
            id_type = batch.schema.field("doc_id").type
            out = []
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                words = ascii_words(text)
                try:
                    ids = np.array([at[w] for w in words], np.int32)
                except KeyError:
                    for w in words:
                        if w not in at:
                            at[w] = len(at)
                    ids = np.array([at[w] for w in words], np.int32)
                if len(at) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(at) - len(counts), np.int64)])
                if not held:
                    np.add.at(counts, ids, 1)
                size += len(text or "")
                out.append(ids.tobytes())
            n = batch.num_rows
            empty = [pa.nulls(n, t) for t in types(id_type)[4:]]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.binary()), *empty], NAMES)
            if size >= BLOCK:
                yield dictionary()
                block, size, at, counts = block + 1, 0, {}, counts[:0]
        if at:
            yield dictionary()

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, f"block long, doc_id {kind}, held_out boolean, ids binary, words array<string>, counts array<long>, groups array<int>")


NAMES = ["block", "doc_id", "held_out", "ids", "words", "counts", "groups"]


def types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), id_type, pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]


# Counts


@dataclass
class Counts:
    """Totals over all training tokens, and what the classes' shares need; all of bounded size."""

    n: int
    v: int
    ends: int
    top: list[tuple[int, int]] = field(default_factory=list)  # count and number of the most frequent words
    in_unit: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))
    targets: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))


def counted(rows: DataFrame) -> DataFrame:
    """block, pos, word, grp, c, is_first: every dictionary entry with the word's count over all training documents."""
    entries = rows.where("words IS NOT NULL").select("block", F.posexplode(F.arrays_zip("words", "counts", "groups")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"), F.col("x.groups").alias("grp"))
    word = Window.partitionBy("word")
    return entries.select("block", "pos", "word", "grp", F.sum("n").over(word).alias("c"), (F.col("block") == F.min("block").over(word)).alias("is_first"))


def totals(entries: DataFrame, training_docs: int) -> tuple[Counts, list[tuple[str, int]]]:
    """The totals, and the most frequent words' units."""
    known = entries.where("is_first AND c > 0")
    limit = BANDS[-1] + 2
    found = known.groupBy(F.least("c", F.lit(limit)).alias("k"), "grp").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    top = known.select("word", "c", "grp").orderBy(F.desc("c"), "word").limit(TOP).collect()
    ends = training_docs
    out = Counts(sum(r.c for r in found) + ends, sum(r.v for r in found) + (ends > 0), ends)
    out.in_unit[END] = out.targets[END] = ends
    for sign, rows in ((1, [(r.k, r.grp, r.c) for r in found]), (-1, [(min(r.c, limit), r.grp, r.c) for r in top])):
        k, g, c = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        np.add.at(out.in_unit, rare_unit(k, g), sign * c)
        np.add.at(out.targets, rare_unit(k - 1, g), sign * c)
    for i, r in enumerate(top):
        out.in_unit[FIRST + i] = out.targets[FIRST + i] = r.c
    out.in_unit[UNKNOWN] = 1
    return out, [(r.word, FIRST + i) for i, r in enumerate(top)]


def coded(rows: DataFrame, entries: DataFrame, counts: Counts, top: list[tuple[str, int]]) -> DataFrame:
    """A row per document: n_tokens, n_known, base_score, in_unit (log10 of the shares in rare classes), codes (two bytes a token)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    frequent = F.broadcast(rows.sparkSession.createDataFrame(top, "word string, top int"))  # TOP rows at most
    own = entries.join(frequent, "word", "left").select("block", "pos", "grp", "c", "top")
    base = math.log10(counts.n + counts.v + 1)
    in_unit = np.log10(np.maximum(counts.in_unit, 1e-300))
    ends = counts.ends

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        n = words.num_rows
        pos = words.column("pos").to_numpy()
        c, grp, unit = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        c[pos], grp[pos], unit[pos] = words.column("c").to_numpy(), words.column("grp").to_numpy(), words.column("top").fill_null(-1).to_numpy()
        often = unit >= 0
        unit = np.where(often, unit, rare_unit(c, grp))
        code = (unit | np.where(~often & np.isin(c, BANDS), EDGE, 0)).astype("<u2")
        base_of = np.log10(c + 1.0) - base
        own_of = np.where((c > 0) & ~often, np.log10(np.maximum(c, 1)) - in_unit[unit], 0.0)
        out, end = [], np.array([END], "<u2").tobytes()
        for raw in docs.column("ids").to_pylist():
            ids = np.frombuffer(raw, np.int32)
            known = int((c[ids] > 0).sum()) + (ends > 0)
            out.append((len(ids) + 1, known, float(base_of[ids].sum()) + math.log10(ends + 1) - base, float(own_of[ids].sum()), code[ids].tobytes() + end))
        made = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
        return pa.table([docs.column("doc_id"), docs.column("held_out"), *made], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "in_unit", "codes"])

    texts = rows.where("ids IS NOT NULL").select("block", "doc_id", "held_out", "ids")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, in_unit double, codes binary"
    return texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)


# Network


def initial(targets: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Output biases start at the shares of classes and of words in them, so an untrained network is a unigram model."""
    rng = np.random.default_rng(seed)
    classes = np.bincount(class_of(np.arange(UNITS)), targets, CLASSES)
    words = targets[FIRST : FIRST + TOP].reshape(CLUSTERS, SIZE)
    w = {"E": rng.normal(0, 0.3, (UNITS, EMBED)), "W": rng.normal(0, 0.3, (EMBED, 3 * HIDDEN)), "U": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN)}
    w |= {"Y": rng.normal(0, 0.05, (HIDDEN, CLASSES)), "c": np.log((classes + 0.5) / (classes.sum() + 0.5 * CLASSES))}
    w |= {"V": rng.normal(0, 0.05, (CLUSTERS, HIDDEN, SIZE)), "v": np.where(words > 0, np.log(np.maximum(words, 1) / np.maximum(words.sum(1, keepdims=True), 1)), -30.0)}
    return {k: x.astype(np.float32) for k, x in w.items()}


def lay(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid one after the other into lanes: codes, their documents (-1: nothing) and where one starts (time x lane)."""
    heap = [(0, k) for k in range(lanes)]
    places = []
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        load, k = heapq.heappop(heap)
        places.append((i, load, k))
        heapq.heappush(heap, (load + len(docs[i]), k))
    t = max(load for load, _ in heap)
    x, doc, start = np.zeros((t, lanes), np.uint16), np.full((t, lanes), -1, np.int32), np.zeros((t, lanes), bool)
    for i, at, k in places:
        x[at : at + len(docs[i]), k], doc[at : at + len(docs[i]), k], start[at, k] = docs[i], i, True
    return x, doc, start


def window(w: dict, table: np.ndarray, h: np.ndarray, before: np.ndarray, start: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States over a window from the state h: each is reset where a document starts."""
    states, n = np.empty((len(before), len(h), HIDDEN), np.float32), 2 * HIDDEN
    for t in range(len(before)):
        if start[t].any():
            h = h * ~start[t][:, None]
        a, b = table[before[t]], h @ w["U"]
        g = 1 / (1 + np.exp(-(a[:, :n] + b[:, :n])))
        r, z = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(a[:, n:] + r * b[:, n:])
        if keep is not None:
            keep.append((h, r, z, c, b[:, n:]))
        h = h + z * (c - h)
        states[t] = h
    return states, h


def previous(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The unit before each position; the end unit before a document's first."""
    before = np.vstack([np.full((1, x.shape[1]), END, x.dtype), x[:-1] & (EDGE - 1)])
    before[start] = END
    return before


def lane_count(docs: list[np.ndarray], most: int) -> int:
    return max(1, min(most, sum(map(len, docs)) // max(map(len, docs))))


def by_cluster(units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of units of frequent words: each class with them, where they are and their number in the class."""
    at = np.flatnonzero((units >= FIRST) & (units < FIRST + TOP))
    own, place = np.divmod(units[at] - FIRST, SIZE)
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(CLUSTERS + 1))
    for k in range(CLUSTERS):
        if bounds[k] < bounds[k + 1]:
            part = order[bounds[k] : bounds[k + 1]]
            yield k, at[part], place[part]


def class_logits(w: dict, flat: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """Of at most CHUNK states, in the buffer."""
    out = np.matmul(flat, w["Y"], out=buffer[: len(flat)])
    out += w["c"]
    return out


def log10_probabilities(w: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Of each document's whole sequence of units."""
    if not docs:
        return np.zeros(0)
    x, doc, start = lay(docs, lane_count(docs, LANES))
    before, table, out, h = previous(x, start), w["E"] @ w["W"] + w["b"], np.zeros(len(docs) + 1), np.zeros((x.shape[1], HIDDEN), np.float32)
    buffer, ones = np.empty((CHUNK, CLASSES), np.float32), np.ones(max(CLASSES, SIZE), np.float32)
    for t in range(0, len(x), SPAN):
        at = slice(t, t + SPAN)
        used = np.flatnonzero((doc[at] >= 0).any(0))
        states, h[used] = window(w, table, h[used], before[at][:, used], start[at][:, used])
        flat, units = states.reshape(-1, HIDDEN), (x[at][:, used].ravel() & (EDGE - 1)).astype(np.int32)
        chosen, own = np.empty(len(flat)), class_of(units)
        for i in range(0, len(flat), CHUNK):
            logits = class_logits(w, flat[i : i + CHUNK], buffer)
            chosen[i : i + CHUNK] = logits[np.arange(len(logits)), own[i : i + CHUNK]]
            chosen[i : i + CHUNK] -= np.log(np.exp(logits, out=logits) @ ones[:CLASSES])
        for k, i, place in by_cluster(units):
            inside = flat[i] @ w["V"][k] + w["v"][k]
            own = inside[np.arange(len(i)), place].astype(np.float64)
            np.exp(inside, out=inside)
            chosen[i] += own - np.log(inside @ ones[:SIZE])
        out += np.bincount(doc[at][:, used].ravel() + 1, chosen, len(docs) + 1)
    return out[1:] / math.log(10)


class Trainer:
    """Truncated backpropagation with Adam; the optimiser's state goes on from one lot of documents to the next."""

    def __init__(self, w: dict):
        self.w, self.step = {k: x.copy() for k, x in w.items()}, 0
        self.m1, self.m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        self.buffer, self.ones = np.empty((CHUNK, CLASSES), np.float32), np.ones(max(CLASSES, SIZE), np.float32)
        self.into = np.empty((2, 0, 3 * HIDDEN), np.float32)

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass: windows of SPAN steps, the state carried, no gradient across windows."""
        total = sum(map(len, docs))
        x, doc, start = lay(docs, min(lane_count(docs, LANES), max(1, total // (SPAN * 64))))
        before, target, h = previous(x, start), targets_of(x), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(0, len(x), SPAN):
            at = slice(t, t + SPAN)
            grad, h = self.gradient(h, before[at], target[at], doc[at] >= 0, start[at])
            self.update(grad)

    def update(self, grad: dict) -> None:
        self.step += 1
        rate = RATE / (1 + self.step / 300)
        for k, g in grad.items():
            m1, m2 = self.m1[k], self.m2[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            self.w[k] -= np.float32(rate / (1 - 0.9**self.step)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**self.step)) + np.float32(1e-6))

    def gradient(self, h: np.ndarray, before: np.ndarray, target: np.ndarray, real: np.ndarray, start: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean cross-entropy of a window's real positions, and the state after it."""
        w, kept, each = self.w, [], np.float32(1 / max(real.sum(), 1))
        states, after = window(w, w["E"] @ w["W"] + w["b"], h, before, start, kept)
        flat, units, share = states.reshape(-1, HIDDEN), np.where(real, target, -1).ravel(), real.ravel() * each
        grad = {k: np.zeros_like(w[k]) for k in "YcVv"}
        dflat, own = np.empty_like(flat), class_of(np.maximum(units, 0))
        for i in range(0, len(flat), CHUNK):
            part = slice(i, i + CHUNK)
            p = class_logits(w, flat[part], self.buffer)
            np.exp(p, out=p)
            p *= (share[part] / (p @ self.ones[:CLASSES]))[:, None]
            p[np.arange(len(p)), own[part]] -= share[part]
            grad["Y"] += flat[part].T @ p
            grad["c"] += p.sum(0)
            np.matmul(p, w["Y"].T, out=dflat[part])
        for k, i, place in by_cluster(units):
            q = flat[i] @ w["V"][k] + w["v"][k]
            np.exp(q, out=q)
            q *= (each / (q @ self.ones[:SIZE]))[:, None]
            q[np.arange(len(i)), place] -= each
            grad["V"][k], grad["v"][k] = flat[i].T @ q, q.sum(0)
            dflat[i] += q @ w["V"][k].T
        dstates, n = dflat.reshape(states.shape), 2 * HIDDEN
        if self.into.shape != (2, before.size, 3 * HIDDEN):
            self.into = np.empty((2, before.size, 3 * HIDDEN), np.float32)
        into, du, dh = self.into[0].reshape(*before.shape, -1), np.zeros_like(w["U"]), np.zeros_like(h)
        db = np.empty((len(h), 3 * HIDDEN), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            hp, r, z, c, bc = kept[t]
            dh += dstates[t]
            dz = dh * z
            dc = dz * (1 - c * c)
            db[:, :HIDDEN], db[:, HIDDEN:n], db[:, n:] = dc * bc * r * (1 - r), dz * (c - hp) * (1 - z), dc * r
            into[t] = db
            into[t, :, n:] = dc
            du += hp.T @ db
            dh -= dz
            dh += db @ w["U"].T
            if start[t].any():
                dh *= ~start[t][:, None]
        order = np.argsort(before.ravel(), kind="stable")
        read = before.ravel()[order]
        first = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
        dtable = np.zeros((UNITS, 3 * HIDDEN), np.float32)
        dtable[read[first]] = np.add.reduceat(np.take(self.into[0], order, axis=0, out=self.into[1], mode="clip"), first, axis=0)
        return grad | {"U": du, "b": dtable.sum(0), "W": w["E"].T @ dtable, "E": dtable @ w["W"].T}, after


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def _unflat(raw: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = raw[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def fit(codes: DataFrame, targets: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Rounds of local training and averaging; a round takes the documents of its share. Copies meet in 32 groups first."""
    w, context = initial(targets), codes.sparkSession.sparkContext
    own = codes.where("NOT held_out").select("codes")
    for k in range(rounds):
        shared = context.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            trainer, tokens, docs, held = Trainer(shared.value), 0, [], 0
            for batch in batches:
                for raw in batch.column("codes").to_pylist():
                    if zlib.crc32(raw) % rounds == k:
                        docs.append(np.frombuffer(raw, "<u2"))
                        held += len(docs[-1])
                        if held >= TOKENS:
                            trainer.learn(docs)
                            docs, tokens, held = [], tokens + held, 0
            if docs:
                trainer.learn(docs)
            if tokens + held:
                own = [pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([tokens + held], pa.int64()), pa.array([_flat(trainer.w).astype(np.float32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["g", "tokens", "w"])

        def mean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens, g = 0.0, 0, 0
            for batch in rows:
                for g, n, raw in zip(*(batch.column(c).to_pylist() for c in ("g", "tokens", "w"))):
                    total, tokens = total + n * np.frombuffer(raw, np.float32).astype(np.float64), tokens + n
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["g", "tokens", "w"])

        schema = "g int, tokens long, w binary"
        found = own.mapInArrow(run, schema).repartition(32, "g").mapInArrow(mean, schema).collect()
        if found:
            w = _unflat(sum(r.tokens * np.frombuffer(r.w, np.float32).astype(np.float64) for r in sorted(found)) / sum(r.tokens for r in found), w)
    return w


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text's probability)."""
    rows = materialise(blocks(docs, held_out), "blocks")
    training = rows.where("ids IS NOT NULL AND NOT held_out").count()
    entries = materialise(counted(rows), "counts")
    counts, top = totals(entries, training)
    codes = materialise(coded(rows, entries, counts, top), "codes")
    shared = docs.sparkSession.sparkContext.broadcast(fit(codes, counts.targets))
    own = codes.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), "base_score", "in_unit", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = log10_probabilities(w, [np.frombuffer(x, "<u2") for x in batch.column("codes").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(found + batch.column("in_unit").to_numpy())], [*batch.schema.names[:6], "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
