import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meetlens.llm import gru_lm as G
from meetlens.llm.common import ascii_words, id_remainder


def held(df):
    return G.score(df, id_remainder(F.col("doc_id"), 7) == 2)


def brute(docs, rows):
    """Counts, base scores and token numbers, one document at a time."""
    folds = {r.doc_id: r.held_out for r in rows}
    c, n = Counter(), 0
    for d in docs:
        if not folds[d.doc_id]:
            words = [*ascii_words(d.text), "end"]
            c.update(words)
            n += len(words)
    out = []
    for d in docs:
        words = [*ascii_words(d.text), "end"]
        out.append((d.doc_id, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in words), 6)))
    return sorted(out, key=str)


def test_counts_and_base(spark, awkward, sf):
    for docs in (awkward, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = held(docs).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str) == brute(docs.collect(), rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_better_than_base_on_held_out(spark, sf):
    """And than the untrained network, which is a unigram model of classes and of words in them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in held(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_the_way_rows_are_dealt_matters_little(spark, sf):
    """Counts and base scores are equal; scores are those of another average of copies, 2 % apart in all at most."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = ({r.doc_id: r for r in held(docs.repartition(n, "doc_id")).collect()} for n in (2, 5))
    assert all((r.n_known, r.train_tokens) == (other[i].n_known, other[i].train_tokens) and math.isclose(r.base_score, other[i].base_score) for i, r in one.items())
    assert math.isclose(sum(r.score for r in one.values()), sum(r.score for r in other.values()), rel_tol=0.02)


def test_empty(empty):
    assert held(empty).collect() == []


def test_no_training_documents(spark, awkward):
    rows = G.score(awkward, F.lit(True)).collect()
    assert len(rows) == awkward.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)


def one(w, d):
    """A text's score by one word at a time, with the whole distribution over units written out."""
    h, before, total, n = np.zeros(G.HIDDEN), G.END, 0.0, G.HIDDEN
    softmax = lambda y: np.exp(y - y.max()) / np.exp(y - y.max()).sum()
    for u in d:
        a, b = w["E"][before] @ w["W"] + w["b"], h @ w["U"]
        r, z = (1 / (1 + np.exp(-(a[k : k + n] + b[k : k + n]))) for k in (0, n))
        h = h + z * (np.tanh(a[2 * n :] + r * b[2 * n :]) - h)
        classes = softmax(h @ w["Y"] + w["c"])
        every = np.zeros(G.UNITS)
        every[: G.FIRST], every[G.FIRST + G.TOP :] = classes[: G.FIRST], classes[G.FIRST + G.CLUSTERS :]
        for k in range(G.CLUSTERS):
            every[G.FIRST + k * G.SIZE : G.FIRST + (k + 1) * G.SIZE] = classes[G.FIRST + k] * softmax(h @ w["V"][k] + w["v"][k])
        assert math.isclose(every.sum(), 1, rel_tol=1e-4)
        total, before = total + np.log(every[u]), u
    return total / math.log(10)


def test_lanes_and_windows_change_nothing():
    rng = np.random.default_rng(0)
    w = G.initial(rng.random(G.UNITS) * 10)
    w["V"] *= 20  # so that the state decides between the words of a class
    docs = [rng.integers(0, G.UNITS, n).astype(np.uint16) for n in (1, 300, 9, 70, 33)]
    assert np.allclose(G.log10_probabilities(w, docs), [one(w, d) for d in docs], rtol=1e-4)


def test_gradient_by_differences():
    """Every kind of weight, through time and over a document's start."""
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in G.initial(rng.random(G.UNITS) * 10).items()}
    units = np.array([2, 3, 70, 1, 0, 900, G.FIRST + G.TOP + 5, G.UNITS - 1, 66])
    x = rng.choice(units, (6, 3)).astype(np.uint16)
    start = np.zeros((6, 3), bool)
    start[0], start[3, 1] = True, True
    real = np.ones((6, 3), bool)
    real[5, 2] = False
    before, target = G.previous(x, start), G.targets_of(x)

    def loss(w):
        states, _ = G.window(w, w["E"] @ w["W"] + w["b"], np.zeros((3, G.HIDDEN)), before, start)
        y = states.reshape(-1, G.HIDDEN) @ w["Y"] + w["c"]
        u, total = target.ravel(), 0.0
        for i in np.flatnonzero(real.ravel()):
            total += np.log(np.exp(y[i]).sum()) - y[i, G.class_of(u[i])]
            if G.FIRST <= u[i] < G.FIRST + G.TOP:
                k, place = divmod(int(u[i]) - G.FIRST, G.SIZE)
                q = states.reshape(-1, G.HIDDEN)[i] @ w["V"][k] + w["v"][k]
                total += np.log(np.exp(q).sum()) - q[place]
        return total / real.sum()

    trainer = G.Trainer({k: v.astype(np.float32) for k, v in w.items()})
    grad, _ = trainer.gradient(np.zeros((3, G.HIDDEN), np.float32), before, target, real, start)
    for k, g in grad.items():
        at = np.unravel_index(np.argsort(-np.abs(g), axis=None)[[0, 1, 5]], g.shape)
        for i in zip(*at):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][i] += 1e-4
            down[k][i] -= 1e-4
            assert math.isclose((loss(up) - loss(down)) / 2e-4, g[i], rel_tol=0.02, abs_tol=2e-5), (k, i)


def test_training_lowers_loss():
    """On a chain over 60 units, of which the state knows the last one."""
    rng = np.random.default_rng(0)
    units = rng.choice(G.UNITS, 60, replace=False)
    step = rng.dirichlet(np.full(60, 0.02), 60)
    docs = []
    for _ in range(400):
        c, d = 0, []
        for _ in range(150):
            c = rng.choice(60, p=step[c])
            d.append(units[c])
        docs.append(np.array(d, np.uint16))
    w = G.initial(np.bincount(np.concatenate(docs), minlength=G.UNITS).astype(float))
    trainer = G.Trainer(w)
    for k in (0, 200):
        trainer.learn(docs[k : k + 200])
    assert trainer.step > 100 and G.log10_probabilities(trainer.w, docs).sum() > 0.8 * G.log10_probabilities(w, docs).sum()


def test_units_targets_and_classes():
    counts = np.arange(0, 600)
    for g in range(G.GROUPS):
        found = G.rare_unit(counts, np.full(600, g))
        assert found[0] == G.UNKNOWN and found.max() < G.UNITS and found.min() >= G.UNKNOWN
        codes = (found | np.where(np.isin(counts, G.BANDS), G.EDGE, 0)).astype(np.uint16)
        assert (G.targets_of(codes)[1:] == found[:-1]).all()
    classes = G.class_of(np.arange(G.UNITS))
    assert set(classes) == set(range(G.CLASSES)) and (np.bincount(classes)[G.FIRST : G.FIRST + G.CLUSTERS] == G.SIZE).all()
