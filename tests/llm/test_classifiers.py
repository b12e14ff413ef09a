import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlens.llm import ftrl, langid, quality, toxicity
from meetlens.llm.common import id_remainder


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_cases(awkward, empty, labels, module):
    model = module.fit(awkward, labels, F.lit(True))
    rows = module.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert module.score(empty, model).collect() == []
    none = module.fit(awkward, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score(awkward, none).collect()} == {0.5}
    kept = module.score(awkward, model, keep=["doc_id", "label", "lang"])
    assert kept.columns == ["doc_id", "label", "lang", "score"]


@pytest.mark.parametrize("module, label, fold, least", [(quality, "quality", (3, 1), 0.9), (toxicity, "toxic", (5, 0), 0.75)])
def test_held_out_accuracy(spark, module, label, fold, least):
    sf = "/root/testdata/sf0.1"
    docs, labelled = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = id_remainder(F.col("doc_id"), fold[0]) == fold[1]
    model = module.fit(docs, labelled, ~out, 3000)
    own = labelled.where(out).select("doc_id", label)
    rows = module.score(docs.join(own, "doc_id", "left_semi"), model).join(own, "doc_id").collect()
    right = np.array([(r.score >= 0.5) == r[label] for r in rows])
    for value in (0, 1):
        assert right[[r[label] == value for r in rows]].mean() > least


def test_sparse_dot_product():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 1 << 20, 50).astype(np.uint32)), i % 2) for i in range(60)]
    rows = [(np.append(x, np.uint32(5 + y)), y) for x, y in rows]
    model = ftrl.train(rows, ftrl.Settings(alpha=0.5, l1=1.0))
    assert len(model.index) < 200 and model.dense()[6] > 0 > model.dense()[5]
    assert all((ftrl.sigmoid(model.bias + model.dense()[x].sum()) > 0.5) == y for x, y in rows)


def test_grams_tell_order_and_span():
    a, b = ftrl.token_hashes([b"x", b"y", b"z"]), ftrl.token_hashes([b"z", b"y", b"x"])
    assert set(ftrl.grams(a, ((0,),), 20)) == set(ftrl.grams(b, ((0,),), 20))
    assert not set(ftrl.grams(a, ((0, 1), (0, 2)), 20)) & set(ftrl.grams(b, ((0, 1), (0, 2)), 20))


# Language


def test_language_cases(awkward, empty):
    model = langid.fit(awkward, F.lit(True))
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.label(awkward, model).collect()}
    assert {x[1] for x in rows if x[0] in (3, 4, 5, 8)} == {langid.UND} and {x[2] for x in rows if x[0] in (3, 4, 5, 8)} == {0.0}
    assert {x[1] for x in rows} <= {"en", "fr", langid.UND} and all(0 <= x[2] <= 1 for x in rows)
    assert langid.label(empty, model).collect() == []
    nobody = langid.fit(awkward, F.lit(False))
    assert {r.lang_pred for r in langid.label(awkward, nobody).collect()} == {langid.UND}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = id_remainder(F.col("doc_id"), 3) == 1
    rows = langid.label(docs.where(out), langid.fit(docs, ~out)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_rare_languages_are_learned(spark):
    """A language of one document in a thousand is a learned value."""
    rows = [(i, f"the house and the garden {i}", "en") for i in range(1000)] + [(2000, "casa y jardin con la puerta " * 30, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True), rows=50).languages == ["en", "es"]


def test_reader_equals_the_trained_network():
    """Whole texts, across words and runs, at every position; one label more stands for none of the languages."""
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], langid.initial(3, rng))
    text = "abc déf abc " + "z" * 160 + " 123 abc" + " " * 60 + "end"
    raw, total = text.encode(), np.zeros(3)
    for i in range(0, len(raw), langid.RUN):
        part = raw[i : i + langid.RUN].ljust(langid.RUN, b"\0")
        x = np.frombuffer(part, np.uint8)[:, None]
        (hf, _), (hb, _) = (langid.steps(model.weights, d, x) for d in "fb")
        e = np.exp(np.concatenate([hf, hb], 2)[:, 0] @ model.weights["Y"] + model.weights["c"])
        total += ((e / e.sum(1, keepdims=True)) * langid.LETTER[x]).sum(0)
    found = langid.Reader(model)([text, None, "", "123"])
    assert np.isclose(found[0][1], total[:2].max() / total[:2].sum(), atol=1e-5) and np.isclose(found[0][2], total[2] / total.sum(), atol=1e-5)
    assert [x[0] for x in found[1:]] == ["und"] * 3


def test_backpropagation_equals_finite_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in langid.initial(3, rng).items()}
    x = np.ascontiguousarray(np.frombuffer(b"abc dxyzzy q1 2b", np.uint8).reshape(4, 4).T)
    y = np.array([0, 2, 1, 0])

    def loss(w):
        h = np.concatenate([langid.steps(w, d, x)[0] for d in "fb"], 2) @ w["Y"] + w["c"]
        p = np.exp(h) / np.exp(h).sum(2, keepdims=True)
        weight = langid.LETTER[x]
        return -(np.log(p[:, np.arange(4), y]) * weight).sum() / weight.sum()

    grad = langid.gradient({k: v.astype(np.float32) for k, v in w.items()}, x, y)
    assert grad.keys() == w.keys()
    for k in w:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        assert np.isclose(grad[k][i], (loss(up) - loss(down)) / 2e-3, rtol=2e-2)
