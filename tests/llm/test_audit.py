from itertools import permutations

import pytest
from pyspark.sql import functions as F

from meetlens.llm import audit


def brute(rows, labels):
    """(part, order, step) to the counts, a document at a time."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for doc, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        bad = set()
        bad |= {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        bad |= {"E"} if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows) else set()
        docs.append((lang or "", bad, doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        mine, shares = [x for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shares[f] += len(gone)
                left = kept
        for key in [k for k in out if k[0] == part]:
            out[key].append(shares[key[1][key[2] - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_by_brute_force(spark, awkward, labels, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    own = awkward.withColumnsRenamed({"label": "part", "block": "copy", "score": "n_words"})
    assert found(audit.audit(own, labels, F.col("lang"))) == brute(rows, [tuple(r) for r in labels.collect()])
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in marks.collect()])
    assert found(audit.audit(docs, marks, F.col("lang"))) == want


def test_no_rows_no_labels(spark, awkward, empty, labels):
    assert audit.audit(empty, labels, F.col("lang")).collect() == []
    none = found(audit.audit(awkward, labels.limit(0), F.lit(None)))
    assert len(none) == 600 and all(k[0] == "" and v[4] == v[5] == 0 for k, v in none.items())


def test_long_texts_by_pieces(monkeypatch):
    text = (b"alpha \x0b beta\tgamma  " * 500)[3:]
    want = len(text.split()), len(set(text.split()))
    monkeypatch.setattr(audit, "PIECE", 64)
    assert audit._words(text) == want and audit._words(b"x" * 1000) == (1, 1)


def test_other_filters(spark, awkward, labels):
    fails = {"s": F.col("n_points") < 30, "x": F.col("special")}
    rows = audit.audit(awkward, labels, F.lit("all"), fails).collect()
    assert {(r.filter_order, r.step) for r in rows} == {("sx", 1), ("sx", 2), ("xs", 1), ("xs", 2)}
    with pytest.raises(ValueError):
        audit.audit(awkward, labels, F.lit("all"), {"too long": F.lit(True)})
