import hashlib
import random

import numpy as np
import pytest

from meetlens.llm import substring as S


def brute(rows, window):
    """doc_id, n_words, n_removed, kept by all windows of all documents."""
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    first = {}
    for doc, words in split:
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, words in split:
        gone = set()
        if doc is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **settings):
    rows = S.dedupe(df, **settings).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def passages(rng, docs):
    """Documents of a small vocabulary that copy passages of one another at any offset, with copies, near copies and hot passages."""
    vocabulary = [f"w{i}" for i in range(400)]
    hot = rng.choices(vocabulary, k=30)
    texts = []
    for _ in range(docs):
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 12, 13, 14, 80, 200]))
        for _ in range(rng.choice([0, 1, 3])):
            source = rng.choice(texts).split() if texts else []
            a = rng.randrange(len(source) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = source[a : a + rng.randrange(5, 40)]
        if rng.random() < 0.3:
            words[0:0] = hot
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
        if rng.random() < 0.15:
            texts.append(rng.choice(texts))
    return texts


@pytest.mark.parametrize("window,period,chunk", [(13, 7, S.CHUNK), (13, 7, 900), (13, 3, 900), (8, 7, 900), (5, 1, 900)])
def test_by_brute_force(spark, monkeypatch, window, period, chunk):
    rng = random.Random(window * period)
    texts = passages(rng, 150)
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    rows += rows[:5] + [(rows[7][0], rows[9][1]), (None, rows[3][1]), (None, None)]
    monkeypatch.setattr(S, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, window=window, period=period, buckets=4) == brute(rows, window)


def test_awkward(spark, awkward, empty):
    own = awkward.withColumnsRenamed({"label": "raw", "block": "chunk", "score": "sha"})
    assert found(own) == brute([(r.doc_id, r.text) for r in awkward.collect()], S.WINDOW)
    assert found(empty) == []
    with pytest.raises(ValueError):
        S.dedupe(awkward, 5, 7)


def test_covers():
    for period, cover in S.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_words_hashed_by_pieces(monkeypatch):
    """Every word has one hash, in short, long and joined texts, and words longer than a piece."""
    rng = random.Random(2)
    texts = [b"", b"  ", b"a", b"x" * 10_000, b"  " + b"y" * 9000 + b" z a", b"x" * 4096 + b" b", b" " * 9000]
    texts += ["".join(rng.choices("abcde \n\t", k=n)).encode() for n in (100, 4096, 20_000)]
    monkeypatch.setattr(S, "PIECE", 1 << 12)
    monkeypatch.setattr(S, "_TABLES", [])
    hashes, counts = S.hash_words(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    named = dict(zip(words, hashes.tolist()))
    assert [named[w] for w in words] == hashes.tolist() and len(set(named.values())) == len(named)
    for t in texts:
        assert b"".join(S.pieces(t)) == t and S._kept(t, None) == (hashlib.sha256(b" ".join(t.split())).hexdigest(), len(t.split()))
    for k in (1, 6, 7, 13):
        rolled = S.rolled(hashes, k, S._WORD)
        for i in range(0, len(rolled), 499):
            assert int(rolled[i]) == sum(int(hashes[i + j]) * pow(S._WORD, j, 1 << 64) for j in range(k)) % (1 << 64)


def test_rolled_lengths():
    h = np.arange(20, dtype=np.uint64)
    assert len(S.rolled(h, 13, S._WORD)) == 8 and len(S.rolled(h[:5], 13, S._WORD)) == 0
