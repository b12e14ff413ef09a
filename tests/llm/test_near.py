from itertools import combinations

import corpus_pipeline as P
import numpy as np

from meetlens.llm import near
from meetlens.llm.common import ascii_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = ascii_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows(spark, own):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in own], COLUMNS)


def test_near_copies_go_and_others_stay(spark):
    """One word of a hundred changed: similarity 0.90 and 5 to 10 bits of a fingerprint apart; half the text changed: no copy."""
    rng = np.random.default_rng(1)
    own = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        near_copy = list(words)
        near_copy[50] = "changed"
        far = words[:50] + [f"v{x}" for x in rng.integers(0, 5000, 50)]
        own += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near_copy)), (3 * k + 2, " ".join(far))]
    kept = {r.doc_id for r in P.distinct(spark, rows(spark, own), "").collect()}
    assert kept == {i for i, _ in own if i % 3 != 1}


def first_of_groups(own):
    """By brute force: components of the pairs that are similar, and the smallest id of each."""
    root = {i: i for i, _ in own}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations([(i, shingles(t)) for i, t in own], 2):
        if len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {top(i) for i in root}


def test_no_near_copy_stays_and_none_goes_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in P.distinct(spark, docs, sf).collect()} == first_of_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_beyond_the_leaders(spark, monkeypatch):
    """A group far larger than the leaders of a value, whole and cut in blocks, beside texts of its own kind that are no copies."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    own = [(k, " ".join([*base[:99], f"end{k}"])) for k in range(60)]
    own += [(60 + k, " ".join(f"v{x}" for x in rng.integers(0, 5000, 100))) for k in range(60)]
    docs = rows(spark, own)
    texts = near.named(docs)
    for block in (4096, 10):
        monkeypatch.setattr(near, "LEADERS", 3)
        monkeypatch.setattr(near, "MEET", 3)
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "ROWS", 16)
        found = near.components(near.links(texts, docs)).collect()
        assert len({r.root for r in found}) == 1 and len(found) == 60


def test_recall_by_similarity(spark):
    """Pairs alone, without a group to help them: nine in ten at similarity 0.8 to 0.85, nearly all above 0.9."""
    rng = np.random.default_rng(7)
    own, alike = [], {}
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 9000, 200)]
        copy = list(words)
        for i in rng.choice(np.arange(0, 200, 6), rng.integers(1, 6), replace=False):
            copy[i] = f"changed{k}"
        own += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(own[-2][1]), shingles(own[-1][1])
        alike[2 * k + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in P.distinct(spark, rows(spark, own), "").collect()}
    assert all(i in kept for i in range(0, 800, 2))
    caught = lambda least, most: np.mean([i not in kept for i, s in alike.items() if least <= s < most])
    assert caught(0.8, 0.85) >= 0.9 and caught(0.9, 1) >= 0.99 and not any(i not in kept for i, s in alike.items() if s < 0.8)


def test_survivor_by_group_not_by_id(spark):
    """Null and repeated ids: rows of other texts stay, copies go, and a copy with an id is kept before one without."""
    own = [(None, "one text without an id"), (None, "another text without an id"), (None, "One text  without an id"), (5, "a text of id five here"), (5, "quite other words under that id"), (None, "a text of id five here"), (7, "another text without an id")]
    kept = sorted(((r.doc_id, r.text) for r in P.distinct(spark, rows(spark, own), "").collect()), key=str)
    assert [(i, t.lower().split()) for i, t in kept] == [(i, t.lower().split()) for i, t in sorted([own[0], own[3], own[4], own[6]], key=str)]


def test_repeated_rows_are_one(spark):
    """Rows of one id and text, beside another text under that id and null ids and texts: one row of each group."""
    text = "the very same words under one id and many times over"
    own = [(3, text)] * 50 + [(3, "other words of that id which nobody repeats at all")] + [(None, None)] * 20 + [(None, "")] * 5
    kept = sorted(((r.doc_id, r.text or "") for r in P.distinct(spark, rows(spark, own), "").collect()), key=str)
    assert kept == sorted([(3, text), (3, own[50][1]), (None, "")], key=str)


def test_no_link_of_a_crowded_value_is_lost(spark, monkeypatch):
    """Texts that change two words at a time, each with copies that are similar to it alone: every link counts, and values and
    groups hold more texts than pass at once; whole, and with groups and values cut.
    """
    rng = np.random.default_rng(11)
    words, own, fresh, free = [f"w{x}" for x in rng.integers(0, 9000, 300)], [], iter(range(10**6)), [*rng.permutation(np.arange(0, 300, 6))]

    def changed(base, places):
        return [f"new{next(fresh)}" if i in set(places) else w for i, w in enumerate(base)]

    for _ in range(10):
        own.append(words)
        own += [changed(words, rng.choice(np.arange(3, 300, 6), 5, replace=False)) for _ in range(7)]
        words = changed(words, [free.pop() for _ in range(3)])
    own = [(i, " ".join(w)) for i, w in enumerate(own)]
    docs = rows(spark, own)
    want = first_of_groups(own)
    assert want == {0}
    for sizes in ({}, {"BLOCK": 16, "MEET": 2}, {"BLOCK": 16, "MEET": 2, "MOST": 12, "ROWS": 8}):
        for name, n in sizes.items():
            monkeypatch.setattr(near, name, n, raising=False)
        assert {r.doc_id for r in P.distinct(spark, docs, "").collect()} == want
