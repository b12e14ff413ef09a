import math

import numpy as np
from pyspark.sql import functions as F

from meetlens.llm import ann, chat, chroma


def brute(rows, top, query):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    out = {}
    for k, i in enumerate(ids):
        if query(i):
            s = (x[k] * x).sum(1)
            s[k] = -math.inf
            first = np.lexsort((ids, -s))[: min(top, len(ids) - 1)]
            out[i] = [(ids[j], s[j]) for j in first]
    return out


def test_search_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    want = brute(rows, 20, lambda i: i % 20 == 0)
    found = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, own in found.items():
        assert len(own) == 20 and q not in {i for i, _ in own}
        assert all(np.isclose(s, (rows[q] * rows[i]).sum(), rtol=0, atol=1e-15) for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_search_defined_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (0, v), (1, v), (2, [3.0, 2.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [math.inf, 1.0, 1.0]), (7, [math.nan, 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (None, v), (20, v)]
    df = spark.createDataFrame([(i, x, 1.0, 2) for i, x in rows], "vec_id long, embedding array<double>, score double, rank int")
    found = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 1, 14.0), (0, 2, 20, 14.0), (0, 3, 2, 10.0), (20, 1, 0, 14.0), (20, 2, 1, 14.0), (20, 3, 2, 10.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_many_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 100 else [float(i), 1.0]) for i in range(130)], "vec_id long, embedding array<float>")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, share=10).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == brute(rows, 20, lambda i: i % 20 == 0)


def recall(spark, x, query, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.search(df, F.col("vec_id") % query == 0, **settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(dict(enumerate(x)), 20, lambda i: i % query == 0)
    assert found.keys() == want.keys()
    return np.mean([len(found[q] & {i for i, _ in want[q]}) / 20 for q in want])


def test_recall_on_many_rows(spark):
    """Over 10,000 rows: random directions with the query's own share, and clusters with an eighth of it."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12_000, 64))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True), 200) >= 0.9
    centres = rng.normal(size=(300, 64))
    assert recall(spark, centres[rng.integers(0, 300, 12_000)] + rng.normal(0, 0.15, (12_000, 64)), 200, share=0.2) >= 0.9


def test_ties_beyond_any_margin(spark):
    """Thousands of different vectors with one score: the smallest ids come first, whatever leaf they are in."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(i % 3 != 1), *rng.integers(1, 1000, 3).tolist()]) for i in range(1, 9000)]
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), *((i, [float(x) for x in v]) for i, v in rows)], "vec_id long, embedding array<double>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0, share=10).collect())
    assert found == [(k, i, 1.0) for k, i in enumerate([i for i, v in rows if v[0]][:20], 1)]


def test_depth_is_bounded():
    """A million nodes would be broadcast at 10^9 rows without the bound."""
    sample = np.random.default_rng(0).normal(size=(500, 64))
    forest = ann.grow(sample, 10.0, ann.TREES, ann.DEPTHS[1])
    assert forest.normals.nbytes + forest.offsets.nbytes < 32 << 20
    own = forest.leaves(sample)
    assert own.shape == (500, ann.TREES) and (own // 2 ** ann.DEPTHS[1] == np.arange(ann.TREES)).all()


# Chroma


def test_alignment(spark):
    rng = np.random.default_rng(0)
    tunes = [rng.normal(0, 0.15, 64).tolist() for _ in range(12)]
    tunes += [tunes[0], tunes[1][10:] + tunes[2][:10], (np.array(tunes[3]) + rng.normal(0, 0.003, 64)).tolist(), None, [], [0.1] * 3, [math.nan] * 64]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(tunes)] + [(None, tunes[4], 1), (5, tunes[5], 1)], "id long, v array<double>, n int")
    prints = chroma.fingerprints(df, chroma.melody, 4000, "v")
    rows = chroma.align(prints, F.coalesce(F.col("id") < 12, F.lit(False))).collect()
    at = {r.id: r for r in rows}
    assert len(rows) == len(tunes) + 2
    assert at[12].class_id == 0 and at[13].best_id == 1 and abs(abs(at[13].best_offset) - 10 * 500 / 256) < 3 and at[14].best_id == 3 and at[14].best_offset == 0
    assert {at[i].frames for i in (15, 16, 17)} == {0} and at[None].class_id == 4
    own = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect()}
    links = {a: sum(1 for b in range(12) if b != at[a].class_id and _linked(own[a], own[b])) for a in range(15)}
    assert {a: at[a].n_links for a in links} == links
    assert chroma.align(prints.limit(0), F.lit(True)).collect() == []


def _linked(a, b):
    """Every offset, by brute force."""
    votes = {}
    for i, x in enumerate(a):
        for j in np.flatnonzero(b == x):
            votes[i - int(j)] = votes.get(i - int(j), 0) + 1
    found = [chroma.bit_error(a, b, o) for o, n in votes.items() if n >= chroma.VOTES]
    return any(overlap >= chroma.OVERLAP and error <= chroma.ERROR for overlap, error in found)


def test_near_copies_and_a_very_long_recording(spark, monkeypatch):
    """A group of near copies, several blocks of queries, and a recording of 40 tunes: the links of all pairs at all offsets."""
    monkeypatch.setattr(chroma, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.15, 64)
    tunes = [base + rng.normal(0, 0.02, 64) for _ in range(30)] + [rng.normal(0, 0.15, 64) for _ in range(20)]
    tunes.append(np.concatenate([*tunes[30:], *tunes[30:], tunes[0]]))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(tunes)], "id long, v array<double>")
    prints = chroma.fingerprints(df, chroma.melody, 4000, "v")
    own = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect()}
    found = {r.id: r for r in chroma.align(prints, F.col("id") % 5 == 0).collect()}
    want = {a: [b for b in own if b % 5 == 0 and b != a and _linked(own[a], own[b])] for a in own}
    assert {a: r.n_links for a, r in found.items()} == {a: len(x) for a, x in want.items()}
    assert all(found[a].best_id in want[a] for a in own if want[a]) and max(map(len, want.values())) >= 5 and len(want[50]) >= 4


# Quotations

LONG = "this is the first line of all\nand a second one here"


def rows_of(spark, rows):
    return {(r.conv_id, r.turn): r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, h long")).collect()}


def test_levels_and_links(spark):
    quote = lambda s, n: "\n".join(">" * n + " " + x for x in s.split("\n"))
    own = ["my own answer to that", "a third message entirely", "and the fourth one"]
    rows = [
        (1, 0, "user", LONG),
        (1, 1, "assistant", own[0] + "\n\n" + quote(LONG, 1)),
        (1, 2, "user", own[1] + "\n" + quote(own[0], 1) + "\n" + quote(LONG, 2)),
        (1, 3, "user", "> > " + own[0] + "\n>" + own[1].upper() + "\n" + own[2]),
        (2, 5, "user", quote(LONG, 1) + "\nfrom elsewhere"),
        (3, 0, "user", None),
        (3, 1, "user", ""),
        (None, 1, "user", LONG),
        (4, None, "user", quote(LONG, 1)),
    ]
    found = rows_of(spark, [(*r, 9, 9) for r in rows])
    assert len(found) == len(rows)
    assert [(found[1, t].to_conv, found[1, t].to_turn, found[1, t].depth, found[1, t].root_turn) for t in range(4)] == [(None, None, 0, 0), (1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0)]
    assert found[1, 1].own_text == own[0] and found[1, 3].own_text == own[2] and found[1, 2].levels == 2
    assert (found[2, 5].to_conv, found[2, 5].to_turn, found[2, 5].depth) == (1, 0, 1)
    assert found[3, 0].own_text is None and found[3, 1].own_text == "" and found[4, None].to_conv is None
    levels = {(r.turn, r.level): r.to_turn for r in chat.link(spark.createDataFrame([r for r in rows if r[0] == 1], "conv_id long, turn long, role string, text string")).collect()}
    assert levels == {(1, 1): 0, (2, 1): 1, (2, 2): 0, (3, 1): 2, (3, 2): 1}


def test_repeated_rows_and_empty(spark):
    rows = [(1, 0, "u", LONG, 0, 0), (1, 0, "u", LONG, 0, 0), (1, 1, "u", "> and a second one here", 0, 0), (1, 1, "u", "> and a second one here", 0, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, h long")
    found = chat.conversations(df).collect()
    assert len(found) == 4 and {(r.turn, r.to_turn) for r in found} == {(0, None), (1, 0)}
    assert chat.conversations(df.limit(0)).collect() == []
