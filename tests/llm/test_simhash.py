import numpy as np
import xxhash

from meetlens.llm import simhash as S
from meetlens.llm.graph import components


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, fingerprint) to the smallest id reachable, by all pairs."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= S.RADIUS:
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        t = top(i)
        least[t] = min([x for x in (least.get(t), doc) if x is not None], default=None)
    return sorted(((doc, f"{fp:016x}", least[top(i)]) for i, (doc, fp) in enumerate(rows)), key=str)


def test_clusters(spark, awkward, empty, sf):
    for docs in (awkward, spark.read.parquet(f"{sf}/documents.parquet")):
        want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
        assert sorted((tuple(r) for r in S.cluster(docs).collect()), key=str) == want
    assert S.cluster(empty).collect() == []


def _near(spark, fps, heavy):
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = {r.node: r.root for r in components(S.near_links(df, heavy)).collect()}
    groups = {}
    for x in fps:
        s = int(np.uint64(x).astype(np.int64))
        groups.setdefault(found.get(s, s), set()).add(int(x))
    return sorted(map(sorted, groups.values()))


def test_both_indexes_find_every_link(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for c in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]:
        fps.add(c)
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = {}
    for _, fp, least in brute_components([(f, f) for f in fps]):
        want.setdefault(least, set()).add(int(fp, 16))
    want = sorted(map(sorted, want.values()))
    assert _near(spark, fps, S.HEAVY) == want
    assert _near(spark, fps, 3) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
