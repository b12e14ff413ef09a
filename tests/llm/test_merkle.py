import hashlib
import random
import zlib
from itertools import groupby

import pytest

from meetlens.llm import merkle as M
from meetlens.llm.common import id_remainder


def sha(text):
    return hashlib.sha256(text).hexdigest()


def tree(leaves):
    """Levels of a tree, by its definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16]).encode()) for i in range(0, len(now), 16)])
    return levels


def leaf(*values):
    return sha(b"".join(b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in values))


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of (doc_id, source, lang, n_chars, text) rows."""
    order = sorted(rows, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), leaf(*r)))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[1])]
    trees = [tree([leaf(*r) for r in g]) for g in groups]
    top, out = tree([t[-1][0] for t in trees]), []
    for s, (group, own) in enumerate(zip(groups, trees)):
        for i, r in enumerate(group):
            now = r[:-1] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in r[-1]),) if r[-1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 else r
            node, proof = leaf(*now), ""
            for levels, at in ((own, i), (top, s)):
                for level in levels[:-1]:
                    first = at // 16 * 16
                    run = level[first : first + 16]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    node = sha("".join(run[: at - first] + [node] + run[at - first + 1 :]).encode())
                    at //= 16
            out.append((r[0], leaf(*r), own[-1][0], top[-1][0], sha(proof.encode()), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(df):
    return sorted((tuple(r) for r in M.manifest(df, id_remainder(df.doc_id, 5) == 0).collect()), key=str)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def test_awkward(spark, awkward, empty, monkeypatch):
    rows = [tuple(r[c] for c in COLUMNS) for r in awkward.collect()]
    assert manifest(awkward.withColumnsRenamed({"label": "leaf", "block": "position", "score": "now"})) == brute(rows)
    assert manifest(empty) == [] and M.manifest(empty, empty.doc_id.isNull()).columns[0] == "doc_id"
    one = awkward.where("doc_id = 1")
    assert manifest(one) == brute(rows[:1])


@pytest.mark.parametrize("least", [1, 7, 64])
def test_many_sources_and_blocks(spark, monkeypatch, least):
    """Sources of one row to several levels, across the borders of small blocks."""
    rng, rows = random.Random(least), []
    for s, n in enumerate([1, 2, 15, 16, 17, 40, 1, 1, 300, 256, 1] + [1] * 30):
        source = None if s == 3 else f"S{s}é"
        rows += [(rng.choice([None, len(rows), len(rows) * 7]), source, rng.choice(["en", None]), rng.choice([None, s]), rng.choice(["Text ONE", None, "x", f"É {n}"])) for _ in range(n)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    monkeypatch.setattr(M, "LEAST_ROWS", least)
    monkeypatch.setattr(M, "BLOCKS", 1 << 20)
    assert manifest(df) == brute(rows)


def test_merges_in_any_order():
    """The monoid: the same root and the same record of runs, however fragments are merged."""
    rng = random.Random(5)
    leaves = [[sha(f"{s}/{i}".encode()) for i in range(n)] for s, n in enumerate([3, 500, 1, 70, 16])]
    want = tree([tree(x)[-1][0] for x in leaves])[-1][0].encode()
    results = set()
    for _ in range(10):
        parts = []
        for s, own in enumerate(leaves):
            cuts = sorted({0, len(own), *rng.sample(range(len(own)), min(4, len(own)))})
            for a, b in zip(cuts, cuts[1:]):
                f = M.Fragment()
                for level, i, node in M.open_nodes(len(own), M.climb(len(own), a, [x.encode() for x in own[a:b]])):
                    f.add(s, level, i, node, len(own))
                parts.append(f.settle(len(leaves)))
        while len(parts) > 1:
            rng.shuffle(parts)
            parts.append(parts.pop().merge(parts.pop(), len(leaves)))
        (root,) = parts[0].nodes.values()
        results.add(root)
    assert results == {want}
