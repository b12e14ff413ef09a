"""Merkle manifest of a dataset by an associative monoid of sparse forests.

A row's digest is a leaf. The leaves of a source, ascending by id, make a tree in which every ARITY siblings (the last run may have
fewer) become the digest of their joined hex texts; the sources' roots, in the sources' order, make one more tree above. Rows get exact
places in the order (source, id) by ranges, and equal blocks of places are the partitions of what follows.

A fragment holds unresolved nodes by (tree, level, index), and how many leaves each of their trees has, so that the arity of every run
is known. Merging two fragments joins their nodes and replaces each run that is now complete by its parent, over and over: the order
of merges does not matter. Each block resolves all runs inside it and keeps O(ARITY * levels) nodes at its two ends; treeReduce merges
these fragments to the root and records the runs that it completed, those across borders of blocks. There are at most BLOCKS
blocks, so this record has at most BLOCKS * levels runs of ARITY digests (under 64 MB) and is broadcast. With it, each block
goes over its leaves once more, makes their proofs, and folds the leaves as they are now back to a root.

Defined cases: each field of a leaf may be null, also id and source (a null id comes before the others of its source, a null source
before the other sources); equal ids are ordered by their leaves; repeated rows are leaves of their own; empty and very long
texts are hashed whole; an empty table gives no rows and has no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlens.llm.common import hold, materialise, slices
from meetlens.operators.order import numbered

ARITY, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")
#: Most blocks, which bounds what the driver merges and broadcasts; and the fewest rows of one, below which more blocks do not pay.
BLOCKS, LEAST_ROWS = 1 << 14, 1 << 10
#: The tree of the sources' roots; a source's own tree has the source's place among the sources.
TOP = -1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def digest(joined: bytes) -> bytes:
    """The hex text of a SHA-256."""
    return hashlib.sha256(joined).hexdigest().encode()


def _joined(values: list[bytes | None]) -> bytes:
    return b"".join(b"-" if v is None else b"%d:%b" % (len(v), v) for v in values)


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, source, leaf binary, now binary (the leaf of the row as it is now, where changed lower-cased its text's A-Z; else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("merkle", lambda: None)
        for batch in slices(batches):
            made, now = [], []
            for *values, hit in zip(*(batch.column(f"f{i}").to_pylist() for i in range(len(FIELDS))), batch.column("hit").to_pylist()):
                raw = [None if v is None else v.encode() for v in values]
                made.append(hashlib.sha256(_joined(raw)).digest())
                now.append(hashlib.sha256(_joined([*raw[:-1], raw[-1].translate(_LOWER)])).digest() if hit and raw[-1] is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(made, pa.binary()), pa.array(now, pa.binary())], ["doc_id", "source", "leaf", "now"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    rows = docs.select("doc_id", "source", changed.alias("hit"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(FIELDS)))
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, leaf binary, now binary")


@lru_cache(1 << 14)
def sizes(n: int) -> list[int]:
    """Nodes of a tree of n leaves by level, up to its root."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


def climb(n: int, start: int, nodes: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """By level, (first index, digests) of what the neighbouring leaves start, start + 1, ... of a tree of n leaves determine."""
    levels = [(start, nodes)]
    for size in sizes(n)[:-1]:
        start, nodes = levels[-1]
        end = start + len(nodes)
        first, last = -(-start // ARITY), -(-size // ARITY) if end == size else end // ARITY
        levels.append((first, [digest(b"".join(nodes[max(0, r * ARITY - start) : (r + 1) * ARITY - start])) for r in range(first, last)]))
    return levels


def open_nodes(n: int, levels: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of those nodes that no determined parent covers; a determined root is one of them."""
    for level, (start, nodes) in enumerate(levels):
        above, parents = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i, node in enumerate(nodes, start):
            if not above <= i // ARITY < above + len(parents):
                yield level, i, node


class Fragment:
    """An element of the monoid: unresolved nodes, the leaves of their trees, and the runs that merges have completed."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, int, int], bytes] = {}
        self.leaves: dict[int, int] = {}
        self.runs: dict[tuple[int, int, int], bytes] = {}

    def add(self, tree: int, level: int, index: int, node: bytes, n: int) -> None:
        self.nodes[tree, level, index], self.leaves[tree] = node, n

    def settle(self, sources: int) -> Fragment:
        """Replaces complete runs by their parents, and roots of sources by leaves of the tree above."""
        waiting = list(self.nodes)
        while waiting:
            tree, level, index = waiting.pop()
            node = self.nodes.get((tree, level, index))
            if node is None:
                continue
            size = sizes(self.leaves[tree])[level]
            if size == 1:
                if tree != TOP:
                    del self.nodes[tree, level, index], self.leaves[tree]
                    self.add(TOP, 0, tree, node, sources)
                    waiting.append((TOP, 0, tree))
                continue
            run = index // ARITY
            keys = [(tree, level, i) for i in range(run * ARITY, min((run + 1) * ARITY, size))]
            if all(k in self.nodes for k in keys):
                joined = b"".join(self.nodes.pop(k) for k in keys)
                self.runs[tree, level, run] = bytes.fromhex(joined.decode())
                self.nodes[tree, level + 1, run] = digest(joined)
                waiting.append((tree, level + 1, run))
        return self

    def merge(self, other: Fragment, sources: int) -> Fragment:
        made = Fragment()
        for x in (self, other):
            made.nodes.update(x.nodes)
            made.leaves.update(x.leaves)
            made.runs.update(x.runs)
        return made.settle(sources)


class Block:
    """What one block's rows determine: by tree, the levels of its neighbouring leaves. spans: (place among the sources, leaves of the
    source, index of the block's first row of it, its leaves in the block).
    """

    def __init__(self, sources: int, spans: list[tuple[int, int, int, list[bytes]]]) -> None:
        self.leaves, self.levels = {TOP: sources}, {}
        roots = []
        for tree, n, start, nodes in spans:
            self.leaves[tree], self.levels[tree] = n, climb(n, start, nodes)
            if self.levels[tree][-1][1]:
                roots.append((tree, self.levels[tree][-1][1][0]))
        if roots:
            self.levels[TOP] = climb(sources, roots[0][0], [root for _, root in roots])

    def fragment(self) -> Iterator[tuple[int, int, int, bytes, int]]:
        """tree, level, index, digest, leaves of the tree for each unresolved node."""
        for tree, levels in self.levels.items():
            if tree == TOP or not levels[-1][1]:
                for level, i, node in open_nodes(self.leaves[tree], levels):
                    yield tree, level, i, node, self.leaves[tree]

    def run(self, tree: int, level: int, run: int, record: dict[tuple[int, int, int], bytes]) -> list[bytes]:
        """The digests of a run of siblings: the block's own, or of the record of runs across borders."""
        size = sizes(self.leaves[tree])[level]
        first, last = run * ARITY, min((run + 1) * ARITY, size)
        if tree in self.levels:
            start, nodes = self.levels[tree][level]
            if start <= first and last <= start + len(nodes):
                return nodes[first - start : last - start]
        raw = record[tree, level, run].hex().encode()
        return [raw[i : i + 64] for i in range(0, len(raw), 64)]

    def path(self, tree: int, index: int, record: dict) -> list[tuple[list[bytes], int]]:
        """(run, place in it) at each level from a leaf of a tree to the root of all."""
        found = []
        for part, at in ((tree, index), (TOP, tree)):
            for level, _ in enumerate(sizes(self.leaves[part])[:-1]):
                found.append((self.run(part, level, at // ARITY, record), at % ARITY))
                at //= ARITY
        return found


def _blocks(rows: DataFrame, size: int) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """By block: index of its first row in its source, that source's rows and place, the last source's rows; and how many sources.

    What the driver gets is a row for each block.
    """
    spans = rows.groupBy(F.floor(F.col("position") / size).cast("int").alias("block"), "source").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    ends = spans.groupBy("block").agg(F.min_by(F.struct("source", "n"), "at").alias("first"), F.max_by(F.struct("source", "n"), "at").alias("last"), F.count("*").alias("sources"))
    found = sorted(ends.collect(), key=lambda r: r.block)
    begun: list[list] = []  # [source, rows so far] of each source that ends a block, and where a block starts in its own
    at, places, place = [], [], -1
    for r in found:
        going = bool(begun) and begun[-1][0] == r.first.source and place >= 0
        if not going:
            begun.append([r.first.source, 0])
        place += not going
        at.append((len(begun) - 1, begun[-1][1]))
        places.append(place)
        begun[-1][1] += r.first.n
        if r.sources > 1:
            begun.append([r.last.source, r.last.n])
            place += r.sources - 1
    last = [*(i if r.sources == 1 else i + 1 for (i, _), r in zip(at, found))]
    return {r.block: (before, begun[i][1], where, begun[j][1]) for r, (i, before), where, j in zip(found, at, places, last)}, place + 1


def _by_block(batches: Iterator[pa.RecordBatch], known: dict[int, tuple[int, int, int, int]], sources: int):
    """(rows, Block, [(tree, index)] of the rows) of each block; batches come by block, and by position in it."""

    def flush(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        start, first_n, place, last_n = known[rows.column("block")[0].as_py()]
        # Neighbours of one source are one span; null is a source of its own.
        codes = np.asarray(rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices)
        cuts = [0, *(np.nonzero(np.diff(codes))[0] + 1).tolist(), len(codes)]
        nodes = [x.hex().encode() for x in rows.column("leaf").to_pylist()]
        spans, at = [], []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            n = first_n if k == 0 else last_n if k == len(cuts) - 2 else b - a
            spans.append((place + k, n, start if k == 0 else 0, nodes[a:b]))
            at.extend((place + k, i) for i in range(spans[-1][2], spans[-1][2] + b - a))
        return rows, Block(sources, spans), at

    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = np.asarray(batch.column("block"))
        cuts = [0, *(np.nonzero(np.diff(blocks))[0] + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[-1].column("block")[0].as_py() != int(blocks[a]):
                    yield flush(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield flush(held)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("position") / size).cast("int")).repartition("block").sortWithinPartitions("block", "position")


def reduce_fragments(rows: DataFrame, size: int, known: dict, sources: int) -> Fragment:
    """The fragment of all rows: one node, the root, and the runs across borders of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("merkle", lambda: None)
        for rows, block, _ in _by_block(batches, known, sources):
            nodes = [dict(zip(("tree", "level", "at", "node", "leaves"), x)) for x in block.fragment()]
            kind = pa.list_(pa.struct([("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("node", pa.binary()), ("leaves", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([nodes], kind)], ["nodes"])

    def lift(row) -> Fragment:
        made = Fragment()
        for x in row.nodes:
            made.add(x.tree, x.level, x.at, bytes(x.node), x.leaves)
        return made.settle(sources)

    found = _dealt(rows, size).mapInArrow(run, "nodes array<struct<tree:long,level:int,at:long,node:binary,leaves:long>>")
    return found.rdd.map(lift).treeReduce(lambda a, b: a.merge(b, sources), depth=3)


def proofs(rows: DataFrame, size: int, known: dict, sources: int, whole: Fragment) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root string, verified boolean of every row."""
    (root,) = whole.nodes.values()
    record = rows.sparkSession.sparkContext.broadcast(whole.runs)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("merkle", lambda: None)
        for rows, block, at in _by_block(batches, known, sources):
            runs, out, seen = record.value, [], None
            for (tree, index), leaf, now in zip(at, rows.column("leaf").to_pylist(), rows.column("now").to_pylist()):
                if seen != (tree, index // ARITY):
                    seen, path = (tree, index // ARITY), block.path(tree, index, runs)
                    own = bool(sizes(block.leaves[tree])[1:])  # a lone leaf is its source's root
                    above = [(b"".join(run[:k]), b"".join(run[k + 1 :])) for run, k in (path[1:] if own else path)]
                    tail = b"".join(a + b for a, b in above)
                    run = path[0][0] if own else []
                    level = len(sizes(block.leaves[tree])) - 1
                    subroot = path[level][0][path[level][1]] if level < len(path) else root
                node = (now or leaf).hex().encode()
                k = index % ARITY
                left, right = b"".join(run[:k]), b"".join(run[k + 1 :])
                proof = digest(left + right + tail)
                if own:
                    node = digest(left + node + right)
                for a, b in above:
                    node = digest(a + node + b)
                out.append((leaf.hex(), subroot.decode(), root.decode(), proof.decode(), node.decode()))
            for i in range(0, len(out), 10_000):
                part = list(zip(*out[i : i + 10_000]))
                ids = rows.column("doc_id").slice(i, len(part[0])).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string()) for x in part), pa.array([x == root.decode() for x in part[-1]])], ["doc_id", *names, "verified"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _dealt(rows, size).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} string" for c in names) + ", verified boolean")


def manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """Every row's leaf, its source's root, the root of all, its proof's digest, and the root folded from the row as it is now.

    changed: the rows whose text has had its A-Z lower-cased since the manifest was made.
    """
    spark: SparkSession = docs.sparkSession
    made = materialise(leaves(docs, changed), "leaves")
    rows = numbered(made, ["source", "doc_id", "leaf"])
    n = made.count()
    if not n:
        kind = made.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    size = max(LEAST_ROWS, -(-n // BLOCKS))
    known, sources = _blocks(rows, size)
    return proofs(rows, size, known, sources, reduce_fragments(rows, size, known, sources))
