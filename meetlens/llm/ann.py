"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample (SAMPLE rows, by the hash of the id): each node splits at the median of the projections
on the line between two sample points. Every row is indexed, in one leaf per tree. Vectors of unequal length are lifted by one
coordinate, so that the largest inner product is the nearest point. A query pops leaves from one priority queue over all
trees, by the least margin on the way to a leaf, until the leaves popped hold SHARE times as many rows as there are, and
enough for TOP candidates. Each leaf meets its queries in blocks of bounded size; the leaf's best candidates, with all that
tie with the last of them, are rescored in double precision on the original vectors, and a query's lists are merged. SHARE
sets recall: vectors without any structure (random directions in 64 dimensions) need about as many leaf rows as there are
rows for a recall over 0.9; clustered vectors need few (a test holds 0.9 at a share of 0.2).

The broadcast forest is bounded: a tree has 2**DEPTHS[1] leaves at most (32 MB of planes in 64 dimensions, at any number of
rows), and only the planes on the way to a leaf are computed. Of equal vectors only the TOP + 1 smallest ids are indexed,
since no query can return more; that is exact and bounds what a very common vector costs.

Defined cases: vectors that are null, empty, zero, of another length than the most common one (of two, the longer), or hold
null or non-finite components take no part, nor do rows with a null id; of rows with one id the smallest vector counts, and
a query never returns its own id; ties go to the smaller id; with fewer candidates all are returned; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.llm.common import materialise

TOP, TREES, SAMPLE, LEAF, BLOCK, SHARE = 20, 6, 16384, 4096, 4096, 1.6
#: Least and most levels of a tree.
DEPTHS = 6, 13


@dataclass
class Forest:
    """Perfect binary trees: node n of a tree has children 2n+1 and 2n+2; the last level's children are the leaves."""

    normals: np.ndarray  # trees x nodes x (dimensions + 1)
    offsets: np.ndarray  # trees x nodes
    depth: int
    reach: float  # length of the longest vector

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, self.reach**2 - (v * v).sum(1)))])

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over the forest; only the nodes on its way are looked at."""
        x, (trees, nodes) = self.lifted(v), self.offsets.shape
        out = np.empty((len(v), trees), np.int64)
        for t in range(trees):
            at = np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                right = np.einsum("nd,nd->n", x, self.normals[t, at]) > self.offsets[t, at]
                at = 2 * at + 1 + right
            out[:, t] = at - nodes + t * (nodes + 1)
        return out

    def visits(self, v: np.ndarray, sizes: list[int], wanted: float) -> Iterator[list[int]]:
        """For each query the leaves that it pops from one queue over all trees, until they hold `wanted` rows."""
        trees, nodes = self.offsets.shape
        for x in np.column_stack([v, np.zeros(len(v))]):
            queue, found, held = [(-math.inf, t, 0) for t in range(trees)], [], 0
            while queue and held < wanted:
                p, t, at = heapq.heappop(queue)
                if at >= nodes:
                    leaf = t * (nodes + 1) + at - nodes
                    if sizes[leaf]:
                        found.append(leaf)
                        held += sizes[leaf]
                    continue
                side = float(self.normals[t, at] @ x) - self.offsets[t, at]
                heapq.heappush(queue, (max(p, side), t, 2 * at + 1))
                heapq.heappush(queue, (max(p, -side), t, 2 * at + 2))
            yield found


def grow(sample: np.ndarray, reach: float, trees: int, depth: int, seed: int = 0) -> Forest:
    rng, nodes = np.random.default_rng(seed), 2**depth - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), depth, reach)
    x = forest.lifted(sample)
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for n in range(nodes):
            own = members.pop(n)
            if len(own) > 1:
                a, b = x[rng.choice(own, 2, replace=False)]
                normal = a - b
            if len(own) < 2 or not normal.any():
                normal = rng.normal(size=x.shape[1])
            normal /= np.linalg.norm(normal)
            side = x[own] @ normal
            forest.normals[t, n], forest.offsets[t, n] = normal, np.median(side) if len(own) else 0.0
            right = side > forest.offsets[t, n]
            if n * 2 + 2 < nodes:
                members[2 * n + 1], members[2 * n + 2] = own[~right], own[right]
    return forest


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>: one row per id, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("v") == (size.n if size else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found to every row that meets is_query (a condition on vec_id)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable(vectors)
    context = rows.sparkSession.sparkContext
    equal = Window.partitionBy("v").orderBy("vec_id")
    indexed = materialise(rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= top + 1).drop("n"), "indexed")
    stat = indexed.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not stat.n:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    depth = min(DEPTHS[1], max(DEPTHS[0], math.ceil(math.log2(stat.n / LEAF))))
    forest = context.broadcast(grow(np.array([r.v for r in sample]), math.sqrt(stat.m), trees, depth))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.value.leaves(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found.tolist(), pa.list_(pa.int64()))], ["vec_id", "v", "leaves"])

    entries = materialise(indexed.mapInArrow(placed, f"vec_id {kind}, v array<double>, leaves array<long>"), "leaves")
    count = {r.leaf: r.n for r in entries.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    sizes = [count.get(k, 0) for k in range(trees * 2**depth)]
    blocks = [max(1, -(-n // BLOCK)) for n in sizes]
    queries = rows.where(is_query)
    wanted = max(share * stat.n, trees * (top + 1))  # a row is in one leaf a tree, so these hold top + 1 different rows
    parts = max(1, math.ceil(queries.count() * wanted / stat.n / trees / BLOCK))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.value.visits(_matrix(batch.column("v")), sizes, wanted)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(list(found), pa.list_(pa.int64()))], ["vec_id", "v", "leaves"])

    visits = queries.repartition(max(8, parts), "vec_id").mapInArrow(asked, f"vec_id {kind}, v array<double>, leaves array<long>")
    per_leaf = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(blocks)), "leaf long, blocks int"))  # bounded by the forest
    hashed = F.xxhash64("vec_id")
    left = visits.select("vec_id", "v", F.explode("leaves").alias("leaf")).join(per_leaf, "leaf").select("vec_id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(hashed, F.lit(parts)).cast("int").alias("part"))
    right = entries.select("vec_id", "v", F.explode("leaves").alias("leaf")).join(per_leaf, "leaf").select("vec_id", "v", "leaf", F.pmod(hashed, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    keys = ("leaf", "block", "part")

    def best(asking: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asking.num_rows and members.num_rows:
            q, x = (_matrix(t.column("v").combine_chunks()) for t in (asking, members))
            qid, xid = (t.column("vec_id").to_numpy() for t in (asking, members))
            few = min(len(xid), 2 * top + 2)
            slack = 1e-9 * max(1.0, float(np.abs(q).max() * np.abs(x).max() * x.shape[1]))  # what the order of a sum can change
            for k in range(0, len(q), 512):
                near = q[k : k + 512] @ x.T
                least = np.partition(near, len(xid) - few, axis=1)[:, len(xid) - few] - slack
                for own, mine, row, bound in zip(qid[k : k + 512], q[k : k + 512], near, least):
                    at = np.flatnonzero((row >= bound) & (xid != own))
                    scores = (mine * x[at]).sum(-1)
                    first = np.lexsort((xid[at], -scores))[:top]
                    out.append((own, xid[at][first].tolist(), scores[first].tolist()))
        id_type = asking.schema.field("vec_id").type
        return pa.table([pa.array([o[0] for o in out], id_type), pa.array([o[1] for o in out], pa.list_(id_type)), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query_id {kind}, ids array<{kind}>, scores array<double>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def ranked() -> list[tuple]:
            ids, scores = (np.concatenate(x) for x in zip(*held))
            ids, at = np.unique(ids, return_index=True)
            first = np.lexsort((ids, -scores[at]))[:top]
            return [(now, k, i, s) for k, (i, s) in enumerate(zip(ids[first].tolist(), scores[at][first].tolist()), 1)]

        for batch in batches:
            out = []
            for query, ids, scores in zip(batch.column("query_id").to_pylist(), batch.column("ids"), batch.column("scores")):
                if query != now:
                    if held:
                        out += ranked()
                    now, held = query, []
                held.append((ids.values.to_numpy(), scores.values.to_numpy()))
            if out:
                yield _ranks(out, batch.schema.field("query_id").type)
            id_type = batch.schema.field("query_id").type
        if held and (out := ranked()):
            yield _ranks(out, id_type)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, f"query_id {kind}, rank int, vec_id {kind}, score double")


def _ranks(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (id_type, pa.int32(), id_type, pa.float64()))], ["query_id", "rank", "vec_id", "score"])
