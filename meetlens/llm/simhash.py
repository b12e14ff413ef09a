"""SimHash near-duplicates found by multi-index hashing.

A text's fingerprint has bit i set if over half of its shingle hashes do. Fingerprints of 64 bits link at RADIUS = 2 or
fewer differing bits. They are first made distinct, so copies cost nothing. Two tables index the upper and the lower
half; two fingerprints within 2 bits agree to within one bit in the upper half or wholly in the lower, so the probes are the
ball of radius 1 around the upper half (33 values) and the ball of radius 0 around the lower (1). Matches with a probed table
entry are verified over all 64 bits where the entries of one value meet, and only a spanning forest of the verified links
leaves that place, so a dense group of near copies emits rows in proportion to its size.

A half shared by more than HEAVY fingerprints is not compared whole: those fingerprints are indexed a second time, by
three of their four 16-bit quarters. Within 2 bits, some choice of the fourth leaves at most one differing bit in the other
three, so the probes there are the balls of radius 1 over three quarters; entries of one value differ in one quarter only, so
there are at most 65,536. Components follow by large-star and small-star steps, on the executors.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a text of fewer words than a shingle is one
shingle; a null id keeps its row, and a component's id is the smallest id that is not null (null if there is none); repeated
rows are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import ascii_words, hold, materialise, slices
from meetlens.llm.graph import components

RADIUS, SHINGLE, SEED, HEAVY = 2, 3, 42, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = ascii_words(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        of = xxhash.xxh64_intdigest
        hashes = [of(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    ones = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp long (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("fingerprints", lambda: None)
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints (64-bit signed numbers): (fingerprint, root) pairs."""
    n, bits = len(fps), fps.view(np.uint64)
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for start in range(0, n, 256):
        close = np.bitwise_count(bits[start : start + 256, None] ^ bits[None, start:]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(close))):
            if i < j and (a := top(start + i)) != (b := top(start + j)):
                root[max(a, b)] = min(a, b)
    return [(int(fps[i]), int(fps[t])) for i in range(n) if (t := top(i)) != i]


def links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: spanning links among the rows of entries (key long, part int, fp long) that share key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        out: list[tuple[int, int]] = []

        def flush() -> None:
            fps = np.unique(np.array(held, np.int64))
            if len(fps) > 1:
                out.extend(forest(fps, radius))

        for batch in batches:
            for group in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), batch.column("fp").to_pylist()):
                if group[:2] != now:
                    if len(held) > 1:
                        flush()
                    held, now = [], group[:2]
                held.append(group[2])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out.clear()
        if len(held) > 1:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return entries.select("part", "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key", "fp").mapInArrow(run, "a long, b long")


def _flips(key: Column, bits: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits)), lambda m: key.bitwiseXOR(m))


def _tagged(part: int, keys: Column) -> Column:
    return F.transform(keys, lambda key: F.struct(F.lit(part).alias("part"), key.alias("key")))


def _indexed(fps: DataFrame, tables: list[tuple[int, list[int]]]) -> DataFrame:
    """part, key, fp: table entries and those probes that meet an entry. tables: the bits of the key, and those to flip."""
    own = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(_signed(mask)).alias("key")) for k, (mask, _) in enumerate(tables)))
    entries = fps.select(F.explode(own).alias("x"), "fp").select("x.part", "x.key", "fp")
    probed = [_tagged(k, _flips(F.col("fp").bitwiseAND(_signed(mask)), bits)) for k, (mask, bits) in enumerate(tables) if bits]
    probes = fps.select(F.explode(F.concat(*probed)).alias("x"), "fp").select("x.part", "x.key", "fp")
    probes = probes.join(entries.where(F.col("part").isin([k for k, (_, bits) in enumerate(tables) if bits])).select("part", "key").distinct(), ["part", "key"], "left_semi")
    return entries.union(probes)


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


_LOW, _HIGH = (1 << 32) - 1, ((1 << 32) - 1) << 32
HALVES = [(_HIGH, list(range(32, 64))), (_LOW, [])]
QUARTERS = [((1 << 64) - 1 ^ 0xFFFF << 16 * q, [b for b in range(16 * (q + 1), 64)]) for q in range(4)]


def near_links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """a, b: links that span every component of distinct fingerprints fp within RADIUS bits."""
    entries = materialise(_indexed(fps, HALVES), "halves")
    size = entries.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = entries.join(size, ["part", "key"])
    light = links(shared.where(F.col("n") <= heavy))
    crowded = shared.where(F.col("n") > heavy).select("fp").distinct()
    return light.union(links(_indexed(materialise(crowded, "crowded"), QUARTERS)))


def cluster(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(near_links(classes.select("fp")))
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(ids, "root").select("fp", "component_id")
    return own.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
