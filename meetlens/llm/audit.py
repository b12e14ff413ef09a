"""Filter interaction audit over a packed bitmap index.

Every batch of a partition becomes one row a part: NumPy bitsets, a bit a document, of the documents that fail each filter and of
those that carry each label. For every set of filters, the documents that pass all of it are found by AND-NOT from the set without
its last filter and counted by popcount, in all and for each label. A partition sums its counts before the shuffle, so what moves
is 2 ** filters rows a part and task. All orders follow from these sums: what a step keeps depends on the set of filters up to it only.

Documents equal to an earlier one are found on 128-bit digests: the smallest id of each digest comes from a partial aggregate, and a
row is looked up by digest and id together, so a group of copies of any size is dealt over all tasks.

Defined cases: null and empty texts are both empty, and copies of each other; a null part counts as the empty string; a null id has no
order, so it never fails as a copy and makes no other row one; repeated rows are each counted, and equal ids are not smaller than one
another; labels may name an id several times (any 1 counts), a null or unknown id (no effect) or hold nulls (not 1); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.llm.common import hold, materialise, slices

_CAPITALS, _SPECIAL, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]"), re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are objects at one time; only the distinct words of a longer text stay.
PIECE = 1 << 20


def _words(text: bytes) -> tuple[int, int]:
    """Words, and distinct words; a long text is taken in pieces that end at white space."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def measure(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, n_words, n_distinct, n_capitals, n_points long, special boolean, digest binary of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("audit", lambda: None)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                rows.append((*_words(raw), len(raw) - len(raw.translate(None, _CAPITALS)), len(text or ""), bool(_SPECIAL.search(raw)), hashlib.blake2b(raw, digest_size=16).digest()))
            found = [pa.array(x, kind) for x, kind in zip(zip(*rows), (*[pa.int64()] * 4, pa.bool_(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *found], ["doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_points", "special", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part string, n_words long, n_distinct long, n_capitals long, n_points long, special boolean, digest binary")


def with_copies(measured: DataFrame) -> DataFrame:
    """Adds copy boolean: an equal digest has a smaller id. measured is read twice."""
    first = measured.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = measured.where("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left")
    named = known.select(*measured.columns, F.col("first").isNull().alias("copy"))
    return named.union(measured.where("doc_id IS NULL").withColumn("copy", F.lit(False)))


def index(rows: DataFrame, names: list[str]) -> DataFrame:
    """part string, n int, bits binary: the bitsets of the boolean columns names over n documents of one part and batch.

    Each bitset is padded to whole 64-bit words; they follow one another in the order of names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code = np.asarray(parts.indices)
            order = np.argsort(code, kind="stable")
            flags = np.stack([np.asarray(batch.column(name).to_numpy(zero_copy_only=False), bool)[order] for name in names])
            ends = np.cumsum(np.bincount(code, minlength=len(parts.dictionary)))
            starts = ends - np.diff(ends, prepend=0)
            bits = []
            for a, b in zip(starts.tolist(), ends.tolist()):
                padded = np.zeros((len(names), -(b - a) // 64 * -64), bool)
                padded[:, : b - a] = flags[:, a:b]
                bits.append(np.packbits(padded, axis=1, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([parts.dictionary, pa.array((ends - starts).astype(np.int32)), pa.array(bits, pa.binary())], ["part", "n", "bits"])

    return rows.select("part", *names).mapInArrow(run, "part string, n int, bits binary")


def _passing(n: int, bits: bytes, filters: int) -> np.ndarray:
    """By set of filters and (all documents, then each label): how many of n documents pass the whole set."""
    sets = np.frombuffer(bits, "<u8").reshape(-1, -(-n // 64))
    every = np.full(sets.shape[1], ~np.uint64(0))
    if n % 64:
        every[-1] = np.uint64((1 << n % 64) - 1)
    among = np.vstack([every, sets[filters:]])
    passed, counts = [every], np.empty((1 << filters, len(among)), np.int64)
    for chosen in range(1 << filters):
        if chosen:
            last = chosen.bit_length() - 1
            passed.append(passed[chosen ^ 1 << last] & ~sets[last])
        counts[chosen] = np.bitwise_count(passed[chosen] & among).sum(1)
    return counts


def prefix_counts(bitmaps: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """part, chosen int (a bit a filter), kept long and a long for each label: the documents that pass all filters of the set."""
    columns = ["kept", *labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            found = np.concatenate(list(sums.values()))
            parts = pa.array([part for part in sums for _ in range(1 << filters)], pa.string())
            sets = pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(sums)))
            sums.clear()
            return pa.RecordBatch.from_arrays([parts, sets, *(pa.array(x) for x in found.T)], ["part", "chosen", *columns])

        for batch in batches:
            for part, n, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = _passing(n, bits, filters)
                sums[part] = sums[part] + found if part in sums else found
                if len(sums) > 1000:
                    yield flush()
        if sums:
            yield flush()

    counted = bitmaps.mapInArrow(run, "part string, chosen int, " + ", ".join(f"{c} long" for c in columns))
    return counted.groupBy("part", "chosen").agg(*(F.sum(c).alias(c) for c in columns))


def orders(counts: DataFrame, letters: str, labels: list[str]) -> DataFrame:
    """A row for each part, order of all filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, a
    {label}_lost for each label, shapley.
    """
    full, steps = (1 << len(letters)) - 1, []
    for order in permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"struct('{''.join(letters[i] for i in order)}' AS filter_order, {k + 1} AS step, {1 << f} AS bit, {before} AS before)")
            before |= 1 << f
    columns = ["kept", *labels]
    by_set = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("chosen", *columns))).alias("n"))
    at = by_set.select("part", "n", F.inline(F.expr(f"array({', '.join(steps)})")))
    bit = F.col("bit")

    def passing(chosen: Column, column: str = "kept") -> Column:
        return F.col("n")[chosen][column]

    after, removed = F.col("before").bitwiseOR(bit), passing(F.col("before")) - passing(F.col("before").bitwiseOR(bit))
    found = at.select(
        "part",
        "filter_order",
        "step",
        "bit",
        passing(after).alias("kept"),
        removed.alias("removed"),
        (passing(F.lit(0)) - passing(bit) - removed).alias("redundant"),
        (passing(F.lit(full).bitwiseXOR(bit)) - passing(F.lit(full))).alias("unique_fails"),
        *((passing(F.col("before"), name) - passing(after, name)).alias(f"{name}_lost") for name in labels),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def conditions() -> dict[str, Column]:
    """The filters of the audit by letter: when a document fails, over the columns of measure and with_copies."""
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_points"),
        "D": F.col("special"),
        "E": F.col("copy"),
    }


def audit(docs: DataFrame, labels: DataFrame, part: Column, fails: dict[str, Column] | None = None) -> DataFrame:
    """The audit of all orders of the filters fails, with what they lose of labels' good (quality 1) and toxic documents."""
    fails = fails or conditions()
    if not 1 <= len(fails) <= 6 or not all(len(x) == 1 and x.isalnum() for x in fails):
        raise ValueError("one to six filters of one letter each")
    rows = with_copies(materialise(measure(docs, part), "measured"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    flagged = rows.select("doc_id", "part", *(F.coalesce(c, F.lit(False)).alias(f"fails_{x}") for x, c in fails.items()))
    with_id = flagged.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    without = flagged.where("doc_id IS NULL").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    named = with_id.unionByName(without).fillna(False, ["good", "toxic"])
    bitmaps = index(named, [*(f"fails_{x}" for x in fails), "good", "toxic"])
    return orders(prefix_counts(bitmaps, len(fails), ["good", "toxic"]), "".join(fails), ["good", "toxic"])
