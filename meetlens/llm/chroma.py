"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

Frames of a recording's spectrum are folded into twelve pitch classes, smoothed and normalised. Sixteen filters compare
rectangles of the pitch-class image by its integral image; each result becomes two bits by three thresholds (Gray code; they
are fixed, the quartiles over seeded random melodies), so a frame gives a 32-bit integer. Two recordings are aligned by
histograms of the offsets between equal integers; they link if an offset has VOTES equal integers or more, OVERLAP frames in
common or more, and a share of differing bits there of ERROR or less.

Recordings with equal fingerprints form a class, and classes are aligned, not copies. Queries are the classes with a member
that meets a condition; they are searched against all classes through the integers.

Defined cases: null, empty and short recordings have an empty fingerprint, are one class and link to nothing; samples that are
not finite count as silence; a row with a null id has its fingerprint and a class, and a class's id is its smallest id that is
not null; repeated rows are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import materialise, slices

FRAME, HOP, LOWEST, HIGHEST, WIDTH = 1024, 256, 60.0, 1760.0, 16
VOTES, OVERLAP, ERROR = 2, 16, 0.3
#: Queries of a block of the inverted index, and the parts that the postings of one integer are dealt into.
BLOCK, SALT = 4096, 8


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of sixteen filters, by rule: kinds in turn, bands and lengths spread evenly."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3, 4 + 4 * (k % 4)) for k in range(16)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class frames (frames x 12): each smoothed over five frames and of length one; near-silent frames are zero."""
    samples = np.nan_to_num(np.asarray(samples, np.float32), nan=0.0, posinf=0.0, neginf=0.0)
    n = (len(samples) - FRAME) // HOP + 1
    if n < WIDTH:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * np.hamming(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (f >= LOWEST) & (f <= HIGHEST)
    pitch = np.round(12 * np.log2(f[used] / 440)).astype(int) % 12
    image = power[:, used] @ (pitch[:, None] == np.arange(12)).astype(np.float64)
    kernel = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    image = np.stack([np.convolve(image[:, c], kernel, "same") for c in range(12)], 1)
    length = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(length > 1e-6, image / np.maximum(length, 1e-6), 0.0)


def responses(image: np.ndarray) -> np.ndarray:
    """Windows x 16: what each filter finds in each window of the image, by its integral image."""
    n = len(image) - WIDTH + 1
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, c0, c1):
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out = np.empty((n, 16))
    for k, (kind, first, classes, frames) in enumerate(filters()):
        end, half_c, half_t = min(12, first + classes), first + classes // 2, frames // 2
        if kind == 0:  # the band against all classes
            plus, minus = area(0, frames, first, end), area(0, frames, 0, 12) * (end - first) / 12
        elif kind == 1:  # later against earlier
            plus, minus = area(half_t, frames, first, end), area(0, half_t, first, end)
        elif kind == 2:  # upper against lower classes
            plus, minus = area(0, frames, half_c, end), area(0, frames, first, half_c)
        else:  # one diagonal against the other
            plus, minus = area(0, half_t, first, half_c) + area(half_t, frames, half_c, end), area(half_t, frames, first, half_c) + area(0, half_t, half_c, end)
        out[:, k] = np.log1p(np.maximum(plus, 0)) - np.log1p(np.maximum(minus, 0))
    return out


@lru_cache
def thresholds(rate: int) -> np.ndarray:
    """3 x 16: the quartiles of each filter over seeded random melodies, whatever the corpus."""
    notes = np.random.default_rng(7).normal(0, 3, (24, 48)).round()
    length = round(rate / 8)
    tunes = [np.sin(np.cumsum(2 * np.pi * np.repeat(440 * 2 ** (x / 12), length) / rate)) for x in notes]
    return np.quantile(np.concatenate([responses(chroma(x, rate)) for x in tunes]), (0.25, 0.5, 0.75), axis=0)


def fingerprint(samples: np.ndarray | None, rate: int) -> np.ndarray:
    """A 32-bit integer for each window of WIDTH frames."""
    image = chroma(samples if samples is not None else np.zeros(0), rate)
    if len(image) < WIDTH:
        return np.zeros(0, np.uint32)
    level = (responses(image)[:, None, :] > thresholds(rate)).sum(1).astype(np.uint32)
    return ((level ^ level >> 1) << np.arange(0, 32, 2, dtype=np.uint32)).sum(1, dtype=np.uint32)


def fingerprints(media: DataFrame, samples, rate: int, column: str) -> DataFrame:
    """id, fp binary (little-endian unsigned 32-bit). samples: makes a recording of a value of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [fingerprint(samples(x), rate).astype("<u4").tobytes() for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "fp"])

    return media.select("id", column).mapInArrow(run, f"id {media.schema['id'].dataType.simpleString()}, fp binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames in common and the share of differing bits, where b starts offset frames after a's start."""
    first, last = max(0, offset), min(len(a), len(b) + offset)
    if last <= first:
        return 0, 1.0
    return last - first, float(np.bitwise_count(a[first:last] ^ b[first - offset : last - offset]).sum()) / (32 * (last - first))


def matches(asking: np.ndarray, other: np.ndarray, offsets: list[int]) -> tuple[int, float] | None:
    """Of these offsets the one with the fewest differing bits (then the nearest, then the smaller), if it passes."""
    best = None
    for offset in offsets:
        overlap, error = bit_error(asking, other, offset)
        if overlap >= OVERLAP and error <= ERROR:
            best = min(best or (error, abs(offset), offset), (error, abs(offset), offset))
    return (best[2], best[0]) if best else None


def postings(prints: DataFrame, kind: str) -> DataFrame:
    """class_id, code, at: every integer of every fingerprint (class_id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = [np.frombuffer(x, "<u4") for x in batch.column("fp").to_pylist()]
            sizes = [len(x) for x in found]
            if sizes:
                at = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)
                ids = pa.array(np.repeat(batch.column("class_id").to_numpy(), sizes))
                codes = pa.array(np.concatenate(found).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, codes, pa.array(at)], ["class_id", "code", "at"])

    return prints.select("class_id", "fp").mapInArrow(run, f"class_id {kind}, code long, at int")


def votes(classes: DataFrame, kind: str) -> DataFrame:
    """class_id, block, found (array of q, offset): where a class has VOTES equal integers or more with a query.

    The queries' inverted index has a row per integer and block of queries, with the postings packed in it, so a class's
    integer meets rows in proportion to the blocks and not to the queries that hold it. All rows of a class and a block meet
    in one place, where the histogram of offsets is made; it holds BLOCK queries at most.
    """
    asking = classes.where("asks")
    blocks = max(1, -(-asking.count() // BLOCK))
    index = postings(asking, kind).withColumn("block", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int"))
    index = index.groupBy("code", "block").agg(F.collect_list("class_id").alias("qs"), F.collect_list("at").alias("q_ats"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = postings(classes, kind).withColumn("salt", F.pmod(F.xxhash64("class_id", "at"), F.lit(SALT)).cast("int"))
    met = own.join(index, ["code", "salt"]).select("class_id", "block", "at", "qs", "q_ats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, id_type = None, [], pa.int64()

        def histogram() -> tuple:
            qs = np.concatenate([x[0] for x in held])
            offsets = np.concatenate([x[2] - x[1] for x in held])
            order = np.lexsort((offsets, qs))
            qs, offsets = qs[order], offsets[order]
            first = np.flatnonzero(np.append(True, (qs[1:] != qs[:-1]) | (offsets[1:] != offsets[:-1])))
            often = first[np.diff(np.append(first, len(qs))) >= VOTES]
            return now[0], [{"q": q, "offset": o} for q, o in zip(qs[often].tolist(), offsets[often].tolist())]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = (id_type, pa.list_(pa.struct([("q", id_type), ("offset", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["class_id", "found"])

        for batch in slices(batches, 2048):
            id_type, out = batch.schema.field("class_id").type, []
            keys = zip(batch.column("class_id").to_pylist(), batch.column("block").to_pylist())
            for key, at, qs, q_ats in zip(keys, batch.column("at").to_pylist(), batch.column("qs"), batch.column("q_ats")):
                if key != now and held:
                    out.append(histogram())
                    held = []
                now = key
                held.append((qs.values.to_numpy(), q_ats.values.to_numpy(), at))
            if out:
                yield rows(out)
        if held:
            yield rows([histogram()])

    dealt = met.repartition("class_id", "block").sortWithinPartitions("class_id", "block")
    return dealt.mapInArrow(run, f"class_id {kind}, found array<struct<q:{kind},offset:int>>")


def align(prints: DataFrame, is_query: Column) -> DataFrame:
    """A row per recording: id, frames, fp_crc32, class_id, n_links, best_id, best_offset, best_error.

    n_links: query classes other than its own that link to its class; best: the one with the fewest differing bits (of
    equal ones the smaller id), and by how many frames it starts later. Every offset with VOTES equal integers is verified.
    """
    kind = prints.schema["id"].dataType.simpleString()
    named = prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asks"))
    named = materialise(named, "classes")
    classes = named.where("class_id IS NOT NULL AND length(fp) > 0")
    pairs = votes(classes, kind).select("class_id", F.explode("found").alias("x")).where("x.q <> class_id")
    pairs = pairs.groupBy("class_id", F.col("x.q").alias("q")).agg(F.sort_array(F.collect_list("x.offset")).alias("offsets"))
    pairs = pairs.join(classes.select("class_id", F.col("fp").alias("r_fp")), "class_id")
    pairs = pairs.join(classes.where("asks").select(F.col("class_id").alias("q"), F.col("fp").alias("q_fp")), "q")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            out = []
            for q, r, offsets, a, b in zip(*(batch.column(c).to_pylist() for c in ("q", "class_id", "offsets", "r_fp", "q_fp"))):
                if good := matches(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), offsets):
                    out.append((q, r, *good))
            if out:
                id_type = batch.schema.field("q").type
                kinds = (id_type, id_type, pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["q", "class_id", "offset", "error"])

    linked = pairs.mapInArrow(verified, f"q {kind}, class_id {kind}, offset int, error double")
    linked = linked.groupBy("class_id").agg(F.count("*").alias("n"), F.min(F.struct("error", "q", "offset")).alias("x"))
    named = materialise(named.select("fp", "class_id").join(linked, "class_id", "left"), "linked")
    best = [F.col("x.q").alias("best_id"), F.col("x.offset").alias("best_offset"), F.round("x.error", 6).alias("best_error")]
    size = (F.length("fp") / 4).cast("int").alias("frames")
    found = prints.join(named, "fp")
    return found.select("id", size, F.crc32("fp").alias("fp_crc32"), "class_id", F.coalesce("n", F.lit(0)).alias("n_links"), *best)


def melody(vector: list | None, rate: int = 4000, seconds: float = 0.125) -> np.ndarray | None:
    """A recording of a vector: a note per component, half-tones about 440 Hz by its twentieths, with an octave above."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([x if x is not None else 0.0 for x in vector], float), nan=0.0, posinf=0.0, neginf=0.0)
    pitch = np.clip(np.round(20 * v), -12, 12)
    f = np.repeat(440 * 2 ** (pitch / 12), round(rate * seconds))
    phase = np.cumsum(2 * np.pi * f / rate)
    return (np.sin(phase) + 0.5 * np.sin(2 * phase)).astype(np.float32)
