"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlens.session import ship
from meetlens.sources.shared import materialise, shared_dir  # noqa: F401  operators take them from here

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white-space bytes; null gives none."""
    return text.encode().translate(_LOWER).split() if text else []


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts are longer than the rows that is meant for.
BATCH_ROWS, _CONF = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Sends the package where it is missing, and keeps Arrow's batches of texts small unless the session sets their size."""
    ship(spark)
    if spark.conf.get(_CONF) == "10000":
        spark.conf.set(_CONF, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_HOLDER: list = [None, None]


def hold(name: str, release: Callable[[], None]) -> None:
    """Called by an operator that remembers things in its worker: what another operator remembered there goes.

    Workers are used again by later stages; a pipeline's operators would otherwise fill them one after the other. What is freed goes
    back to the system: an allocator that keeps it would count against the executor for good.
    """
    if _HOLDER[0] != name:
        if _HOLDER[1]:
            _HOLDER[1]()
        _HOLDER[:] = [name, release]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def slices(batches, rows: int = 512):
    """Small record batches, so that a worker holds the Python objects of few texts at a time; Arrow's free memory goes back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()


#: Bits of a map of listed rows at most, and its pages.
MOST_BITS, PAGES = 1 << 28, 64


class Listed:
    """A test of keys: true for every key of the rows, and by chance for a few others, so that a join moves few rows in vain.

    A bitmap of the keys' hashes, eight bits a row and MOST_BITS at most, is made by pages on the executors and broadcast: 32 MB
    however many rows there are. Where nearly all bits are set it lets all rows through.
    """

    def __init__(self, rows: DataFrame, key: tuple[str, ...]) -> None:
        self.key, self.known = key, _bitmap(rows, key)
        self.bits = 8 * len(self.known.value)

    def place(self) -> Column:
        """Of rows that have the key columns: where has() looks."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.bits))

    def has(self) -> Callable[[pa.Array], np.ndarray]:
        """The test of places, for a task's own use; a second Python worker in a task would double what workers remember."""
        known = self.known

        def test(place: pa.Array) -> np.ndarray:
            at = place.to_numpy(zero_copy_only=False)
            return known.value[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1

        return test

    def column(self) -> Column:
        """The test as a column; only places go to the workers."""
        has = self.has()

        @F.arrow_udf("boolean")
        def test(place: pa.Array) -> pa.Array:
            return pa.array(has(place))

        return test(self.place())


def _bitmap(rows: DataFrame, key: tuple[str, ...]):
    spark, n = rows.sparkSession, rows.count()
    bits = min(MOST_BITS, 1 << max(16, (8 * n).bit_length()))
    page = bits // PAGES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column("place").to_numpy()
            for part in np.split(places, np.flatnonzero(np.diff(places // page)) + 1):
                if len(part):
                    own = int(part[0] // page)
                    if own not in found:
                        yield from sent(found)
                        found[own] = np.zeros(page, bool)
                    found[own][part % page] = True
        yield from sent(found)

    def sent(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for own, held in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["page", "bits"])
        found.clear()

    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    pages = rows.select(place.alias("place")).repartition(F.floor(F.col("place") / page)).sortWithinPartitions("place").mapInArrow(fill, "page long, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in pages.toLocalIterator():
        bitmap[row.page * page // 8 : (row.page + 1) * page // 8] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bitmap)
