"""Streaming forms: the plans take a batch or a streaming frame; `run` drives one to the end of what is there.

recent_windows, sessions and unique drop state behind the watermark. monthly, latest and gravest keep one row a key for good,
as their results do. Rows go to a table beside the checkpoint; sinks that correct earlier rows write through foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meetlens.sources.readers import exists

WATERMARK = "1 day"
#: State on local disk with changelogs in the checkpoint, which stateful processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder (or file) of Parquet as a stream; columns of time without zone become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not is_folder(spark, path):  # streams read folders: the file alone of its own
        path, _, name = path.rpartition("/")
        stream = stream.option("pathGlobFilter", name)
    return timestamps(stream.parquet(path))


def is_folder(spark: SparkSession, path: str) -> bool:
    """In whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def timestamps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def monthly(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Races and best value per key and calendar month."""
    return df.groupBy(*keys, F.date_trunc("month", F.col(ts)).alias("month")).agg(F.count("*").alias("races"), F.max(value).alias("best"))


def recent_windows(df: DataFrame, keys: list[str], ts: str, value: str, days: int = 45, step: str = "15 days") -> DataFrame:
    """Best and count of sliding windows, final once the watermark has passed them."""
    w = F.window(ts, f"{days} days", step)
    return df.withWatermark(ts, WATERMARK).groupBy(*keys, w).agg(F.count("*").alias("races"), F.max(value).alias("best")).select(*keys, F.col("window.start").alias("start"), "races", "best")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events with less than a gap between them."""
    return df.withWatermark(ts, WATERMARK).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("events")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def unique(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First row of each key; state older than the watermark goes."""
    return df.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def latest(df: DataFrame, keys: list[str], ts: str, columns: list[str], tiebreak: str) -> DataFrame:
    """Latest row of each key: a later return supersedes an older flag."""
    return df.groupBy(*keys).agg(F.max(F.struct(ts, tiebreak, *columns)).alias("x")).select(*keys, F.col(f"x.{ts}").alias(ts), *[F.col(f"x.{c}").alias(c) for c in columns])


def gravest(df: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """Status that only escalates."""
    return df.groupBy(*keys).agg(F.max(severity).alias(severity))


def run(df: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Drives a stream over what is there; returns the table of its rows, or nothing where a batch function takes them.

    A batch has a folder of its own (a complete result one for all), which running it again overwrites.
    """
    spark, rows = df.sparkSession, f"{checkpoint}-rows"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/__batch={0 if mode == 'complete' else n}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(sink or keep).start().awaitTermination()
    if sink:
        return None
    found = spark.read.schema(df.schema).parquet(rows) if exists(spark, rows) else spark.createDataFrame([], df.schema)
    return found.select(df.columns)


def upsert_batches(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest row of each key in a table; running a batch again changes nothing."""
    from meetlens.sources.sinks import upsert

    return lambda batch, _: upsert(batch.dropDuplicates(key), path, key)


def correction_batches(path: str, source: str, season: str) -> Callable[[DataFrame, int], None]:
    """A batch function for late corrections: the sources' seasons that a batch has rows of are replaced by them, partition by partition."""
    from meetlens.sources.sinks import replace_source
    from meetlens.sources.shared import materialise

    def write(batch: DataFrame, _: int) -> None:
        rows = materialise(batch, "corrections")
        for (own,) in rows.select(source).distinct().collect():  # a name for each source
            replace_source(rows.where(F.col(source) == own), path, source, own, season)

    return write


class Availability(StatefulProcessor):
    """Standing of each athlete: the newest flag holds until a later return clears it, or for `days` of event time.

    State is one value (the newest flag with its status and id, and the newest return) and one timer, at the flag's end; both go when the
    timer fires, so state is bounded by the athletes flagged in the last `days`. A row is emitted whenever the standing changes:
    'out' at a flag, 'cleared' at a return, 'expired' at a flag's end. Rows may come in any order: the newest wins, then the larger id.
    """

    def __init__(self, key: str, days: int) -> None:
        self.key, self.keep = key, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("standing", "flag long, id long, status string, back long, shown string")

    def row(self, key: tuple, standing: str, status: str | None, at: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "standing": [standing], "status": [status], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flag, at_id, status, back, shown = self.state.get() if self.state.exists() else (-1, -1, None, -1, None)
        before = flag
        for batch in rows:
            for ts, own, what, is_back in zip(batch["at_ms"], batch["flag_id"], batch["flag_status"], batch["is_return"]):
                if is_back:
                    back = max(back, int(ts))
                elif (int(ts), int(own)) > (flag, at_id):
                    flag, at_id, status = int(ts), int(own), what
        if flag < 0:  # a return alone: nothing to clear, and nothing later than it is known
            return
        now = f"cleared {back}" if back > flag else f"out {flag} {at_id}"
        if flag != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(flag + self.keep)
        self.state.update((flag, at_id, status, back, now))
        if now != shown:
            yield self.row(key, now.split()[0], status, back if back > flag else flag)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            flag, _, status, back, _ = self.state.get()
            self.state.clear()
            if back <= flag:
                yield self.row(key, "expired", status, flag + self.keep)

    def close(self) -> None:
        pass


def availability(df: DataFrame, key: str, ts: str, id_column: str, status: Column, back: Column, days: int = 30) -> DataFrame:
    """key, standing, status, at: every change of standing, from a stream of flags (status not null) and returns (back true)."""
    rows = df.withWatermark(ts, WATERMARK).select(key, ts, F.unix_millis(ts).alias("at_ms"), F.col(id_column).cast("long").alias("flag_id"), status.alias("flag_status"), F.coalesce(back, F.lit(False)).alias("is_return"))
    rows = rows.where(F.col("flag_status").isNotNull() | F.col("is_return"))
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Availability(key, days), f"{key} {kind}, standing string, status string, at timestamp", "Update", "EventTime")
