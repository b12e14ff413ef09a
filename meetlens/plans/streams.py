"""Streaming forms over events, driven to the end of the table; the twins are their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meetlens.plans.base import ORACLES, QUERIES
from meetlens.session import ship
from meetlens.sources.shared import shared_dir
from meetlens.streaming import streams as S


def _stream(name: str, sql: str, plan, mode: str, after=lambda df: df):
    """Registers a streaming query on the events table; after: of the table of its rows."""

    def run(spark, sf_dir):
        ship(spark)
        out = S.run(plan(S.source(spark, f"{sf_dir}/events.parquet")), mode, f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}")
        out = after(out)
        return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in out.dtypes if t == "timestamp"} | {c: F.col(c).cast("long") for c, t in out.dtypes if t == "int"})

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


_stream("streaming_monthly", "SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS races, max(value) AS best FROM events GROUP BY 1, 2", lambda df: S.monthly(df, ["user_id"], "ts", "value"), "complete")
_stream("streaming_dedupe", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events", lambda df: S.unique(df.withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], "ts").select("user_id", "event_type", "day"), "append")
_stream("streaming_latest_flag", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1", lambda df: S.latest(df, ["user_id"], "ts", ["event_type"], "event_id"), "complete")
_stream("streaming_gravest", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END)::BIGINT AS severity FROM events GROUP BY 1", lambda df: S.gravest(df.withColumn("severity", F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)), ["user_id"], "severity"), "complete")
_stream("streaming_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM k GROUP BY user_id, n) SELECT * FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", lambda df: S.sessions(df, ["user_id"], "ts", "6 hours"), "append")
_stream("streaming_recent_windows", """WITH w AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP - INTERVAL (k) DAY AS start, value FROM events, (VALUES (0), (1)) AS s(k))
SELECT user_id, start, count(*) AS races, max(value) AS best FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""", lambda df: S.recent_windows(df, ["user_id"], "ts", "value", 2, "1 day"), "append")
_stream("streaming_availability", """WITH x AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN date_trunc('milliseconds', ts) END) AS flag, max(CASE WHEN event_type = 'purchase' THEN date_trunc('milliseconds', ts) END) AS back FROM events GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT user_id, CASE WHEN back > flag THEN 'cleared' WHEN flag + INTERVAL 3 DAY <= mark THEN 'expired' ELSE 'out' END AS standing, 'watch' AS status, (CASE WHEN back > flag THEN back WHEN flag + INTERVAL 3 DAY <= mark THEN flag + INTERVAL 3 DAY ELSE flag END)::TIMESTAMP AS at
FROM x, w WHERE flag IS NOT NULL""", lambda df: S.availability(df, "user_id", "ts", "event_id", F.when(F.col("event_type") == "error", F.lit("watch")), F.col("event_type") == "purchase", 3), "update", lambda rows: rows.groupBy("user_id").agg(F.max(F.struct("at", "standing", "status")).alias("x")).select("user_id", "x.standing", "x.status", "x.at"))


def streaming_corrections(spark, sf_dir):
    """A table by source and month; a stream delivers one source's months anew, and their partitions alone are replaced."""
    ship(spark)
    place = f"{shared_dir(spark)}/stream-corrections-{uuid.uuid4().hex}"
    rows = lambda df: df.select("event_id", F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM").alias("season"), "value")
    rows(S.timestamps(spark.read.parquet(f"{sf_dir}/events.parquet"))).repartition("source", "season").write.partitionBy("source", "season").parquet(f"{place}-table")
    late = rows(S.source(spark, f"{sf_dir}/events.parquet", 1 << 30)).where("source = 'error'").withColumn("value", F.col("value") * 2)  # a delivery is one batch
    S.run(late, "append", place, S.correction_batches(f"{place}-table", "source", "season"))
    return spark.read.schema(late.schema).parquet(f"{place}-table").select("event_id", "source", "season", "value")


QUERIES["streaming_corrections"] = streaming_corrections
ORACLES["streaming_corrections"] = "SELECT event_id, event_type AS source, strftime(ts, '%Y-%m') AS season, CASE WHEN event_type = 'error' THEN value * 2 ELSE value END AS value FROM events"
