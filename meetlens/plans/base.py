"""Registration of queries with their SQL twins, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlens.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; whole numbers are returned as long, as the twin has them."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")}) if not df.isStreaming else df

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


# Stand-ins: an order is a race, its suppliers are the athletes, the price is the mark (higher is better).

PLACED_SQL = """
placed AS (SELECT race, athlete, v, rank() OVER (PARTITION BY race ORDER BY v DESC) AS place
           FROM (SELECT l_orderkey AS race, l_suppkey AS athlete, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)),
runs AS (SELECT race, athlete, v, place, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, o_orderpriority AS tier
         FROM placed JOIN orders ON o_orderkey = race)"""


def placed(t) -> DataFrame:
    """race, athlete, v, place. Dealt by race once: the aggregate, the window and later joins on the race need no other exchange."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("athlete"), F.col("l_extendedprice").alias("v")).repartition("race")
    best = rows.groupBy("race", "athlete").agg(F.max("v").alias("v"))
    return best.withColumn("place", F.rank().over(Window.partitionBy("race").orderBy(F.desc("v"))))


def runs(t) -> DataFrame:
    """placed with the race's date d, season y and tier."""
    o = t("orders").select(F.col("o_orderkey").alias("race"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("tier"))
    return placed(t).join(o, "race")


TOTALS_SQL = """
totals AS (SELECT o_orderkey AS id, o_custkey AS athlete, o_orderpriority AS grp, o_totalprice AS v,
                  CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders)"""


def totals(t) -> DataFrame:
    """Orders as marks: id, athlete (customer), grp (priority), v (price), d, y."""
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("athlete"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
