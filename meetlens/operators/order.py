"""Exact places of rows in an order, and exact ranks inside groups, however few the groups are.

A window over a handful of groups sorts each in one task. Here rows are dealt by ranges of their keys, so a large group is split over
tasks; each task knows its rows' places among its own, and the sizes of the tasks before it (a row for each task and group) give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlens.sources.shared import materialise

#: Column names of this module's own; tables may hold any others.
_AT, _TASK, _BEFORE, _SALT = "__at", "__task", "__before", "__salt"


def numbered(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """df with its rows' places from 0 (long) in the order of keys (ascending, null first); the rows are written once.

    Rows with equal keys get neighbouring places in no stated order. What passes the driver is a number for each task.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    kept = materialise(dealt, "numbered").withColumn(_TASK, F.shiftright(_AT, 33))
    offsets, before = [], 0
    for task, n in sorted((r[_TASK], r["count"]) for r in kept.groupBy(_TASK).count().collect()):
        offsets.append((task, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, f"{_TASK} long, {_BEFORE} long")
    placed = kept.join(F.broadcast(starts), _TASK)  # a row for each task
    return placed.select(*df.columns, (F.col(_BEFORE) + F.col(_AT).bitwiseAND((1 << 33) - 1)).alias(name))


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to b on equal keys, null with null; b's keys go."""
    other = b.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return a.join(other, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], how).drop(*(f"__of_{k}" for k in keys))


def _standings(counts: DataFrame, groups: list[str], v: str, below: str, ties: str, size: str) -> DataFrame:
    """_TASK, groups, v, below, ties, size from counts (_TASK, groups, v, __n) that were dealt by ranges of groups and v."""
    sums = counts.groupBy(_TASK, *groups).agg(F.sum("__n").alias("__sum"))
    along = Window.partitionBy(*groups).orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the group
    starts = sums.select(_TASK, *groups, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias(_BEFORE), F.sum("__sum").over(Window.partitionBy(*groups)).alias(size))
    inside = Window.partitionBy(_TASK, *groups).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_null_safe(counts.withColumn(_AT, F.coalesce(F.sum("__n").over(inside), F.lit(0))), starts, [_TASK, *groups])
    same = Window.partitionBy(*groups, v)  # a row for each task that holds the value
    return placed.select(_TASK, *groups, v, F.min(F.col(_AT) + F.col(_BEFORE)).over(same).alias(below), F.sum("__n").over(same).alias(ties), size)


def with_standing(df: DataFrame, groups: list[str], value: Column, below: str = "below", ties: str = "ties", size: str = "size") -> DataFrame:
    """Adds three longs: the rows of the same group with a smaller value, with the same one, and all; null is below any value.

    Rows are dealt by ranges of group and value, those with equal values too (by a salt), and written once. From there on only a row
    for each task and value moves, but for one join of the rows to them, whose key has the task.
    """
    v, salt = "__value", F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(1 << 20))
    salted = df.withColumns({v: value, _SALT: salt}).repartitionByRange(*groups, v, _SALT)
    dealt = materialise(salted.withColumn(_TASK, F.spark_partition_id()).drop(_SALT), "standing")
    known = _standings(dealt.groupBy(_TASK, *groups, v).agg(F.count("*").alias("__n")), groups, v, below, ties, size)
    return join_null_safe(dealt, known, [_TASK, *groups, v]).drop(_TASK, v)


def standings(df: DataFrame, groups: list[str], value: Column, name: str = "value") -> DataFrame:
    """groups, the value, below, ties, size: each distinct value of each group, how many rows are smaller and equal, and the group's rows.

    Values are counted before they move and their counts dealt by ranges, so a group of any size is split; null values do not count.
    """
    counts = df.where(value.isNotNull()).groupBy(*groups, value.alias(name)).agg(F.count("*").alias("__n"))
    dealt = materialise(counts.repartitionByRange(*groups, name).withColumn(_TASK, F.spark_partition_id()), "counts")
    return _standings(dealt, groups, name, "below", "ties", "size").drop(_TASK)


def share_at_most(probes: DataFrame, df: DataFrame, groups: list[str], value: Column, probe: str, name: str) -> DataFrame:
    """probes with name: the share of the rows of their group whose value is the probe's at most; null for a group without values.

    A probe meets the running count at the last value that is not above it (latest_before): no pairs of probes and values.
    """
    known = materialise(standings(df, groups, value.cast("double"), "__v"), "standings")
    ends = known.select(*groups, F.struct(F.col("__v").alias("v"), (F.col("below") + F.col("ties")).alias("c")).alias("__at"))
    asked = probes.withColumn("__at", F.struct(F.col(probe).cast("double").alias("v"), F.lit((1 << 63) - 1).alias("c")))
    met = latest_before(asked, ends, groups, "__at", "__x")
    sizes = known.groupBy(*groups).agg(F.max("size").alias("__size"))
    sized = met.join(sizes, groups, "left") if groups else met.crossJoin(F.broadcast(sizes))  # one row
    return sized.withColumn(name, F.coalesce(F.col("__x.c"), F.lit(0)) / F.col("__size")).drop("__at", "__x", "__size")


def quantiles(df: DataFrame, groups: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """groups and a double for each name in shares: that quantile of the group's values, exact, between neighbours by their distance.

    Read from `standings`: null values do not count, and a group without values has no row.
    """
    known = standings(df, groups, value.cast("double"), "__v")

    def read(share: float) -> Column:
        at = F.lit(float(share)) * (F.max("size") - 1)
        # the value at a whole place is the largest one with that many or fewer below it
        low, high = (F.max(F.when(F.col("below") <= whole(F.lit(float(share)) * (F.col("size") - 1)), F.col("__v"))) for whole in (F.floor, F.ceil))
        return low + (high - low) * (at - F.floor(at))

    return known.groupBy(*groups).agg(*(read(share).alias(name) for name, share in shares.items()))


def latest_before(asked: DataFrame, known: DataFrame, groups: list[str], at: str, name: str) -> DataFrame:
    """asked with name: the largest `at` of known's rows of the same group that is below its own; null if there is none.

    Both are one table, dealt by ranges of group and `at`, so a group of any size is split. A running maximum inside each task meets
    that of the tasks before it (a row for each task and group): no rows of asked and known are paired. `at` may be a struct.
    """
    payload, kind, task, best, carried = "__payload", "__kind", _TASK, "__best", "__carried"
    mine = asked.select(*groups, at, F.lit(0).alias(kind), F.struct(*asked.columns).alias(payload))
    theirs = known.select(*groups, at).distinct().select(*groups, at, F.lit(1).alias(kind), F.lit(None).cast(mine.schema[payload].dataType).alias(payload))
    dealt = materialise(mine.unionByName(theirs).repartitionByRange(*groups, at, kind).withColumn(task, F.spark_partition_id()), "before")
    value = F.when(F.col(kind) == 1, F.col(at))
    ends = dealt.groupBy(task, *groups).agg(F.max(value).alias(best))
    along = Window.partitionBy(*groups).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the group
    carry = ends.select(task, *groups, F.max(best).over(along).alias(carried)).where(F.col(carried).isNotNull())
    inside = Window.partitionBy(task, *groups).orderBy(at, kind).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn(best, F.max(value).over(inside)).where(F.col(kind) == 0).select(task, *groups, payload, best)
    return own.join(carry, [task, *groups], "left").select(f"{payload}.*", F.coalesce(best, carried).alias(name))
