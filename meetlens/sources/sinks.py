"""Sinks: overwrite, append with de-duplication, source replacement, upserts, write-once and guarded report trees.

A table that is corrected is partitioned, by source and season or by a hash of its key; a correction rewrites the partitions it touches
by dynamic partition overwrite, and the other files stay as they are. At no time is there no table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlens.sources.readers import exists, readable
from meetlens.sources.shared import materialise

Keys = list[str]


def overwrite(df: DataFrame, path: str, partition: Keys = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


#: The partition column of tables that are rewritten by key, and how many partitions a new table has.
PART, PARTS = "__part", 64


def read(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A table of these sinks, without the partition column that is theirs; where there is none, no rows of like."""
    if not exists(spark, path):
        return like.limit(0)
    return spark.read.parquet(path).drop(PART)


def _dynamic(df: DataFrame, path: str, *partition: str) -> None:
    """Writes the partitions that df has rows of; the others keep their files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def _rewrite(new: DataFrame, path: str, key: Keys, parts: int, merge) -> None:
    """The partitions of the new rows' keys become merge(their old rows, the new rows); a key's partition follows from the key alone.

    The merged rows are written aside first, so that nothing is read from what is being replaced. A task that is run again, or a batch
    that a stream repeats, gives the same files.
    """
    spark = new.sparkSession
    rows = materialise(new.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")), "new-rows")
    touched = [r[0] for r in rows.select(PART).distinct().collect()]  # at most `parts` numbers
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col(PART).isin(touched)) if exists(spark, path) else rows.limit(0)
    merged = materialise(merge(old.drop(PART), rows.drop(PART)).withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")), "merged")
    _dynamic(merged.repartition(PART), path, PART)
    left = {r[0] for r in merged.select(PART).distinct().collect()}
    if set(touched) - left:  # partitions that lost their last row
        for part in set(touched) - left:
            merged.drop(PART).limit(0).write.mode("overwrite").parquet(f"{path}/{PART}={part}")
    spark.catalog.refreshByPath(path)


def append_unique(df: DataFrame, path: str, key: Keys, order: list[Column], parts: int = PARTS) -> None:
    """Old and new rows, the first by order of each key; an old row stays. Only partitions of the new keys are rewritten."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_b", *order))).where("_n = 1").drop("_n", "_b")

    _rewrite(df, path, key, parts, merge)


def source_replaced(old: DataFrame, new: DataFrame, source: str, own: str, season: str | None = None) -> DataFrame:
    """All rows but those of this source (of the seasons in the new rows), then the new rows."""
    mine = F.coalesce(F.col(source) == own, F.lit(False))
    if season is None:
        return old.where(~mine).unionByName(new, allowMissingColumns=True)
    kept = old.where(~mine).unionByName(old.where(mine).join(new.select(season).distinct(), season, "left_anti"))
    return kept.unionByName(new, allowMissingColumns=True)


def replace_source(new: DataFrame, path: str, source: str, own: str, season: str, whole: bool = False) -> None:
    """Late corrections to a table partitioned by source and season: the new rows' seasons of this source are replaced, and with whole
    all of this source. Other sources' and seasons' files are not touched, nor read. A table that cannot be read is an error.
    """
    spark = new.sparkSession
    if exists(spark, path) and not readable(spark, path):
        raise ValueError(f"{path} cannot be read and is not overwritten")
    if not re.fullmatch(r"[\w.-]+", own):
        raise ValueError(f"{own!r} is no name of a source")
    rows = materialise(new, "new-rows")
    if rows.where(~F.col(source).eqNullSafe(F.lit(own))).limit(1).count():
        raise ValueError(f"rows of other sources than {own}")
    if whole:
        rows.drop(source).repartition(season).write.mode("overwrite").partitionBy(season).parquet(f"{path}/{source}={own}")
    else:
        _dynamic(rows.repartition(season), path, source, season)
    spark.catalog.refreshByPath(path)


def upserted(old: DataFrame, new: DataFrame, key: Keys, required: str | None = None) -> DataFrame:
    """The newer row of each key; rows without the required value do not count."""
    rows = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    rows = rows if required is None else rows.where(F.col(required).isNotNull())
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_b")))).where("_n = 1").drop("_n", "_b")


def upsert(new: DataFrame, path: str, key: Keys, required: str | None = None, parts: int = PARTS) -> None:
    """The newer row of each key, in the table; only partitions of the new keys are rewritten."""
    _rewrite(new, path, key, parts, lambda old, rows: upserted(old, rows, key, required))


def report(df: DataFrame, path: str, name: Column) -> None:
    """One JSON document per row, in a folder named by it."""
    df.select(name.alias("report"), F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy("report").text(path)


def snapshots(df: DataFrame, path: str, group: str, slug: str, name: str) -> DataFrame:
    """One document per (group, slug); slugs that several names share are left out and returned."""
    w = Window.partitionBy(group, slug)
    marked = df.withColumn("_c", F.size(F.collect_set(name).over(w)))
    good = marked.where("_c = 1").drop("_c")
    if not good.limit(1).count():
        raise ValueError("nothing to write: the old snapshots stay")
    good.select(group, slug, F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy(group, slug).text(path)
    return marked.where("_c > 1").drop("_c")


def write_once(df: DataFrame, path: str, results: DataFrame | None = None, force: bool = False) -> None:
    """Fails if the snapshot exists, or results do already, unless forced."""
    if not force and results is not None and results.limit(1).count():
        raise ValueError("results exist already")
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def merged_snapshot(world: DataFrame, area: DataFrame, id_column: str, name: str, rank: str) -> DataFrame:
    """World rows unchanged, then area rows found in them neither by id nor by name, without a rank."""
    if world.columns != area.columns:
        raise ValueError("columns differ")
    key = lambda d: F.upper(F.trim(d[name]))
    rest = area.join(world.where(F.col(id_column).isNotNull()).select(id_column).distinct(), id_column, "left_anti")
    rest = rest.withColumn("_k", key(rest)).join(world.select(key(world).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return world.unionByName(rest.withColumn(rank, F.lit(None).cast(world.schema[rank].dataType)))


def lost_sections(old: DataFrame, new: DataFrame, section: str) -> DataFrame:
    """Sections that the new payload has no row of, or fewer rows than the old one."""
    a, b = old.groupBy(section).agg(F.count("*").alias("old_rows")), new.groupBy(section).agg(F.count("*").alias("new_rows"))
    return a.join(b, section, "left").withColumn("new_rows", F.coalesce("new_rows", F.lit(0))).where("new_rows < old_rows")


def carried_forward(new: DataFrame, old: DataFrame, key: Keys, columns: Keys) -> DataFrame:
    """The old payload's values of these columns where the new one lacks them."""
    was = old.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return new.join(was, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
