"""Tables of intermediate rows in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one, on a single machine (tests) and there alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        app = context.applicationId
        found = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="meetlens-")
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them back.

    Executors can be lost at any time; what has been written need not be computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meetlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
