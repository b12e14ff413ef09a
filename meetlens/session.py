"""Making the package known to Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, unless their path has it (PYTHONPATH or the working folder)."""
    root = Path(__file__).resolve().parent.parent
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "meetlens_package"), "zip", root, "meetlens")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
