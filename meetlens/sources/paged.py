"""A data source over lists that come in numbered pages: `spark.read.format("pages")`.

A list (a month of a calendar, an area's toplist) is a folder `list=NAME` with folders `page=0`, `page=1`, ... of JSON lines, in any
store that Arrow reads. Each list is a partition: its pages are read in order until one is missing, empty or short, each with retries.
So lists are read side by side, and no page behind the end of a list is touched.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a full page, attempts at a page, seconds between them; share of rows that may lie outside their area.
SIZE, ATTEMPTS, PAUSE, MOST_OUTSIDE = 100, 3, 0.2, 0.05


class PageSource(DataSource):
    """Options: path, size (rows of a full page), attempts, pause, strict (false: a list whose page cannot be read ends there).

    The schema is the caller's; `list` (string) and `page` (int) may be among its columns. Missing fields are null.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "list string, page int, value string"

    def reader(self, schema) -> PageReader:
        return PageReader(schema, dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.path, self.size = options["path"].rstrip("/"), int(options.get("size", SIZE))
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))
        self.strict = options.get("strict", "true").lower() != "false"

    def store(self):
        """The store and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{quote(self.path)}")

    def folders(self, below: str, prefix: str) -> dict[str, str]:
        """The folders prefix=NAME below a folder of the path, by name."""
        from pyarrow import fs

        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"), allow_not_found=True))
        return {unquote(x.base_name[len(prefix) + 1 :]): x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{prefix}=")}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(item) for item in sorted(self.folders("", "list").items())] or [InputPartition(None)]

    def lines(self, page: str) -> list[str]:
        """The lines of a page's files, in the order of their names."""
        from pyarrow import fs

        store, root = self.store()
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{root}/{page}")) if x.is_file and not x.base_name.startswith(("_", ".")))
        out: list[str] = []
        for file in found:
            with store.open_input_stream(file) as f:
                out += [x for x in f.read().decode().split("\n") if x.strip()]
        return out

    def rows(self, page: str) -> list[dict]:
        """A page's rows; tried again where the store fails or a row is broken."""
        for attempt in range(self.attempts):
            try:
                return [json.loads(x) for x in self.lines(page)]
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * (attempt + 1))
        return []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name, folder = partition.value
        pages = self.folders(folder, "page")
        for page in range(len(pages)):
            if str(page) not in pages:
                return
            try:
                rows = self.rows(f"{folder}/{pages[str(page)]}")
            except (OSError, ValueError):
                if self.strict:
                    raise
                return
            for row in rows:
                own = {"list": name, "page": page} | row
                yield tuple(own.get(c) if kind != "string" or own.get(c) is None else str(own[c]) for c, kind in self.columns)
            if len(rows) < self.size:
                return


def register(spark: SparkSession) -> None:
    """Makes the format known; the classes travel by value, so executors need not have the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PageSource)


def pages(spark: SparkSession, path: str, schema: str, size: int = SIZE, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("pages").schema(schema).options(path=path, size=str(size), **options).load()


def checked(rows: DataFrame, key: str, order: list[Column], outside: Column | None = None, most_outside: float = MOST_OUTSIDE) -> DataFrame:
    """Rows unique by key, the first by order; reading them fails if too large a share lies outside their area."""
    once = rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("__x")).select(key, "__x.*").select(*rows.columns)
    if outside is None:
        return once
    share = rows.agg(F.coalesce(F.avg(F.coalesce(outside, F.lit(True)).cast("double")), F.lit(0.0)).alias("__share"))
    guarded = share.select(F.when(F.col("__share") > most_outside, F.raise_error(F.concat(F.lit("share of rows outside the area: "), F.col("__share").cast("string"))).cast("boolean")).otherwise(True).alias("__fine"))
    return once.crossJoin(F.broadcast(guarded)).where("__fine").drop("__fine")  # one row


def at_the_cap(rows: DataFrame, cap: int) -> DataFrame:
    """list, n: lists that have as many rows as the source gives at most, and may have lost some."""
    return rows.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") >= cap)
