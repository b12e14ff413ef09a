"""Every query with a SQL twin returns the twin's rows; the others return rows with unique column names."""

import glob
import math
import os

import duckdb
import pytest

from meetlens.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    if isinstance(x, int) and not isinstance(x, bool):
        return repr(float(x))
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x).replace(" 00:00:00", "")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        found = db.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_enough_twins():
    assert len(ORACLES) >= 100 and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    run = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", run], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120).returncode == 0
