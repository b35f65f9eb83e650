import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lodestone.session import configured

    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
    session = configured(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import glob

    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


def plain(v):
    """A value as text, for comparing rows of two engines."""
    if v is None or v != v:
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, sf)
        ours = row_set(df.columns, [tuple(r) for r in df.collect()])
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = row_set(names, cursor.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert ours == theirs
        return len(ours)

    return check
