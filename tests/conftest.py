import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(df, connection, sql):
    """Rows and columns of a Spark result and of SQL, in any order."""
    columns = sorted(df.columns)
    ours = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=lambda t: tuple(map(str, t)))
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [tuple(rounded(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert ours == sorted(theirs, key=lambda t: tuple(map(str, t)))
