import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain_rows(names, rows):
    """Rows as sorted text, with columns by name and floats rounded."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted(str([value(r[i]) for i in order]) for r in rows)


def same_as_duck(frame, con, sql):
    found = con.sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    got = plain_rows(frame.columns, [tuple(r) for r in frame.collect()])
    want = plain_rows(found.columns, found.fetchall())
    assert got == want
    return len(got)
