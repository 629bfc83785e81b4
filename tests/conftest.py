"""One local Spark session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def comparable(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def same_rows(frame, relation) -> None:
    """The frame's rows are those of the DuckDB relation, columns by name, in any order."""
    names = sorted(relation.columns)
    assert sorted(frame.columns) == names
    at = [relation.columns.index(c) for c in names]
    expected = sorted((tuple(comparable(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    found = sorted((tuple(comparable(r[c]) for c in names) for r in frame.collect()), key=repr)
    assert found == expected
