"""Shared fixtures: one local session for all tests, and DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

TESTDATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_conf(name, value):
        before.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield set_conf
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def duck():
    """Return a function that opens DuckDB with a view per table of a data directory."""
    connection = duckdb.connect()

    def over(data_dir):
        for name in TABLES:
            path = f"{data_dir}/{name}.parquet"
            connection.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}'")
        return connection

    yield over
    connection.close()
