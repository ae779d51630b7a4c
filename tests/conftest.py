"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers import the library from the same place.
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Compare a registered query with its oracle on one of the data folders."""
    import duckdb

    def rows(columns, values):
        def plain(x):
            return round(x, 9) if isinstance(x, float) else x

        order = sorted(range(len(columns)), key=columns.__getitem__)
        return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in values)

    def run(query, sql, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in "documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got = query(spark, sf_dir)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())

    return run
