import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from orewright.session import get_session

    session = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the smallest scale as views."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Compares a registered query with its SQL at the smallest scale, rows in any order."""

    def compare(query, sql):
        df = query(spark, f"{DATA}/sf0.001")
        columns = sorted(df.columns)
        got = sorted(repr(tuple(row.values())) for row in df.select(columns).toArrow().to_pylist())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())

    return compare
