import glob
import os
import sys
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from graphweir.session import local_session

    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "tzinfo") and value.tzinfo:
        value = value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def same(df, relation):
    """Whether a DataFrame and a DuckDB relation hold the same columns and rows."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = Counter(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
