from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fathom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v) -> str:
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def equal_to_oracle(spark, duck, sf_dir):
    """Compares a query with its SQL as the driver does: columns by name, rows in any order."""

    def check(query, sql: str) -> None:
        df = query(spark, sf_dir)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall())
        got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
        assert got == want

    return check
