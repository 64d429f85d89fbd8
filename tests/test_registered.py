"""Every registered query of the core against its SQL in DuckDB."""

import duckdb
import pytest

from folioscope.plans.registered import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(v):
    if v is None or v != v:
        return "\0"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert got == want


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
