"""Every query against its SQL in DuckDB: names, row counts and values."""

import duckdb
import pytest

from foldlake import queries as own

from .conftest import SF

SQL = own.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, at):
    """Rows as sortable text; floats to 9 digits."""
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    got = own.queries()[name](spark, SF)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    values = want.fetchall()
    assert plain(rows, [got.columns.index(c) for c in names]) == plain(values, [want.columns.index(c) for c in names])
