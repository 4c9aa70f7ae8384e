"""Every registered query of the reference's own operators against its SQL in DuckDB, or for rows where it has none."""

import duckdb
import pytest

from vidlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(table):
    names = sorted(table.column_names)
    return sorted(map(str, zip(*(table.column(n).to_pylist() for n in names)))), names


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows > 0
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).to_arrow_table()
        assert plain(got) == plain(want)
