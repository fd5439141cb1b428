"""Every registered query against its SQL on the same tables."""

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


OWN = [query.__name__ for query in entry.QUERIES]


@pytest.fixture(scope="module")
def tables(testdata):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{testdata}/sf0.001/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(OWN) == set(entry._own_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, tables, testdata, name):
    got = entry.queries()[name](spark, f"{testdata}/sf0.001")
    want = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    expected = sorted(repr(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in got.collect()) == expected
    assert expected


def test_entry_finds_the_known_duplicates(spark):
    found = entry.entry(spark)
    assert found.count() == 21
    assert found.select("hash").distinct().count() == 10
