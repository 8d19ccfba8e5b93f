"""Every catalogued query against its SQL on the smallest tables."""

import duckdb
import pytest

from twinsieve import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert plain(tuple(r) for r in df.select(*order).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
