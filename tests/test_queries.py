"""Every query that has SQL, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tagloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == expected and expected
