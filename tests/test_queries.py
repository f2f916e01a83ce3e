"""Queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from corvane.queries import ORACLES, QUERIES

from .conftest import SMALL

SLOW = {"graph_tag_links", "fts_stems", "fts_stemmed"}


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(cursor.fetchall(), columns)
