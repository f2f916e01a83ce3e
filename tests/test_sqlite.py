"""The SQLite data source: partitions by row ids, filters judged by SQLite, values of other types, tables without row ids."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from corvane.operators import codegraph
from corvane.sources import graphs, sqlite

SCHEMA = "k long, name string, flag boolean, w double"


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('create table "a ""table" (k, name, flag, w)')
        db.executemany('insert into "a ""table" values (?, ?, ?, ?)', [(k, f"n{k % 7}é", k % 2, k / 2) for k in range(1000)] + [("text", 5, None, "no"), (None, None, 1, 2), (1001, b"by\xff", 0, 1)])
        db.execute("create table bare (k integer primary key, name) without rowid")
        db.executemany("insert into bare values (?, ?)", [(k, str(k)) for k in range(5)])
        db.execute("create table none (k, name)")
        db.execute("create view seen as select k, name from bare where k > 1")
    db.close()
    return path


def test_rows(spark, file):
    df = sqlite.table(spark, file, 'a "table', SCHEMA, 100)
    assert df.rdd.getNumPartitions() == 11 and df.count() == 1003
    rows = df.collect()
    assert sorted(r.k for r in rows if r.k is not None) == [*range(1000), 1001] and {r.name for r in rows if r.k in (None, 1001)} == {None, "5", "by�"}
    assert all(r.flag == bool(r.k % 2) and r.w == r.k / 2 for r in rows if r.k is not None and r.k < 1000)
    for name, n in (("bare", 5), ("none", 0), ("seen", 3)):
        assert sqlite.table(spark, file, name, "k long, name string").count() == n


def test_filters(spark, file):
    """The same rows with and without them, and SQLite gives no others."""
    df = sqlite.table(spark, file, 'a "table', SCHEMA, 300)
    got = df.where("k > 900 and name = 'n3é' and flag").select("k").collect()
    assert sorted(r.k for r in got) == [k for k in range(901, 1000) if k % 7 == 3 and k % 2]
    assert df.where(F.col("name").startswith("n1") & F.col("k").isin(1, 8, 9)).count() == 2 and df.where("name like '%é' and w >= 499").count() == 2
    reader = sqlite.Reader(StructType.fromDDL(SCHEMA), {"path": file, "table": 'a "table', "range": "100"})
    kept = list(reader.pushFilters([GreaterThan(("k",), 950), EqualTo(("flag",), True), StringStartsWith(("name",), "n2"), StringEndsWith(("name",), "é"), In(("k",), (954, 955, 961)), IsNotNull(("name",)), EqualTo(("w",), 1.5)]))
    assert [type(f).__name__ for f in kept] == ["EqualTo", "StringEndsWith", "EqualTo"]
    assert [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()] == [954, 961]


def test_code_graph(spark, tmp_path):
    path = str(tmp_path / "graph.db")
    names = ["handle", "process", "charge", "audit"]
    with sqlite3.connect(path) as db:
        db.execute("create table nodes(kind, name, qualified_name, file_path, line_start, line_end, language, is_test)")
        db.execute("create table edges(kind, source_qualified, target_qualified)")
        db.executemany("insert into nodes values ('F', ?, ?, 'f.py', ?, ?, 'py', ?)", [(n, f"p.{n}", k, k + 1, k % 2) for k, n in enumerate(names)])
        db.executemany("insert into edges values ('CALLS', ?, ?)", [(f"p.{a}", f"p.{b}") for a, b in zip(names, names[1:])])
    db.close()
    nodes, edges = graphs.code_graph(spark, path)
    assert [r.name for r in codegraph.callers(nodes, edges, "p.charge").collect()] == ["process"] and {r.name for r in nodes.where("is_test").collect()} == {"process", "audit"}
