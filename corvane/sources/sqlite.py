"""Tables of SQLite files as a batch data source: ranges of row ids are partitions, and comparisons with values go to SQLite.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", path).option("table", "nodes").schema(...).load()

The file is read where it lies if a machine sees it there, else the copy that ship() sent to all of them."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Row ids of one partition, and rows of one Arrow batch.
RANGE, BATCH = 1 << 18, 1 << 13
SHIPPED = "shipped:"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(path: str) -> sqlite3.Connection:
    """The file, which nobody writes meanwhile."""
    if path.startswith(SHIPPED):
        path = SparkFiles.get(path.removeprefix(SHIPPED))
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def ship(spark: SparkSession, path: str) -> str:
    """A path of the file that all machines can read: its own on a local master, else that of a copy which Spark sends to each of them."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return path
    name = f"{uuid.uuid4().hex}.sqlite"
    own = f"{tempfile.mkdtemp()}/{name}"  # on the driver alone, to be sent under a name of its own
    shutil.copyfile(path, own)
    spark.sparkContext.addFile(own)
    return SHIPPED + name


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    first: int | None
    last: int | None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.range = int(options.get("range", RANGE))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes those that SQLite judges as Spark does; the others are given back. Only plain comparisons of texts and whole numbers are: SQLite has no types of its own for the rest."""
        known = {f.name: f.dataType.typeName() for f in self.schema}
        plain = lambda v, kind: isinstance(v, str) and kind == "string" or isinstance(v, int) and not isinstance(v, bool) and kind in ("integer", "long")
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            kind = known.get(name)
            if type(f) in COMPARED and plain(f.value, kind):
                self.where.append(f"{quoted(name)} {COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(plain(v, kind) for v in f.value):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, StringStartsWith) and plain(f.value, kind):
                self.where.append(f"substr({quoted(name)}, 1, ?) = ?")
                self.values += [len(f.value), f.value]
            elif isinstance(f, (IsNull, IsNotNull)) and kind:
                self.where.append(f"{quoted(name)} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
            else:
                yield f

    def partitions(self) -> list[Rows]:
        """Ranges of row ids; one partition for what has none, as a view."""
        with opened(self.path) as db:
            try:
                lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                lo = hi = None
        return [Rows(None, None)] if lo is None else [Rows(a, min(hi, a + self.range - 1)) for a in range(lo, hi + 1, self.range)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        where, values = list(self.where), list(self.values)
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        columns = ", ".join(quoted(f.name) for f in self.schema)
        with opened(self.path) as db:
            rows = db.execute(f"SELECT {columns} FROM {quoted(self.table)}{' WHERE ' + ' AND '.join(where) if where else ''}", values)
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([_column([r[i] for r in some], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """SQLite's values are of any type in any column: those that are not of the column's are turned into it, or null."""
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], kind)
    if pa.types.is_integer(kind):
        return pa.array([v if isinstance(v, int) else None for v in values], kind)
    return pa.array([v if isinstance(v, (int, float)) else None for v in values]).cast(kind)


class SqliteTable(DataSource):
    """Options: path, table, and range, the row ids of one partition. The schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self):
        raise ValueError("a schema is needed: SQLite's columns have no types")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def table(spark: SparkSession, path: str, name: str, schema: str, rows: int = RANGE):
    """A table of a file on the driver, read by all tasks. Turns the pushing of filters to Python sources on in the session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", ship(spark, path)).option("table", name).option("range", rows).schema(schema).load()
