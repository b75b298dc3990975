"""SQLite files as a Spark data source on the standard library: ``spark.read.format("sqlite_table")``.

Options: ``path``, ``table``, ``partitions`` (ranges of rowid), ``where`` (a condition in SQLite's own words, which it applies
while it reads).  Comparisons that Catalyst pushes down become conditions too, so that SQLite's indexes serve them; Spark
applies them again.  Rows come in Arrow batches; what does not fit its column's type is null, and binary values of a text
column are read as text, but not found as such by a comparison.  Files are opened read-only; a store that another process
has locked is read from a copy of the file and its log in the worker's own folder.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

BATCH_ROWS = 4096
_TYPES = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def opened(path: str):
    """A connection that cannot write."""
    temp = None
    try:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=3)
        con.execute("PRAGMA query_only = 1")
        con.execute("SELECT count(*) FROM sqlite_master").fetchone()
    except sqlite3.Error:
        if not os.path.exists(path):
            raise
        temp = tempfile.mkdtemp()
        for end in ("", "-wal", "-shm"):
            if os.path.exists(path + end):
                shutil.copy(path + end, os.path.join(temp, "copy" + end))
        con = sqlite3.connect(os.path.join(temp, "copy"), timeout=3)
    try:
        yield con
    finally:
        con.close()
        if temp:
            shutil.rmtree(temp, ignore_errors=True)


def tables(path: str) -> list[str]:
    with opened(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


#: Values a condition may hold; SQLite's default allows more.
MOST_VALUES = 500
_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQLite's condition, with its values, for one of Catalyst's filters; None for what is left to Spark.

    Only columns declared as text or numbers take part, whose values compare in SQLite as they do in Spark.  Of text that
    a table's own collation orders otherwise, ranges are compared by bytes.
    """
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    kind = kinds.get(name)
    fits = {"string": str, "bigint": int, "double": (int, float)}.get(kind)
    if fits is None:
        return None
    c = quoted(name)
    ok = lambda v: isinstance(v, fits) and not isinstance(v, bool)
    if isinstance(f, (IsNull, IsNotNull)):
        # What does not fit its column's type is read as null.
        return (f"{c} IS NOT NULL", []) if isinstance(f, IsNotNull) else None
    if isinstance(f, In):
        return (f"{c} IN ({', '.join('?' * len(f.value))})", list(f.value)) if len(f.value) <= MOST_VALUES and all(map(ok, f.value)) else None
    if isinstance(f, StringStartsWith) and ok(f.value) and f.value:
        return f"substr({c}, 1, {len(f.value)}) = ?", [f.value]
    sign = _COMPARED.get(type(f))
    if sign is None or not ok(f.value):
        return None
    return f"{c} {sign} ?" + (" COLLATE BINARY" if kind == "string" and sign not in ("=", "IS") else ""), [f.value]


def columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) by SQLite's rules of affinity; names without a type are text."""
    with opened(path) as con:
        found = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    return [(r[1], next((t for k, t in _TYPES.items() if k in (r[2] or "").upper()), "string")) for r in found]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[tuple[str, str]], parts: int, where: str = ""):
        self.path, self.table, self.names, self.parts, self.where = path, table, names, parts, where
        self.pushed: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        with opened(self.path) as con:
            declared = {r[1]: (r[2] or "").upper() for r in con.execute(f"PRAGMA table_info({quoted(self.table)})")}
        kinds = {n: t for n, t in self.names if any(k in declared.get(n, "") for k in _TYPES)}
        self.pushed = [c for c in (condition(f, kinds) for f in filters) if c]
        return filters

    def partitions(self):
        with opened(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.Error:  # a view or a table without rowid
                return [_Range(0, -1)]
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        import pyarrow as pa

        kinds = {"bigint": (int, pa.int64()), "double": (float, pa.float64()), "string": (str, pa.string()), "binary": (bytes, pa.binary())}

        def fitting(value, kind):
            if value is None or type(value) is kind:
                return value
            if kind is int or isinstance(value, str):  # SQLite has made numbers of all that are whole ones, or look like numbers
                return str(value) if kind is str else None
            try:
                return value.decode("utf-8", "replace") if kind is str and isinstance(value, bytes) else kind(value)
            except (TypeError, ValueError):
                return None

        names = ", ".join(quoted(n) for n, _ in self.names)
        conditions = ([f"rowid BETWEEN {partition.low} AND {partition.high}"] if partition.low <= partition.high else []) + ([f"({self.where})"] if self.where else []) + [c for c, _ in self.pushed]
        schema = pa.schema([(n, kinds[t][1]) for n, t in self.names])
        with opened(self.path) as con:
            found = con.execute(f"SELECT {names} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(conditions)}" if conditions else ""), [v for _, values in self.pushed for v in values])
            while rows := found.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([fitting(v, kinds[t][0]) for v in c], kinds[t][1]) for c, (_, t) in zip(zip(*rows), self.names)], schema=schema)


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return ", ".join(f"`{n}` {t}" for n, t in columns(self.options["path"], self.options["table"]))

    def reader(self, schema: StructType):
        names = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        return _Reader(self.options["path"], self.options["table"], names, int(self.options.get("partitions", "4")), self.options.get("where", ""))


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 4, where: str = "") -> DataFrame | None:
    """A table of a SQLite file, or its rows that meet a condition; None if the file has none of that name."""
    if table.lower() not in (t.lower() for t in tables(path)):
        return None
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", str(partitions)).option("where", where).load()
