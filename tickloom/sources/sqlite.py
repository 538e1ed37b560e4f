"""Tables of SQLite files as DataFrames, read in ranges of rowids."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: Rows that a read fetches at a time.
BATCH = 10_000


def _open(path: str) -> Any:
    import sqlite3
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _has(db: Any, table: str) -> bool:
    return db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone() is not None


def _type(declared: str) -> DataType:
    """Spark's type for a declared one, by SQLite's rules of affinity; numeric columns become doubles."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")) or not kind:
        return StringType()
    return BinaryType() if "BLOB" in kind else DoubleType()


def _value(x: Any, kind: DataType) -> Any:
    """x as the column's type, null where it is none: SQLite lets any value into any column."""
    if x is None:
        return None
    if isinstance(kind, BinaryType):
        return x if isinstance(x, bytes) else str(x).encode()
    if isinstance(kind, StringType):
        return x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)
    if not isinstance(x, (int, float)):
        return None
    return float(x) if isinstance(kind, DoubleType) else int(x) if float(x).is_integer() else None


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.count = int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowids of equal length; none for a table that is missing or empty."""
        with _open(self.path) as db:
            if not _has(db, self.table):
                return []
            # SQLite takes a quoted name that is no column for a text
            known = {row[1].lower() for row in db.execute(f"PRAGMA table_info({_quoted(self.table)})")}
            if missing := [f.name for f in self.schema if f.name.lower() not in known]:
                raise ValueError(f"{self.table} has no columns {missing}")
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // max(1, self.count))
        return [Rows(start, min(high, start + step - 1)) for start in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple[Any, ...]]:
        if partition is None:
            return
        kinds = [f.dataType for f in self.schema]
        with _open(self.path) as db:
            db.text_factory = bytes
            wanted = ", ".join(_quoted(f.name) for f in self.schema)
            rows = db.execute(f"SELECT {wanted} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            while batch := rows.fetchmany(BATCH):
                for row in batch:
                    yield tuple(_text(x, k) for x, k in zip(row, kinds, strict=True))


def _text(x: Any, kind: DataType) -> Any:
    """A value as it was stored: texts come as bytes, so that broken ones don't end the read."""
    return x if isinstance(x, bytes) and isinstance(kind, BinaryType) else _value(x, kind)


class SqliteSource(DataSource):
    """spark.read.format("sqlite_table") with options path, table and partitions (8).

    The file must be one that driver and executors see. Without a schema it comes from the table's declaration, and a
    missing table is an error; with one, only its columns are read, and a missing table has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        path, table = self.options["path"], self.options["table"]
        with _open(path) as db:
            if not _has(db, table):
                raise ValueError(f"{path} has no table {table}")
            declared = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        return StructType([StructField(name, _type(kind or "")) for _, name, kind, *_ in declared])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def require_tables(path: str, *tables: str) -> None:
    """An error that names all missing tables of a file."""
    with _open(path) as db:
        if missing := [t for t in tables if not _has(db, t)]:
            raise ValueError(f"{path} has no tables {sorted(missing)}")


def read_table(spark: SparkSession, path: str, table: str, schema: str | None = None, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file; ``schema`` names the columns to read and lets the table be missing."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema else reader).load()
