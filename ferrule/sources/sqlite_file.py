"""Tables in SQLite 3 files as a Spark data source, read in parallel by ranges of rowids.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite_file").option("path", file).option("table", name).load()

The file must lie where every executor can open it; one that only the driver can open is sent to them first:

    .option("path", ship_file(spark, file)).option("shipped", "true")

Tables WITHOUT ROWID are read as one range.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ferrule.functions.operators import affinity


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, kinds: list[str], partitions: int, shipped: bool = False) -> None:
        self.path, self.table, self.kinds, self.n, self.shipped = path, table, kinds, partitions, shipped

    def partitions(self) -> list[Range]:
        with _connect(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]
        if low is None:
            return [Range(0, 0)]  # an empty table; of an empty list Spark would make a partition None
        step = -(-(high - low + 1) // self.n)
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        where = "" if part.low is None else f" WHERE rowid >= {part.low} AND rowid < {part.high}"
        turn = {"bigint": lambda v: int(v) if isinstance(v, (int, float)) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None, "boolean": bool, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with _connect(SparkFiles.get(os.path.basename(self.path)) if self.shipped else self.path) as c:
            for row in c.execute(f"SELECT * FROM {_name(self.table)}{where}"):
                yield tuple(None if v is None else turn[k](v) for v, k in zip(row, self.kinds))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _columns(self) -> list[tuple[str, str]]:
        with _connect(self.options["path"]) as c:
            rows = c.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        return [(r[1], k if (k := affinity(r[2])) != "variant" else "string") for r in rows]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], [k for _, k in self._columns()], int(self.options.get("partitions", "8")), self.options.get("shipped", "").lower() == "true")


def write_table(df: DataFrame, path: str, table: str) -> int:
    """Write a frame as a table of a new or existing file, row by row through one writer: the format allows no other.

    For results of a size that one machine can hold; rows stream through the driver partition by partition.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "BOOLEAN"}
    with sqlite3.connect(path.removeprefix("file://")) as c:
        c.execute(f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(n)} {kinds.get(k, k)}' for n, k in df.dtypes)})")
        cursor = c.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))
        return cursor.rowcount


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine, as it is now, to all executors, later ones included; the path of the copy
    that Spark's file server sends and that goes with this process. Each machine holds the whole file.
    """
    d = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sent = os.path.join(d, f"{uuid.uuid4().hex}.db")  # names are unique in an application
    with _connect(path) as c, sqlite3.connect(sent) as copy:
        c.backup(copy)
    copy.close()
    spark.sparkContext.addFile(sent)
    return sent
