"""SQLite files as a Spark data source: read in ranges of rowids, written a file a task.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", "/shared/old.db").option("table", "games").load()
    df.write.format("sqlite").option("path", "/shared/out").option("table", "games").mode("append").save()

``path`` is a file, or a folder whose files (*.sqlite, *.db) are read as one table. Every executor
opens the files itself, so they must be on a mount that all machines see; where they aren't,
``shipped`` names a file sent with SparkContext.addFile. Planning asks each file for its least and
greatest rowid and leaves ranges without a row out; rows go straight from a range to its task. With
the option ``tasks`` (which ``sqlite_table`` sets by the cluster's cores) a task reads several ranges,
one after the other, where there are more ranges than that.
Tables without rowids, and views, are one range. The files must not change while they are read.

SQLite types values, not columns: all columns come as text, for ``typed`` to cast. With
spark.sql.python.filterPushdown.enabled (and the option ``pushed``, which ``sqlite_table`` sets by
it), comparisons of columns with texts, IN and null checks are made by SQLite as well, and again by Spark.

A write makes one file a task below ``path`` and shows them together when all have ended: names of
unfinished files begin with a dot, which reading passes over. Files of lost attempts are removed.
"""

from __future__ import annotations

import contextlib
import glob
import itertools
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

#: Rows of a range at most (by its rowids), ranges of a file at most, and rows fetched together.
RANGE_ROWS, MOST_RANGES, FETCHED = 200_000, 4_096, 8_192
#: Tasks that ``sqlite_table`` reads by at most, for each core.
TASKS_A_CORE = 4


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(file: str) -> sqlite3.Connection:
    conn = sqlite3.connect(f"file:{file.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
    conn.text_factory = lambda b: b.decode("utf-8", "replace")
    return conn


def as_texts(column: tuple) -> pa.Array:
    """A column of values as texts; whole numbers, and what is valid UTF-8, without a step for each."""
    kinds = set(map(type, column)) - {type(None)}
    try:
        if kinds == {int}:
            return pa.array(column, pa.int64()).cast(pa.string())
        if kinds == {bytes}:
            return pa.array(column, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        pass
    return pa.array([as_text(v) for v in column], pa.string())


def local_path(path: str) -> str:
    """A mounted path, also one written as file:/... or file:///..."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def files_of(options) -> list[str]:
    if shipped := options.get("shipped"):
        from pyspark import SparkFiles

        return [SparkFiles.get(shipped)]
    path = local_path(options["path"])
    if os.path.isdir(path):
        return sorted(f for kind in ("*.sqlite", "*.db") for f in glob.glob(os.path.join(glob.escape(path), kind)))
    if not os.path.exists(path):
        raise FileNotFoundError(f"no SQLite file or folder at {path}")
    return [path]


def tables_of(file: str) -> set[str]:
    with contextlib.closing(opened(file)) as conn:
        return {r[0] for r in conn.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}


def columns_of(file: str, table: str) -> list[str]:
    with contextlib.closing(opened(file)) as conn:
        return [r[1] for r in conn.execute(f"PRAGMA table_info({quoted(table)})")]


def as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


@dataclass
class Range(InputPartition):
    """Rowids from ``low`` up to, without, ``high``; both None: the whole table."""

    file: str
    low: int | None
    high: int | None

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]

    def __post_init__(self):
        super().__init__(None)


def dealt(ranges: list[Range], tasks: int | None) -> list[Ranges]:
    """The ranges in ``tasks`` even stretches at most; None: each by itself."""
    n = len(ranges) if tasks is None else min(tasks, len(ranges))
    return [Ranges(ranges[i * len(ranges) // n : (i + 1) * len(ranges) // n]) for i in range(n)]


def ranges_of(file: str, table: str, rows: int, most: int) -> list[Range]:
    with contextlib.closing(opened(file)) as conn:
        name = quoted(table)
        try:
            least, greatest = conn.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
        except sqlite3.OperationalError:
            return [Range(file, None, None)]
        if not isinstance(least, int):  # an empty table; or a view, whose rowid is null or a value of its own
            return [Range(file, None, None)] if conn.execute(f"SELECT 1 FROM {name} LIMIT 1").fetchone() else []
        step = max(rows, -(-(greatest - least + 1) // most))
        out, at = [], least
        while at is not None:
            out.append(Range(file, at, at + step))
            at = conn.execute(f"SELECT min(rowid) FROM {name} WHERE rowid >= ?", (at + step,)).fetchone()[0] if at + step <= greatest else None
        return out


class SqliteReader(DataSourceReader):
    where: list[str] = []
    values: list = []

    def __init__(self, options, schema: T.StructType):
        self.options, self.schema = dict(options), schema


    def partitions(self) -> list[Ranges]:
        rows, most = int(self.options.get("rangerows", RANGE_ROWS)), int(self.options.get("mostranges", MOST_RANGES))
        table, tasks = self.options["table"], self.options.get("tasks")
        found = [r for file in files_of(self.options) if table in tables_of(file) for r in ranges_of(file, table, rows, most)]
        return dealt(found, tasks and max(1, int(tasks)))

    def read(self, part: Ranges | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark plans one task where there are no ranges
            return
        for file, ranges in itertools.groupby(part.ranges, key=lambda r: r.file):
            with contextlib.closing(opened(file)) as conn:
                conn.text_factory = bytes
                present = set(columns_of(file, self.options["table"]))
                for r in ranges:
                    yield from self._read(conn, present, r)

    def _read(self, conn: sqlite3.Connection, present: set[str], part: Range) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        shown = [quoted(n) if n in present else "NULL" for n in names]  # a column that this file lacks is null
        lacks = {quoted(n) for n in names if n not in present}
        where, values = [w for w in self.where if not any(x in w for x in lacks)], list(self.values)
        if len(where) < len(self.where):
            where, values = [], []
        if part.low is not None:
            where, values = ["rowid >= ?", "rowid < ?", *where], [part.low, part.high, *values]
        sql = f"SELECT {', '.join(shown)} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        cursor = conn.execute(sql, values)
        while rows := cursor.fetchmany(FETCHED):
            yield pa.RecordBatch.from_arrays([as_texts(c) for c in zip(*rows, strict=True)], names=names)


class FilteringReader(SqliteReader):
    """Takes Spark's filters too, which Spark allows only where it is told to push them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Adds what SQLite can check too; Spark checks all of them again."""
        self.where, self.values = [], []
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1:
                as_shown = f"CAST({quoted(column[0])} AS TEXT)"
                if isinstance(f, EqualTo) and isinstance(f.value, str):
                    self.where.append(f"{as_shown} = ?")
                    self.values.append(f.value)
                elif isinstance(f, In) and f.value and all(isinstance(v, str) for v in f.value) and len(f.value) <= 500:
                    self.where.append(f"{as_shown} IN ({', '.join('?' * len(f.value))})")
                    self.values += f.value
                elif isinstance(f, (IsNull, IsNotNull)):
                    self.where.append(f"{quoted(column[0])} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            yield f


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class SqliteWriter(DataSourceWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = dict(options), schema, overwrite
        self.folder = local_path(self.options["path"])
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        file = os.path.join(self.folder, f".{self.run}-{uuid.uuid4().hex}.sqlite")
        table, names = quoted(self.options["table"]), [quoted(f.name) for f in self.schema]
        n = 0
        with contextlib.closing(sqlite3.connect(file)) as conn:
            conn.execute("PRAGMA journal_mode = OFF")
            conn.execute(f"CREATE TABLE {table} ({', '.join(names)})")
            insert = f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})"
            some: list[tuple] = []
            plain = all(isinstance(f.dataType, (T.StringType, T.IntegralType, T.FractionalType, T.BinaryType)) and not isinstance(f.dataType, T.DecimalType) for f in self.schema)

            def put():
                nonlocal n
                conn.executemany(insert, some)
                n += len(some)
                some.clear()

            for row in rows:
                some.append(tuple(row) if plain else tuple(v if v is None or isinstance(v, (int, float, str, bytes)) and not isinstance(v, bool) else int(v) if isinstance(v, bool) else str(v) for v in row))
                if len(some) >= FETCHED:
                    put()
            put()
            conn.commit()
        return Written(file, n)

    def commit(self, messages) -> None:
        done = {m.file for m in messages if m is not None}
        before = files_of(self.options) if self.overwrite and os.path.isdir(self.folder) else []
        for file in done:
            head, name = os.path.split(file)
            os.replace(file, os.path.join(head, name[1:]))
        for file in before:
            os.remove(file)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for file in glob.glob(os.path.join(glob.escape(self.folder), f".{self.run}-*")):
            with contextlib.suppress(FileNotFoundError):
                os.remove(file)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        """All columns that any of the files has, in order of first sight, as text."""
        table = self.options["table"]
        seen = dict.fromkeys(c for file in files_of(self.options) if table in tables_of(file) for c in columns_of(file, table))
        return T.StructType([T.StructField(c, T.StringType()) for c in seen])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return (FilteringReader if self.options.get("pushed") == "true" else SqliteReader)(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options, schema, overwrite)


def sqlite_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    options = {"tasks": TASKS_A_CORE * spark.sparkContext.defaultParallelism} | options
    return spark.read.format("sqlite").options(path=path, table=table, pushed=pushed, **options).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").option("path", path).option("table", table).mode(mode).save()


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts as the types of ``schema``; what isn't of its column's type is null. Columns of the
    schema alone, in its order, those that ``raw`` has."""
    have = set(raw.columns)

    def cast(f: T.StructField):
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            return F.try_to_timestamp(f.name).cast(f.dataType).alias(f.name)
        return F.col(f.name).try_cast(f.dataType).alias(f.name)

    return raw.select([cast(f) for f in schema if f.name in have])
