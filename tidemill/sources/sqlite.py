"""SQLite tables through Spark's Python data source API, split by row id."""

from __future__ import annotations

import json
import re
import sqlite3
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.errors import MissingSource
from tidemill.sources.sqlite_ranges import read_in_ranges
from tidemill.sources.storage import is_local, local_path, open_input

ROWS_PER_PARTITION = 250_000
BATCH_ROWS = 10_000
#: Ranges of row ids one file is read in, at most.
MAX_PARTITIONS = 4096

# Fragments of declared SQLite types, tried in this order, and the Spark type read.
_DECLARED = (
    ("bool", T.BooleanType()),
    ("int", T.LongType()),
    ("char", T.StringType()),
    ("clob", T.StringType()),
    ("text", T.StringType()),
    ("real", T.DoubleType()),
    ("floa", T.DoubleType()),
    ("doub", T.DoubleType()),
    ("datetime", T.TimestampNTZType()),
    ("timestamp", T.TimestampNTZType()),
    ("date", T.DateType()),
    ("blob", T.BinaryType()),
)
_DECIMAL = re.compile(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)")


def spark_type(declared: str) -> T.DataType:
    name = (declared or "").lower()
    decimal = _DECIMAL.search(name)
    if decimal:
        return T.DecimalType(int(decimal.group(1)), int(decimal.group(2) or 0))
    if "decimal" in name or "numeric" in name:
        return T.DoubleType()
    return next((found for part, found in _DECLARED if part in name), T.StringType())


def read_sqlite(spark: SparkSession, paths: str | list[str], table: str) -> DataFrame:
    """One table from one database file, or the same table from several files.

    The files must be reachable from every executor under the same path. Large single files
    belong on a mounted folder, where each task reads only its rows. One file whose row ids lie
    close together is cut evenly; all else in ranges of counted rows (``sqlite_ranges``), which are
    found when this is called.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    schema = table_schema(files[0], table)
    if len(files) > 1 or not _dense(files[0], table):
        return read_in_ranges(spark, files, table, schema, ROWS_PER_PARTITION)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("tidemill_sqlite").schema(schema)
    return reader.options(files=json.dumps(files), table=table).load()


def _dense(path, table):
    """Whether even ranges of row ids are few enough, with as many rows as ids at most in each."""
    if not is_local(path):
        return True
    try:
        with closing(_open(path)) as database:
            low, high = database.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
    except sqlite3.OperationalError:  # a table without row ids
        return False
    return low is None or high - low < ROWS_PER_PARTITION * MAX_PARTITIONS


def table_schema(path: str, table: str) -> T.StructType:
    """Columns as declared; an empty table has a schema too and counts as present."""
    try:
        with closing(_open(path)) as database:
            found = database.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    except sqlite3.OperationalError as error:
        raise MissingSource(f"cannot open {path!r}: {error}") from error
    if not found:
        raise MissingSource(f"source table {table!r} does not exist in {path!r}")
    return T.StructType([T.StructField(name, spark_type(declared)) for _, name, declared, *_ in found])


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemill_sqlite"

    def schema(self):
        return table_schema(json.loads(self.options["files"])[0], self.options["table"])

    def reader(self, schema):
        return SqliteReader(schema, self.options)


class RowRange(InputPartition):
    def __init__(self, path, low, high):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = schema
        self.files = json.loads(options["files"])
        self.table = options["table"]
        self.step = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))

    def partitions(self):
        """Row id ranges of a single file; of several, one partition each, opened only in its task."""
        if len(self.files) > 1:
            return [RowRange(path, None, None) for path in self.files]
        path = self.files[0]
        try:
            with closing(_open(path)) as database:
                low, high = database.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids
            return [RowRange(path, None, None)]
        if low is None:
            return []
        # Row ids may lie far apart, so it is the number of ranges that is bounded.
        step = max(self.step, -(-(high - low + 1) // MAX_PARTITIONS))
        return [RowRange(path, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition):
        if partition is None:  # what Spark passes when there are no partitions: the table is empty
            return
        columns = ", ".join(_quoted(f.name) for f in self.fields)
        sql = f"SELECT {columns} FROM {_quoted(self.table)}"
        bounds = ()
        if partition.low is not None:
            sql += " WHERE rowid BETWEEN ? AND ?"
            bounds = (partition.low, partition.high)
        schema = to_arrow_schema(self.fields)
        with closing(_open(partition.path)) as database:
            cursor = database.execute(sql, bounds)
            while rows := cursor.fetchmany(BATCH_ROWS):
                arrays = [_array(values, field.type) for values, field in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _array(values, kind):
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else bool(v) for v in values], kind)
    if pa.types.is_decimal(kind) or pa.types.is_temporal(kind):
        return pa.array([None if v is None else str(v) for v in values], pa.string()).cast(kind)
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else str(v) for v in values], kind)
    return pa.array(values, kind)


def _open(path):
    """A local file in place; one on other storage through memory."""
    if is_local(path):
        return sqlite3.connect(f"file:{quote(local_path(path))}?mode=ro", uri=True)
    database = sqlite3.connect(":memory:")
    with open_input(path) as stream:
        database.deserialize(stream.read())
    return database


def _quoted(name):
    return '"' + name.replace('"', '""') + '"'
