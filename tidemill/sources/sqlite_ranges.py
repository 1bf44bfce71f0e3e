"""Many, sparse or key-ordered SQLite tables, read in ranges of a bounded number of rows.

The cuts are found in tasks, by probes of the tree a table is stored in: each file's span of row
ids is first sliced evenly, then slices that can hold too many rows are walked in steps of as many
rows. Tables without row ids are walked along their primary key, one task a file. Ranges stay rows
of a table; only their number and the number of rows come to the driver.
"""

from __future__ import annotations

import pickle
import sqlite3
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import materialize
from tidemill.sources.storage import is_local

#: Even slices of one file's row ids, at most.
SLICES = 1024

_SLICE = pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
_RANGE = pa.schema([("path", pa.string()), ("keys", pa.string()), ("low", pa.binary()), ("high", pa.binary()), ("rows", pa.int64())])


def read_in_ranges(spark: SparkSession, files: list[str], table: str, schema: T.StructType, step: int) -> DataFrame:
    """The table from all files. A file that is not on a mounted folder is one range, since each range would fetch it whole."""
    ranges = row_ranges(spark, files, table, step)
    rows, count = ranges.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, min(count, -(-rows // step)))
    return ranges.repartition(parts).mapInArrow(lambda batches: _read(batches, table, schema), schema)


def row_ranges(spark: SparkSession, files: list[str], table: str, step: int) -> DataFrame:
    """``(path, keys, low, high, rows)``, of ``step`` rows at most each; ``low`` is left out of a range, ``high`` is in it."""
    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))
    slices = names.mapInArrow(lambda batches: _slices(batches, table, step), "path string, low bigint, high bigint")
    slices = materialize(slices, "sqlite-slices").repartition(max(len(files), spark.sparkContext.defaultParallelism))
    found = slices.mapInArrow(lambda batches: _ranges(batches, table, step), "path string, keys string, low binary, high binary, rows bigint")
    return materialize(found, "sqlite-ranges")


def _slices(batches, table, step):
    from tidemill.sources.sqlite import _open

    for batch in batches:
        for path in batch.column("path").to_pylist():
            low = high = None
            if is_local(path):
                with closing(_open(path)) as database:
                    if _key_columns(database, table) == []:
                        low, high = database.execute(f"SELECT min(rowid), max(rowid) FROM {_source(table)}").fetchone()
                        if low is None:  # an empty table
                            continue
            if low is None:
                yield pa.RecordBatch.from_pylist([{"path": path, "low": None, "high": None}], _SLICE)
                continue
            width = max(step, -(-(high - low + 1) // SLICES))
            cut = [{"path": path, "low": at, "high": min(at + width - 1, high)} for at in range(low, high + 1, width)]
            yield pa.RecordBatch.from_pylist(cut, _SLICE)


def _ranges(batches, table, step):
    from tidemill.sources.sqlite import _open

    for batch in batches:
        for cut in batch.to_pylist():
            path = cut["path"]
            if not is_local(path):
                yield _range(path, "", None, None, step)
                continue
            with closing(_open(path)) as database:
                keys = _key_columns(database, table)
                if keys is None:
                    yield _range(path, "", None, None, step)
                elif keys:
                    yield from _walked(database, path, table, keys, None, None, step)
                elif cut["high"] - cut["low"] < step:
                    yield _range(path, "rowid", _before(cut["low"]), (cut["high"],), cut["high"] - cut["low"] + 1)
                else:
                    yield from _walked(database, path, table, ["rowid"], _before(cut["low"]), (cut["high"],), step)


def _before(low):
    return (low - 1,) if low > -(2**63) else None


def _walked(database, path, table, keys, low, last, step):
    """Ranges of ``step`` rows from ``low`` on; the last one ends at ``last`` and counts what it holds."""
    names, tree = _names(keys), _source(table)
    while True:
        where, values = _within(keys, low, last)
        upto = database.execute(f"SELECT {names} FROM {tree} {where} ORDER BY {names} LIMIT 1 OFFSET {step - 1}", values).fetchone()
        if upto is None:
            rest = database.execute(f"SELECT count(*) FROM {tree} {where}", values).fetchone()[0]
            if rest:
                yield _range(path, "\0".join(keys), low, last, rest)
            return
        yield _range(path, "\0".join(keys), low, upto, step)
        low = upto


def _read(batches, table, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    from tidemill.sources.sqlite import BATCH_ROWS, _array, _open, _quoted

    columns, arrow = ", ".join(_quoted(f.name) for f in schema), to_arrow_schema(schema)
    for batch in batches:
        for part in batch.to_pylist():
            keys = [k for k in part["keys"].split("\0") if k]
            low, high = (pickle.loads(part[end]) if part[end] else None for end in ("low", "high"))
            where, values = _within(keys, low, high)
            with closing(_open(part["path"])) as database:
                cursor = database.execute(f"SELECT {columns} FROM {_source(table)} {where}", values)
                while rows := cursor.fetchmany(BATCH_ROWS):
                    arrays = [_array(cells, field.type) for cells, field in zip(zip(*rows), arrow)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _range(path, keys, low, high, rows):
    packed = {"low": pickle.dumps(low) if low else None, "high": pickle.dumps(high) if high else None}
    return pa.RecordBatch.from_pylist([{"path": path, "keys": keys, "rows": rows, **packed}], _RANGE)


def _key_columns(database, table):
    """The primary key of a table that is stored by it; empty for a table with row ids, null for a view."""
    kind = database.execute("SELECT type FROM sqlite_master WHERE lower(name) = lower(?)", (table,)).fetchone()
    if kind and kind[0] == "view":  # its row ids are null or an error, as the library was built
        return None
    try:
        database.execute(f"SELECT rowid FROM {_source(table)} LIMIT 1")
        return []
    except sqlite3.OperationalError:
        found = [(place, name) for _, name, _, _, _, place in database.execute(f"PRAGMA table_info({_source(table)})") if place]
        return [name for _, name in sorted(found)]


def _within(keys, low, high):
    marks = f"({', '.join('?' * len(keys))})"
    tests = [f"({_names(keys)}) {sign} {marks}" for sign, end in ((">", low), ("<=", high)) if end]
    return (f"WHERE {' AND '.join(tests)}" if tests else ""), [*(low or ()), *(high or ())]


def _names(keys):
    return ", ".join(k if k == "rowid" else '"' + k.replace('"', '""') + '"' for k in keys)


def _source(table):
    return '"' + table.replace('"', '""') + '"'
