"""What the operators share: batches as Python lists, tables in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.session import discard, materialize, scratch_path

#: Rows handed to a Python function at once: long texts are held as Python strings in few numbers.
SLICE_ROWS = 256


def by_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, columns: list, schema: str, make: Callable[[], Callable], rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``make()(*lists)`` to slices of ``columns``; it returns one list for each output column.

    ``make`` runs once in a task, so what it builds lives as long as the task. The work is a
    map: no row leaves its partition.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        # What tasks remember are very many small objects without cycles; passes over them are rare then.
        gc.set_threshold(200_000, 50, 100)
        function = make()
        for batch in by_slices(batches, rows):
            lists = function(*(column.to_pylist() for column in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(lists, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def kept(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table in the shared folder, and how to delete it."""
    path = scratch_path(df.sparkSession, label)
    return materialize(df, path=path), lambda: discard(df.sparkSession, path)


def text_of(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def measured_broadcast(df: DataFrame, bytes_of, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if the bytes it holds were measured to be under ``limit``."""
    size = df.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df
