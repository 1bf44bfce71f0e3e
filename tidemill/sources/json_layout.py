"""Telling newline-delimited JSON files from files that hold one array."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.storage import open_input

_HEAD_BYTES = 4096


def split_by_layout(spark: SparkSession, paths, options):
    """``(lines, arrays)``: what to read as records per line and what as whole arrays.

    The usual case of one layout throughout hands ``paths`` back untouched. Only the head
    of each file is looked at, in tasks, so the check does not grow with file size.
    """
    files = spark.read.options(**options).text(paths).inputFiles()
    if not files:
        return paths, None
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    slots = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    arrays = _array_files(listing.repartition(slots), spark, paths, options)
    if not arrays:
        return paths, None
    if len(arrays) == len(files):
        return None, paths
    chosen = set(arrays)
    return (
        [unquote(f) for f in files if f not in chosen],
        [unquote(f) for f in files if f in chosen],
    )


def _array_files(listing: DataFrame, spark, paths, options) -> list[str]:
    heads = listing.mapInPandas(_look_at_heads, "path string, first string")
    found = heads.where("first is null or first = '['").collect()
    if all(row.first is not None for row in found):
        return [row.path for row in found]
    return [row.path for row in _first_characters(spark, paths, options).where("first = '['").collect()]


def _first_characters(spark, paths, options) -> DataFrame:
    """The same through Spark's text reader, for storage Arrow cannot open; reads the files once."""
    lines = spark.read.options(**options).text(paths)
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return (
        lines.select(F.col("_metadata.file_path").alias("path"), F.ltrim("value").alias("line"), at.alias("at"))
        .where("line <> ''")
        .groupBy("path")
        .agg(F.min_by(F.substring("line", 1, 1), "at").alias("first"))
    )


def _look_at_heads(batches):
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "first": [_first_byte(p) for p in batch["path"]]})


def _first_byte(uri: str) -> str | None:
    """First byte that is not white space, '' for a blank file, None when Arrow cannot open it."""
    try:
        with open_input(unquote(uri)) as stream:
            while head := stream.read(_HEAD_BYTES):
                head = head.removeprefix(b"\xef\xbb\xbf").lstrip()
                if head:
                    return head[:1].decode("latin-1")
        return ""
    except (OSError, ValueError, NotImplementedError):
        return None
