"""Ingest only the files that arrived since the last call."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import SpecError
from tidemill.plans.tables import drop_table, ensure_database, plain_path, quoted, table_location
from tidemill.session import child_folders, delete_folder
from tidemill.sources.files import delimiter_of, read_files, reader_options, timestamps_as_text, timestamps_restored
from tidemill.sources.json_layout import split_by_layout
from tidemill.sources.object_store import bucket_root, s3a_options
from tidemill.sources.paths import expand_date_tokens, key_regex, literal_prefix, nothing_there, under
from tidemill.specs import Adapter, FileSource, LocalFiles, ObjectStore, struct_of

# Size units a batch bound may be written in.
_UNITS = {"": 1, "B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}


def size_in_bytes(text: str) -> int:
    """``100MB`` and the like as a number of bytes."""
    match = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not match or match.group(2).upper() not in _UNITS:
        raise SpecError(f"not a size: {text!r}")
    return int(match.group(1)) * _UNITS[match.group(2).upper()]


def incremental_ingest(
    spark: SparkSession, path: str, source: FileSource, columns, target: str, progress: str
) -> DataFrame:
    """Append the new files below ``path`` to the Parquet folder ``target``; return all of it.

    Rows that do not fit the declaration end the job, as in a batch read; what was appended
    before stays, and the next call goes on from there. Structured Streaming keeps in ``progress`` which files were taken, and the sink's own log
    makes a rerun after a failure neither lose nor repeat rows. ``source.max_batch_size``
    bounds one micro-batch.
    """
    if not columns:
        raise SpecError("incremental ingest needs declared columns")
    if source.format == "json" and source.layout == "auto":
        raise SpecError("incremental ingest needs the JSON layout: lines or array")
    schema = struct_of(columns)
    _take(spark, path, source, schema, target, progress)
    return spark.read.schema(schema).parquet(target)


def _take(spark, path, source, schema, target, progress, options=None, keys=None) -> None:
    """Run the stream until all files there are taken; ``keys`` is what their whole path must match."""
    reader = spark.readStream.format(source.format).options(**(options or {})).schema(
        schema if source.format == "parquet" else timestamps_as_text(schema)
    )
    if source.format != "parquet":
        reader = reader.options(**reader_options(spark, path, source, options))
    if source.max_batch_size:
        reader = reader.option("maxBytesPerTrigger", str(size_in_bytes(source.max_batch_size)))
    rows = reader.load(path)
    if keys:
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = rows.where(plain.rlike(keys)).select(*schema.names)
    if source.format != "parquet":
        rows = timestamps_restored(rows, schema)
    stream = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()


def load_new(spark: SparkSession, adapter: Adapter, connection, folder: str) -> DataFrame | None:
    """Bring the table of a declared adapter over files up to date by reading only what is new.

    ``None`` when no file matches and there is no table yet. Rows, progress and what was found out
    about the files lie in ``<folder>/<table>/<version>``, where the version follows from the
    declaration: a changed one starts anew, and its table takes the place of the earlier one when all
    files are read. The table is registered over the rows that the sink's log holds, each
    micro-batch once, so neither a failed run nor its repetition loses or repeats any. Such a table
    takes rows from its source alone.

    Columns, the delimiter and the JSON layout are found when the first files are there, unless
    declared, and hold for all later ones; files that do not fit end the run. On an object store the
    pattern's wildcards cross folders; listing begins at its literal prefix.
    """
    version = hashlib.sha256(adapter.significant().encode()).hexdigest()[:16]
    place = f"{folder.rstrip('/')}/{adapter.name}"
    home = f"{place}/{version}"
    path, options, keys = _watched(connection, adapter.source)
    facts = _facts(spark, home, adapter, path, options)
    if facts is None:
        return None
    source = replace(adapter.source, layout=facts["layout"], delimiter=facts["delimiter"])
    schema = T.StructType.fromJson(facts["schema"])
    _take(spark, path, source, schema, f"{home}/rows", f"{home}/progress", options, keys)
    return _register(spark, adapter.name, schema, place, version)


def forget_loads(spark: SparkSession, name: str, folder: str) -> None:
    """Delete what ``load_new`` keeps of a table."""
    delete_folder(spark, f"{folder.rstrip('/')}/{name}")


def _watched(connection, source):
    """The path to watch, reader options, and a pattern that whole paths must match (``None``: the path is it)."""
    pattern = expand_date_tokens(source.path)
    if isinstance(connection, LocalFiles):
        return under(connection.base_path, pattern), {}, None
    if not isinstance(connection, ObjectStore):
        raise SpecError(f"{type(connection).__name__} cannot serve files")
    root, options = bucket_root(connection), s3a_options(connection)
    if "*" not in pattern and "?" not in pattern:
        return f"{root}/{pattern}", options, None
    last = re.sub(r"([\\\[\]{}])", r"\\\1", pattern.rpartition("/")[2])
    options |= {"recursiveFileLookup": "true", "pathGlobFilter": last}
    prefix = literal_prefix(pattern)
    keys = f"^[^:]*:/*{re.escape(root.split('://', 1)[-1].lstrip('/'))}/{key_regex(pattern)[1:]}"
    return f"{root}/{prefix}" if prefix else root, options, keys


def _facts(spark, home, adapter, path, options):
    """Schema, layout and delimiter of the files, found once; ``None`` while there are no files."""
    try:
        return json.loads(spark.read.text(f"{home}/facts", wholetext=True).first()[0])
    except AnalysisException as error:
        if not nothing_there(error):
            raise
    source = adapter.source
    listed = spark.read.format("binaryFile").options(**options)
    try:
        if listed.load(path).select("path").isEmpty():
            return None
        layout, delimiter = source.layout, source.delimiter
        if source.format == "json" and layout == "auto":
            lines, arrays = split_by_layout(spark, path, options)
            if lines and arrays:
                raise SpecError(f"{adapter.name!r} mixes JSON layouts and cannot be loaded by and by: declare no max_batch_size")
            layout = "array" if arrays else "lines"
        if source.format == "csv" and delimiter == "auto":
            delimiter = delimiter_of(spark, path, options)
        found = replace(source, layout=layout, delimiter=delimiter)
        schema = struct_of(adapter.columns) if adapter.columns else read_files(spark, path, found, (), options).schema
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return None
    facts = {"layout": layout, "delimiter": delimiter, "schema": json.loads(schema.json())}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/facts")
    return facts


def _register(spark, name, schema, place, version):
    """The table over the rows of this version; folders of earlier versions go."""
    rows = f"{place}/{version}/rows"
    if table_location(spark, name) != plain_path(rows):
        ensure_database(spark, name)
        drop_table(spark, name)
        spark.catalog.createTable(name, path=rows, source="parquet", schema=schema)
        for old in child_folders(spark, place):
            if old != version:
                delete_folder(spark, f"{place}/{old}")
    spark.catalog.refreshTable(quoted(name))
    return spark.table(name)


def ingest_new(spark: SparkSession, adapter: Adapter, connection: LocalFiles, target: str, progress: str) -> DataFrame:
    """The same for a declared adapter over files; its date tokens and wildcards hold."""
    if not isinstance(adapter.source, FileSource) or not isinstance(connection, LocalFiles) or not isinstance(adapter.source.path, str):
        raise SpecError("incremental ingest needs a pattern of files")
    path = under(connection.base_path, expand_date_tokens(adapter.source.path))
    return incremental_ingest(spark, path, adapter.source, adapter.columns, target, progress)
