"""One entry for every kind of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import SpecError
from tidemill.sources.databases import read_jdbc
from tidemill.sources.files import read_files
from tidemill.sources.object_store import bucket_root, s3a_options
from tidemill.sources.paths import expand_date_tokens, matching_objects, under
from tidemill.sources.sqlite import read_sqlite
from tidemill.specs import (
    Adapter,
    DatabaseSource,
    FileSource,
    Jdbc,
    LocalFiles,
    MySql,
    ObjectStore,
    PostgreSql,
    Sqlite,
    struct_of,
)


def ingest(spark: SparkSession, adapter: Adapter, connection) -> DataFrame | None:
    """The adapter's rows; ``None`` when its path pattern matches no file."""
    source = adapter.source
    if isinstance(source, FileSource):
        if not isinstance(source.path, str):
            return _listed_files(spark, connection, source, adapter.columns)
        pattern = expand_date_tokens(source.path)
        if isinstance(connection, LocalFiles):
            return read_files(spark, under(connection.base_path, pattern), source, adapter.columns)
        if isinstance(connection, ObjectStore):
            return _from_object_store(spark, connection, pattern, source, adapter.columns)
        raise SpecError(f"{type(connection).__name__} cannot serve files")
    if isinstance(source, DatabaseSource):
        if isinstance(connection, Sqlite):
            return _declared(read_sqlite(spark, connection.path, source.table), adapter)
        if isinstance(connection, (MySql, PostgreSql, Jdbc)):
            return _declared(read_jdbc(spark, connection, source), adapter)
        raise SpecError(f"{type(connection).__name__} cannot serve database tables")
    raise SpecError(f"unknown source {type(source).__name__}")


def _listed_files(spark, connection, source, columns):
    if isinstance(connection, LocalFiles):
        return read_files(spark, [under(connection.base_path, p) for p in source.path], source, columns)
    if isinstance(connection, ObjectStore):
        paths = [f"{bucket_root(connection)}/{p}" for p in source.path]
        return read_files(spark, paths, source, columns, s3a_options(connection))
    raise SpecError(f"{type(connection).__name__} cannot serve files")


def _from_object_store(spark, store, pattern, source, columns):
    options = s3a_options(store)
    if "*" not in pattern and "?" not in pattern:
        return read_files(spark, f"{bucket_root(store)}/{pattern}", source, columns, options)
    found = matching_objects(spark, bucket_root(store), pattern, options)
    paths = [row.path for row in found.collect()]
    return read_files(spark, paths, source, columns, options) if paths else None


def _declared(df, adapter):
    if not adapter.columns:
        return df
    return df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in struct_of(adapter.columns)])
