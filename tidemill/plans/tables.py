"""Catalog tables: create or replace, append, inspect, drop."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import SpecError
from tidemill.session import delete_folder
from tidemill.specs import struct_of

_SCHEMA_FIELDS = "position int, column_name string, data_type string"


def create_or_replace(
    df: DataFrame, name: str, location: str | None = None, keep_replaced: bool = False
) -> DataFrame:
    """Write ``df`` as table ``name``, replacing any earlier one.

    The rows are written first and take the name over once complete, so a failed
    write leaves the earlier table alone and ``df`` may read the table it replaces. With a
    ``location`` each version lies in a folder of its own below it; ``keep_replaced`` leaves
    the earlier one for queries still reading it. A version with the columns of the earlier one takes
    its place by moving the table's location, one change in the catalog, so a reader always finds
    the table. Other columns, or no location, mean that a scratch table is renamed after a drop.
    """
    spark = df.sparkSession
    ensure_database(spark, name, location.rstrip("/").rpartition("/")[0] if location else None)
    scratch = scratch_name(name)
    folder = f"{location.rstrip('/')}/{scratch.split('.')[-1]}" if location else None
    earlier = _folder_below(spark, name, location) if location else None
    if earlier and _columns(df) == _columns(spark.table(name)):
        df.write.parquet(folder)
        spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION {_text(folder)}")
        spark.catalog.refreshTable(quoted(name))
    else:
        writer = df.write.format("parquet")
        (writer.option("path", folder) if folder else writer).saveAsTable(scratch)
        drop_table(spark, name)
        spark.sql(f"ALTER TABLE {quoted(scratch)} RENAME TO {quoted(name)}")
    if earlier and not keep_replaced:
        delete_folder(spark, earlier)
    return spark.table(name)


def _columns(df):
    return [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in df.schema]


def _folder_below(spark, name, location):
    """Where table ``name`` lies, if that is a version folder of ``location``."""
    found = table_location(spark, name)
    return found if found and found.startswith(f"{plain_path(location)}/") else None


def table_location(spark: SparkSession, name: str) -> str | None:
    """The folder of a table's rows; ``None`` without table or folder."""
    if not table_exists(spark, name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").where("col_name = 'Location'").collect()
    return plain_path(rows[0].data_type) if rows else None


def plain_path(path: str) -> str:
    return re.sub("^file:/+", "/", path.rstrip("/"))


def create_empty(spark: SparkSession, name: str, columns, location: str | None = None) -> DataFrame:
    """An empty table with the given columns."""
    if not columns:
        raise SpecError(f"table {name!r} needs at least one column")
    return create_or_replace(spark.createDataFrame([], struct_of(columns)), name, location)


def append_rows(df: DataFrame, name: str) -> None:
    """Add rows to an existing table, matching columns by name."""
    target = df.sparkSession.table(name)
    df.select(target.columns).write.mode("append").insertInto(name)


def scratch_name(prefix: str) -> str:
    """A table name no other writer uses."""
    return f"{prefix}_{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """One row per column, in order."""
    return schema_rows(spark.table(name))


def schema_rows(df: DataFrame) -> DataFrame:
    rows = [(at, f.name, f.dataType.simpleString()) for at, f in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(rows, _SCHEMA_FIELDS)


def list_tables(spark: SparkSession, like: str = "*", database: str | None = None) -> DataFrame:
    """Names of the catalog's tables matching a pattern; views are left out."""
    where = f" IN {quoted(database)}" if database else ""
    shown = spark.sql(f"SHOW TABLES{where} LIKE {_text(like)}")
    return shown.where(~F.col("isTemporary")).select(F.col("tableName").alias("table_name")).orderBy("table_name")


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database a two-part table name lives in, as ``<database>.db`` below ``location``."""
    if "." in name:
        database = name.rsplit(".", 1)[0]
        where = f" LOCATION {_text(f'{location}/{database}.db')}" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{where}")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
