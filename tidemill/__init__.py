"""Extract-load-transform on Spark: sources to tables, SQL models over them, lineage and freshness as tables."""

from tidemill.specs import (
    Adapter,
    Column,
    Dashboard,
    DatabaseSource,
    FileSource,
    Jdbc,
    LocalFiles,
    Model,
    MySql,
    ObjectStore,
    PostgreSql,
    Project,
    Query,
    Sqlite,
)

__all__ = [
    "Adapter",
    "Column",
    "Dashboard",
    "DatabaseSource",
    "FileSource",
    "Jdbc",
    "LocalFiles",
    "Model",
    "MySql",
    "ObjectStore",
    "PostgreSql",
    "Project",
    "Query",
    "Sqlite",
]
