"""What a user declares: connections, adapters, models, queries, dashboards."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from tidemill.errors import SpecError, UnknownName

# Declared column types and the Spark type each one reads as.
COLUMN_TYPES = {
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "bigint": T.LongType(),
    "hugeint": T.DecimalType(38, 0),
    "string": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "blob": T.BinaryType(),
}
_DECIMAL = re.compile(r"(?:decimal|numeric)(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?")


def column_type(declared: str) -> T.DataType:
    """The Spark type of a declared type name, in any case."""
    name = declared.strip().lower()
    if name in COLUMN_TYPES:
        return COLUMN_TYPES[name]
    match = _DECIMAL.fullmatch(name)
    if not match:
        raise SpecError(f"unknown column type {declared!r}")
    precision, scale = match.groups()
    if precision is None:
        return T.DecimalType(18, 3)
    return T.DecimalType(int(precision), int(scale or 0))


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    description: str | None = None


def struct_of(columns) -> T.StructType:
    """The declared columns as a schema; descriptions become column comments."""
    return T.StructType(
        [
            T.StructField(c.name, column_type(c.type), True, {"comment": c.description} if c.description else None)
            for c in columns
        ]
    )


@dataclass(frozen=True)
class FileSource:
    """Files of one format. ``path`` may hold globs and ``{YYYY}{MM}{DD}{HH}{mm}`` tokens; a tuple
    lists files by name.

    CSV: ``delimiter`` is a comma unless given; ``auto`` finds it in one pass over all lines.
    ``multi_line`` allows line breaks
    inside quotes, at the price of files that cannot be split. JSON: ``layout`` is ``lines``,
    ``array`` or ``auto`` (look at the head of each file).
    """

    path: str | tuple[str, ...]
    format: str = "csv"
    compression: str | None = None
    max_batch_size: str | None = None
    delimiter: str | None = None
    null_value: str | None = None
    has_header: bool | None = None
    multi_line: bool = False
    layout: str = "auto"


@dataclass(frozen=True)
class DatabaseSource:
    """A database table; ``partition_column`` splits a JDBC read into ``partitions`` ranges."""

    table: str
    partition_column: str | None = None
    partitions: int = 16


@dataclass(frozen=True)
class LocalFiles:
    base_path: str


@dataclass(frozen=True)
class ObjectStore:
    bucket: str
    region: str = "us-east-1"
    endpoint_url: str | None = None
    auth_method: str = "explicit"
    access_key_id: str = ""
    secret_access_key: str = field(default="", repr=False)
    session_token: str | None = field(default=None, repr=False)
    path_style_access: bool = False


@dataclass(frozen=True)
class Sqlite:
    path: str


@dataclass(frozen=True)
class MySql:
    host: str
    port: int
    database: str
    username: str
    password: str = field(default="", repr=False)


@dataclass(frozen=True)
class PostgreSql:
    host: str
    port: int
    database: str
    username: str
    password: str = field(default="", repr=False)


@dataclass(frozen=True)
class Jdbc:
    """Any other database with a JDBC driver on the class path."""

    url: str
    driver: str
    username: str | None = None
    password: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class Adapter:
    """A source and the table it is loaded into."""

    name: str
    connection: str
    source: FileSource | DatabaseSource
    columns: tuple[Column, ...] = ()
    description: str | None = None

    def significant(self) -> str:
        """The part of the declaration whose change means the table must be rebuilt."""
        return json.dumps(
            {
                "connection": self.connection,
                "kind": type(self.source).__name__,
                "source": asdict(self.source),
                "columns": [asdict(c) for c in self.columns],
            },
            sort_keys=True,
        )


@dataclass(frozen=True)
class Model:
    """A table defined by SQL over other tables."""

    name: str
    sql: str
    description: str | None = None

    def significant(self) -> str:
        return self.sql


@dataclass(frozen=True)
class Query:
    name: str
    sql: str
    description: str | None = None

    def significant(self) -> str:
        return json.dumps([self.name, self.sql])


@dataclass(frozen=True)
class Dashboard:
    name: str
    query: str
    chart_type: str
    x_column: str
    y_column: str
    description: str | None = None

    def __post_init__(self):
        if self.chart_type not in ("line", "bar"):
            raise SpecError(f"chart type {self.chart_type!r} is neither line nor bar")


@dataclass
class Project:
    """All declarations of one project, by name."""

    connections: dict[str, object] = field(default_factory=dict)
    adapters: dict[str, Adapter] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    queries: dict[str, Query] = field(default_factory=dict)
    dashboards: dict[str, Dashboard] = field(default_factory=dict)

    def connect(self, name: str, connection) -> Project:
        self.connections[name] = connection
        return self

    def add(self, *specs) -> Project:
        groups = {Adapter: self.adapters, Model: self.models, Query: self.queries, Dashboard: self.dashboards}
        for spec in specs:
            if type(spec) not in groups:
                raise SpecError(f"cannot add {type(spec).__name__}")
            groups[type(spec)][spec.name] = spec
        return self

    def connection(self, name: str):
        if name not in self.connections:
            raise UnknownName(f"connection {name!r} is not declared")
        return self.connections[name]
