"""Database tables over JDBC."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType, TimestampType

from tidemill.errors import MissingSource
from tidemill.specs import DatabaseSource, Jdbc, MySql, PostgreSql


def jdbc_options(connection) -> dict[str, str]:
    """Connection options of the JDBC reader."""
    if isinstance(connection, MySql):
        url = f"jdbc:mysql://{connection.host}:{connection.port}/{connection.database}"
        driver = "com.mysql.cj.jdbc.Driver"
    elif isinstance(connection, PostgreSql):
        url = f"jdbc:postgresql://{connection.host}:{connection.port}/{connection.database}"
        driver = "org.postgresql.Driver"
    elif isinstance(connection, Jdbc):
        url, driver = connection.url, connection.driver
    else:
        raise TypeError(f"{type(connection).__name__} is not a JDBC connection")
    options = {"url": url, "driver": driver, "fetchsize": "10000"}
    if connection.username is not None:
        options["user"] = connection.username
        options["password"] = connection.password or ""
    return options


def read_jdbc(spark: SparkSession, connection, source: DatabaseSource) -> DataFrame:
    """The table, read in ``source.partitions`` tasks of near-equal rows.

    Split by the partition column when one is named, else by a column that the database's metadata
    gives: of the primary key before others, whole numbers by value before the rest, which MySQL and
    PostgreSQL hash. For whole numbers the database counts rows by slices of the column's range, slices with too many
    rows are cut again, and neighbours are joined until they hold a partition's share: so gaps and
    skewed keys do not matter. A single busy key value stays whole. Nulls are read by the last part.
    """
    options = jdbc_options(connection)
    whole = _load(spark.read.format("jdbc").options(**options, dbtable=source.table), source)
    if source.partitions < 2:
        return whole
    column, named = source.partition_column, None
    if column:
        named = next(f for f in whole.schema.fields if f.name.lower() == column.strip('"`').lower())
        if not isinstance(named.dataType, _NUMBERS):
            return _by_bounds(spark, options, source, whole)
    else:
        keys, quote = _key_and_quote(spark, options, source.table)
        named = _split_field(options["url"], keys, whole.schema)
        if named is None:
            return whole
        column = f"{quote}{named.name}{quote}"
    if isinstance(named.dataType, _NUMBERS):
        parts = range_predicates(column, balanced_cuts(_Probe(spark, options, source, column), source.partitions))
    else:
        parts = _hash_predicates(options["url"], column, source.partitions)
    if not parts:
        return whole
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], source.table, predicates=parts, properties=properties)


def _by_bounds(spark, options, source, whole):
    """Equal ranges of a named column of dates or other numbers."""
    column = source.partition_column
    low, high = _load(
        spark.read.format("jdbc").options(**options, query=f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source.table}"), source
    ).first()
    if low is None:
        return whole
    ranges = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(source.partitions)}
    return _load(spark.read.format("jdbc").options(**options, dbtable=source.table, **ranges), source)


_NUMBERS = (ByteType, ShortType, IntegerType, LongType)
_PLAIN = (*_NUMBERS, StringType, DecimalType, DateType, TimestampType)
#: Slices that one question to the database counts.
SLICES = 256


def _split_field(url, keys, schema):
    """What to split by: a column of the key before others, whole numbers before what must be hashed."""
    fields = [f for f in schema.fields if isinstance(f.dataType, _NUMBERS) or isinstance(f.dataType, _PLAIN) and _hash_of(url)]
    return min(fields, key=lambda f: (f.name not in keys, not isinstance(f.dataType, _NUMBERS)), default=None)


def _key_and_quote(spark, options, table) -> tuple[set[str], str]:
    """Columns of the table's primary key, and what names are quoted with, as the driver's metadata tells."""
    properties = spark._jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            properties.setProperty(name, options[name])
    # Spark has registered the driver when it read the schema.
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        meta = connection.getMetaData()
        last = table.rsplit(".", 1)[-1]
        name = last.strip('"`')
        if name == last and meta.storesUpperCaseIdentifiers():
            name = name.upper()
        found, columns = meta.getPrimaryKeys(None, None, name), set()
        while found.next():
            columns.add(found.getString("COLUMN_NAME"))
        return columns, meta.getIdentifierQuoteString().strip()
    finally:
        connection.close()


class _Probe:
    """Questions about a column's range, answered by the database; at most ``SLICES`` rows each."""

    def __init__(self, spark, options, source, column):
        self.reader = lambda sql: _load(spark.read.format("jdbc").options(**options, query=sql), source)
        self.table, self.column = source.table, column

    def bounds(self) -> tuple[int, int, int]:
        c = self.column
        row = self.reader(f"SELECT MIN({c}) AS lo, MAX({c}) AS hi, COUNT({c}) AS n FROM {self.table}").first()
        return row[0], row[1], row[2]

    def counts(self, low: int, high: int, width: int) -> dict[int, int]:
        """Rows by slice of ``width`` values from ``low`` to ``high``, both included."""
        c = self.column
        over = f"({c} - ({low}))"  # databases divide differently, so the remainder is taken off first
        inner = f"SELECT ({over} - MOD({over}, {width})) / {width} AS part FROM {self.table} WHERE {c} >= {low} AND {c} <= {high}"
        return {int(r[0]): int(r[1]) for r in self.reader(f"SELECT part, COUNT(*) AS n FROM ({inner}) slices GROUP BY part").collect()}


def balanced_cuts(probe, parts: int) -> list[int]:
    """Values at which parts begin, after the first; none holds over two shares, but for single values."""
    low, high, n = probe.bounds()
    if low is None:
        return []
    share, slices = max(1, -(-n // parts)), []

    def cut(low, high):
        width = max(1, -(-(high - low + 1) // SLICES))
        for k, rows in sorted(probe.counts(low, high, width).items()):
            begin, end = low + k * width, min(high, low + (k + 1) * width - 1)
            if rows > share and begin < end:
                cut(begin, end)
            else:
                slices.append((begin, rows))

    # Differences on one side of zero stay within the column's type.
    for begin, end in ((low, min(high, -1)), (max(low, 0), high)):
        if begin <= end:
            cut(begin, end)
    cuts, held = [], 0
    for begin, rows in slices:
        if held and held + rows > share:
            cuts.append(begin)
            held = 0
        held += rows
    return cuts


def range_predicates(column: str, cuts: list[int]) -> list[str]:
    """Conditions of which each row meets one; rows without a value meet the last."""
    if not cuts:
        return []
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]}", *between, f"{column} >= {cuts[-1]} OR {column} IS NULL"]


#: How each database hashes a value's text to a number of 32 bits or less.
_HASHES = {"jdbc:mysql:": "CRC32({0})", "jdbc:postgresql:": "ABS(CAST(HASHTEXT(CAST({0} AS TEXT)) AS BIGINT))"}


def _hash_of(url) -> str | None:
    return next((form for kind, form in _HASHES.items() if url.startswith(kind)), None)


def _hash_predicates(url, column, parts):
    value = f"MOD({_hash_of(url).format(column)}, {parts})"
    return [*[f"{value} = {k}" for k in range(parts - 1)], f"{value} = {parts - 1} OR {column} IS NULL"]


# SQL states of a missing table (standard and MySQL, PostgreSQL, Derby).
_NO_TABLE = ("42S02", "42P01", "42X05")


def _load(reader, source):
    """Resolving the schema is the existence check; no rows are counted."""
    try:
        return reader.load()
    except (Py4JJavaError, PySparkException) as error:
        if _sql_state(error) in _NO_TABLE:
            raise MissingSource(f"source table {source.table!r} does not exist") from error
        raise


def _sql_state(error) -> str | None:
    """The state of the database's own exception below Spark's."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        try:
            return cause.getSQLState()
        except Exception:  # noqa: BLE001 - not an exception of a database
            cause = cause.getCause()
    return None
