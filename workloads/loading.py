"""Sources and catalog tables: each query writes a table out in a format and loads it back."""

from __future__ import annotations

import sqlite3
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemill import Adapter, Column, FileSource, LocalFiles, Project
from tidemill.plans.project import Runner
from tidemill.plans.tables import append_rows, create_or_replace, drop_table, scratch_name, table_schema
from tidemill.session import scratch_path
from tidemill.sources.files import read_files
from tidemill.sources.ingest import ingest
from tidemill.sources.paths import matching_objects
from tidemill.sources.sqlite import read_sqlite
from tidemill.sources.storage import write_file
from tidemill.streaming.incremental import ingest_new
from workloads.registry import query, table

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
EVENT_COLUMNS = (
    Column("event_id", "BIGINT"),
    Column("ts", "DATETIME", "when it happened"),
    Column("user_id", "BIGINT"),
    Column("event_type", "STRING"),
    Column("value", "DOUBLE"),
    Column("props", "STRING"),
)


# The JSON writer keeps milliseconds unless told otherwise.
MICROSECONDS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def load(spark, base, path, format_, columns=(), **options):
    adapter = Adapter("loaded", "files", FileSource(path, format_, **options), tuple(columns))
    return ingest(spark, adapter, LocalFiles(base))


def as_written(df, original):
    """The original column order and integer widths: inference reads small integers as int."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in original.schema])


@query("csv_scan", ORDERS)
def csv_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = scratch_path(spark, "csv")
    orders.write.option("header", True).csv(f"{base}/orders")
    return as_written(load(spark, base, "orders", "csv"), orders)


@query(
    "parquet_scan",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_shipdate >= DATE '1999-01-01' AND l_returnflag = 'R'""",
)
def parquet_scan(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem.parquet", "parquet")
    return lines.where("l_shipdate >= DATE '1999-01-01' AND l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@query("json_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_scan(spark, sf_dir):
    base = scratch_path(spark, "json")
    table(spark, sf_dir, "events").write.options(**MICROSECONDS).json(f"{base}/events")
    return load(spark, base, "events/*.json", "json", EVENT_COLUMNS)


@query("json_array_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_array_scan(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    base = scratch_path(spark, "json-array")
    write_json_arrays(customers, f"{base}/customers")
    return as_written(load(spark, base, "customers/*.txt", "json"), customers)


def write_json_arrays(df, path, records_per_file=200_000):
    """Files that each hold one array over several lines, streamed out by the tasks."""
    files = -(-df.count() // records_per_file) or 1
    records = df.select(F.to_json(F.struct("*")).alias("value")).repartition(files)
    records.mapInPandas(_bracketed, "value string").write.text(path)


def _bracketed(batches):
    opening = "["
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"value": [opening + batch["value"].iloc[0], *("," + batch["value"].iloc[1:])]})
            opening = ","
    if opening == ",":
        yield pd.DataFrame({"value": ["]"]})


@query("multi_file_scan", ORDERS)
def multi_file_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = scratch_path(spark, "parts")
    orders.withColumn("part", F.col("o_orderstatus")).write.partitionBy("part").option("header", True).csv(base)
    # A handful of folders, named by the values there are; a null's has a name of its own.
    found = orders.select("o_orderstatus").distinct().collect()
    paths = tuple(f"part={r[0] if r[0] is not None else '__HIVE_DEFAULT_PARTITION__'}" for r in found)
    return as_written(load(spark, base, paths, "csv"), orders)


@query("glob_scan", "SELECT * FROM lineitem")
def glob_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    base = scratch_path(spark, "glob")
    lines.withColumn("flag", F.col("l_returnflag")).write.partitionBy("flag").parquet(base)
    return load(spark, base, "flag=?/*.parquet", "parquet").select(lines.columns)


@query("date_pattern_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def date_pattern_scan(spark, sf_dir):
    base = scratch_path(spark, "dated")
    events = table(spark, sf_dir, "events")
    # Rebalancing keeps the number of files per day down and splits a day that is too large for one.
    events.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.options(**MICROSECONDS).partitionBy("day").json(base)
    return load(spark, base, "day={YYYY}-{MM}-{DD}/*.json", "json", EVENT_COLUMNS, layout="lines")


@query("declared_schema_scan", "SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12, 2)) AS c_acctbal, c_mktsegment FROM customer")
def declared_schema_scan(spark, sf_dir):
    base = scratch_path(spark, "declared")
    table(spark, sf_dir, "customer").write.option("header", True).csv(f"{base}/customers")
    columns = (
        Column("c_custkey", "BIGINT"),
        Column("c_name", "VARCHAR", "display name"),
        Column("c_nationkey", "INTEGER"),
        Column("c_acctbal", "DECIMAL(12,2)"),
        Column("c_mktsegment", "STRING"),
    )
    return load(spark, base, "customers", "csv", columns)


@query(
    "csv_options_scan",
    """SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance
       FROM customer""",
)
def csv_options_scan(spark, sf_dir):
    base = scratch_path(spark, "options")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "NULLIF(c_mktsegment, 'BUILDING') AS segment", "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance"
    )
    customers.write.options(sep="|", nullValue="NA", header=False).csv(f"{base}/customers")
    loaded = load(spark, base, "customers", "csv", delimiter="|", null_value="NA", has_header=False)
    return loaded.selectExpr("CAST(column0 AS BIGINT) AS c_custkey", "column1 AS segment", "column2 AS balance")


@query("gzip_scan", ORDERS)
def gzip_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = scratch_path(spark, "gzip")
    orders.write.options(header=True, compression="gzip").csv(f"{base}/orders")
    return as_written(load(spark, base, "orders/*.csv.gz", "csv", compression="gzip"), orders)


@query("sqlite_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def sqlite_scan(spark, sf_dir):
    base = scratch_path(spark, "sqlite")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    written = parts.mapInPandas(_sqlite_files(base), "path string").collect()
    return as_written(read_sqlite(spark, [row.path for row in written], "part"), parts)


def _sqlite_files(base, rows_per_file=200_000):
    """Each task writes its rows to database files of bounded size in the shared folder."""

    def write(batches):
        task = TaskContext.get()
        database, rows, files = None, 0, 0
        for batch in batches:
            if database is None:
                database, rows = sqlite3.connect(":memory:"), 0
                database.execute(
                    "CREATE TABLE part (p_partkey INTEGER PRIMARY KEY, p_name TEXT, p_brand TEXT, p_size INTEGER, p_retailprice REAL)"
                )
            database.executemany("INSERT INTO part VALUES (?, ?, ?, ?, ?)", batch.astype(object).values.tolist())
            rows += len(batch)
            if rows >= rows_per_file:
                yield _saved(database, f"{base}/{task.partitionId()}-{task.taskAttemptId()}-{files}.db")
                database, files = None, files + 1
        if database is not None:
            yield _saved(database, f"{base}/{task.partitionId()}-{task.taskAttemptId()}-{files}.db")

    return write


def _saved(database, path):
    database.commit()
    write_file(path, database.serialize())
    database.close()
    return pd.DataFrame({"path": [path]})


@query("incremental_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def two_deliveries(spark, sf_dir):
    base = scratch_path(spark, "arrivals")
    events = table(spark, sf_dir, "events")
    early = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(True))
    # The bound is below the size of a delivery, so each is taken in several micro-batches.
    source = FileSource("inbox/*.json", "json", layout="lines", max_batch_size="64KB")
    adapter = Adapter("arrivals", "files", source, EVENT_COLUMNS)
    for delivery in (events.where(early), events.where(~early)):
        delivery.write.options(**MICROSECONDS).mode("append").json(f"{base}/inbox")
        loaded = ingest_new(spark, adapter, LocalFiles(base), f"{base}/table", f"{base}/progress")
    return loaded


@query("incremental_adapter", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def three_deliveries(spark, sf_dir):
    """A declared adapter that takes only new files, in batches below the size of a delivery; the last run finds none."""
    base = scratch_path(spark, "deliveries")
    events, name = table(spark, sf_dir, "events"), f"delivered_{uuid.uuid4().hex}"
    source = FileSource("{YYYY}/*.json", "json", max_batch_size="64KB")
    project = Project().connect("files", LocalFiles(f"{base}/inbox")).add(Adapter(name, "files", source, EVENT_COLUMNS))
    runner = Runner(spark, project, location=f"{base}/tables", state=f"{name}_state")
    day = F.coalesce(F.dayofmonth("ts"), F.lit(1))
    for at, part in enumerate((day < 11, day.between(11, 20), day > 20)):
        events.where(part).write.options(**MICROSECONDS).json(f"{base}/inbox/{2021 + at}")
        runner.run()
    runner.run()
    return spark.table(name)


@query("object_listing_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def object_listing_scan(spark, sf_dir):
    """Keys below a folder by a pattern whose wildcards cross folders, as object stores have them."""
    base = scratch_path(spark, "objects")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations.write.partitionBy("n_regionkey").parquet(f"{base}/geo/nations")
    regions.write.parquet(f"{base}/geo/regions")
    regions.write.json(f"{base}/geo/other")
    columns = (Column("n_nationkey", "INTEGER"), Column("n_name", "STRING"))
    keys = lambda pattern: [r.path for r in matching_objects(spark, base, pattern, {}).collect()]
    read = lambda pattern, columns: read_files(spark, keys(pattern), FileSource("", "parquet"), columns, {})
    one = read("geo/nations/*.parquet", columns).withColumn("key", F.col("_metadata.file_path"))
    one = one.select("n_nationkey", "n_name", F.regexp_extract("key", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"))
    two = read("geo/r*.parquet", (Column("r_regionkey", "INTEGER"), Column("r_name", "STRING")))
    return one.union(two.select("r_regionkey", "r_name", F.lit(None).cast("int")))


@query("catalog_scan", "SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders GROUP BY o_orderpriority")
def catalog_scan(spark, sf_dir):
    name = f"marts.{scratch_name('orders')}"
    create_or_replace(table(spark, sf_dir, "orders"), name, scratch_path(spark, "catalog"))
    return spark.sql(f"SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM {name} GROUP BY o_orderpriority")


@query("ctas_roundtrip", "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus <> 'P'")
def ctas_roundtrip(spark, sf_dir):
    name, place = f"marts.{scratch_name('ctas')}", scratch_path(spark, "ctas")
    create_or_replace(table(spark, sf_dir, "orders"), name, place)
    again = f"SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM {name} WHERE o_orderstatus <> 'P'"
    return create_or_replace(spark.sql(again), name, place)


@query("append_rows", ORDERS)
def append_in_two_steps(spark, sf_dir):
    name = f"marts.{scratch_name('growing')}"
    orders = table(spark, sf_dir, "orders")
    create_or_replace(orders.where("o_orderstatus = 'F'"), name, scratch_path(spark, "append"))
    append_rows(orders.where("NOT (o_orderstatus <=> 'F')").select(*reversed(orders.columns)), name)
    return spark.table(name)


@query(
    "table_schema",
    """SELECT CAST(column_index AS INT) AS position, column_name,
              CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                             ELSE LOWER(data_type) END AS data_type
       FROM duckdb_columns() WHERE table_name = 'lineitem'""",
)
def schema_of_a_table(spark, sf_dir):
    name = scratch_name("described")
    spark.catalog.createTable(name, path=f"{sf_dir}/lineitem.parquet", source="parquet")
    try:
        return table_schema(spark, name)
    finally:
        drop_table(spark, name)  # the catalog's entry; the files are not its own


@query("ingest_to_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def ingest_to_table(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    base = scratch_path(spark, "ingest")
    suppliers.write.json(f"{base}/suppliers")
    name = f"staging.{scratch_name('suppliers')}"
    return as_written(create_or_replace(load(spark, base, "suppliers", "json"), name, f"{base}/store"), suppliers)


