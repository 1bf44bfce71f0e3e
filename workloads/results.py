"""Ad-hoc and saved queries, text rows, chart series."""

from __future__ import annotations

import uuid

from tidemill import Dashboard, FileSource, Project, Query
from tidemill.functions.results import describe_query, rows_as_text
from tidemill.plans.project import Runner
from tidemill.session import scratch_path
from tidemill.sources.files import read_files
from workloads.registry import query, sql_query, table

sql_query(
    "adhoc_sql",
    """SELECT r.r_name, n.n_name, COUNT(*) AS orders_placed, ROUND(SUM(o.o_totalprice), 2) AS revenue
       FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
       JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
       GROUP BY r.r_name, n.n_name""",
)


def saved(spark, sf_dir, *specs_of_view, of="orders"):
    """A runner whose saved queries read a view over one of the tables."""
    view = f"{of}_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, of).createOrReplaceTempView(view)
    return Runner(spark, Project().add(*[spec(view) for spec in specs_of_view]))


@query(
    "saved_query",
    """SELECT o_orderpriority, COUNT(*) AS n, MIN(o_orderdate) AS first_order FROM orders
       WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""",
)
def saved_query(spark, sf_dir):
    text = "SELECT o_orderpriority, COUNT(*) AS n, MIN(o_orderdate) AS first_order FROM {} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority"
    return saved(spark, sf_dir, lambda view: Query("open_orders", text.format(view))).query("open_orders")


@query(
    "string_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
              CAST(o_orderdate AS VARCHAR) AS o_orderdate, COALESCE(NULLIF(o_orderstatus, 'P'), 'NULL') AS status,
              CAST(o_totalprice > 100000 AS VARCHAR) AS is_large
       FROM orders""",
)
def string_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rows_as_text(
        orders.selectExpr("o_orderkey", "o_totalprice", "o_orderdate", "NULLIF(o_orderstatus, 'P') AS status", "o_totalprice > 100000 AS is_large")
    )


@query(
    "describe_query",
    """SELECT CAST(ROW_NUMBER() OVER () AS INT) AS position, column_name,
              CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' ELSE LOWER(column_type) END AS data_type
       FROM (DESCRIBE SELECT event_type, COUNT(*) AS n, MAX(value) AS largest, MIN(CAST(ts AS DATE)) AS first_day FROM events GROUP BY event_type)""",
)
def describe_over_inferred_types(spark, sf_dir):
    """The types come from inference over all rows of a CSV export."""
    path = scratch_path(spark, "described")
    table(spark, sf_dir, "events").write.options(header=True, escape='"').csv(path)
    events = read_files(spark, path, FileSource(path))
    text = "SELECT event_type, COUNT(*) AS n, MAX(value) AS largest, MIN(CAST(ts AS DATE)) AS first_day FROM {events} GROUP BY event_type"
    return describe_query(spark.sql(text, events=events))


@query(
    "chart_series_line",
    """SELECT CAST(HOUR(ts) AS VARCHAR) AS label, CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS value_text
       FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""",
)
def visitors_by_hour(spark, sf_dir):
    text = """SELECT HOUR(ts) AS hour, COUNT(DISTINCT user_id) AS visitors FROM {}
              WHERE event_type IN ('click', 'view') GROUP BY HOUR(ts) ORDER BY hour"""
    return saved(
        spark, sf_dir,
        lambda view: Query("by_hour", text.format(view)),
        lambda _: Dashboard("by_hour", "by_hour", "line", "hour", "visitors"),
        of="events",
    ).dashboard("by_hour")


@query(
    "chart_series_bar",
    """SELECT o_orderpriority AS label, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(COUNT(*) AS DOUBLE) END AS value,
              CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' END AS value_text
       FROM orders GROUP BY o_orderpriority""",
)
def orders_by_priority(spark, sf_dir):
    text = """SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(COUNT(*) AS STRING) END AS n
              FROM {} GROUP BY o_orderpriority ORDER BY o_orderpriority"""
    return saved(
        spark, sf_dir,
        lambda view: Query("mix", text.format(view)),
        lambda _: Dashboard("mix", "mix", "bar", "o_orderpriority", "n"),
    ).dashboard("mix")
