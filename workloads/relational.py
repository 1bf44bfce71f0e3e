"""Relational constructs of everyday model SQL."""

from workloads.registry import sql_query

sql_query(
    "project_alias",
    """SELECT o_orderkey AS order_id, o_custkey AS user_id, o_totalprice AS total_amount, o_orderstatus AS status
       FROM {orders}""",
)

sql_query(
    "filter_predicates",
    """SELECT event_id, user_id, event_type, value FROM {events}
       WHERE value > 5 AND event_type = 'purchase' AND ts >= DATE '2024-01-10' AND (value < 200) = true""",
)

sql_query(
    "inner_join",
    """SELECT o.o_orderkey, o.o_custkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_extendedprice
       FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'""",
)

# Lines are grouped per order before the join, so an order is one row in it whatever its length.
sql_query(
    "left_join_agg",
    """SELECT o.o_orderkey, o.o_orderpriority, l.parcels, l.last_ship > o.o_orderdate + INTERVAL 30 DAYS AS slow
       FROM {orders} o LEFT JOIN (
           SELECT l_orderkey, COUNT(DISTINCT l_suppkey) AS parcels, MAX(l_shipdate) AS last_ship
           FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    """SELECT o_orderkey, o_orderpriority, NULLIF(COUNT(DISTINCT l_suppkey), 0) AS parcels,
              MAX(l_shipdate) > o_orderdate + INTERVAL 30 DAYS AS slow
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = 'F'
       GROUP BY o_orderkey, o_orderpriority, o_orderdate""",
)

sql_query(
    "nested_join",
    """SELECT c.c_custkey, c.c_name, n.n_name, r.r_name
       FROM {customer} c LEFT JOIN ({nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA')
         ON c.c_nationkey = n.n_nationkey""",
)

sql_query(
    "group_by_columns",
    """SELECT c_nationkey, c_mktsegment, MAX(c_acctbal) - MIN(c_acctbal) AS spread, COUNT_IF(c_acctbal < 0) AS in_debt
       FROM {customer} GROUP BY c_nationkey, c_mktsegment""",
)

sql_query(
    "group_by_date",
    """SELECT DATE(l_shipdate) AS shipped_on, l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, MAX(l_quantity) AS largest
       FROM {lineitem} WHERE l_linestatus <> 'O' GROUP BY DATE(l_shipdate), l_returnflag""",
)

sql_query(
    "global_agg",
    """SELECT COUNT(DISTINCT l_partkey) AS parts_sold, MAX(l_tax) AS top_tax, COUNT_IF(l_discount = 0) AS full_price,
              MIN(l_shipdate) AS first_parcel
       FROM {lineitem}""",
)

sql_query(
    "counts",
    """SELECT user_id, COUNT(*) AS all_rows, COUNT(NULLIF(event_type, 'error')) AS good_rows
       FROM {events} GROUP BY user_id""",
)

sql_query(
    "count_distinct",
    """SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT DATE(ts)) AS active_days
       FROM {events} GROUP BY event_type""",
)

sql_query(
    "numeric_aggs",
    """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price,
              ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, AVG(l_quantity) AS avg_qty,
              MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price,
              MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship, COUNT(*) AS n
       FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
)

sql_query(
    "order_by_nulls",
    """SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS priority FROM {orders}
       ORDER BY priority ASC NULLS LAST, o_orderkey DESC""",
)

sql_query(
    "top_k",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)

sql_query(
    "cte_daily",
    """WITH daily AS (
           SELECT DATE(ts) AS event_day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
           FROM {events} GROUP BY DATE(ts), event_type),
       best AS (SELECT event_day, MAX(n) AS n FROM daily GROUP BY event_day)
       SELECT d.event_day, d.event_type, d.n, d.total FROM daily d JOIN best b ON d.event_day = b.event_day AND d.n = b.n""",
)

sql_query(
    "round_avg",
    "SELECT l_suppkey, ROUND(AVG(l_quantity), 2) AS avg_quantity FROM {lineitem} GROUP BY l_suppkey",
    """SELECT l_suppkey, CAST(ROUND(CAST(AVG(l_quantity) AS DECIMAL(28, 10)), 2) AS DOUBLE) AS avg_quantity
       FROM lineitem GROUP BY l_suppkey""",
)

sql_query(
    "date_fn",
    """SELECT event_id, DATE(ts) AS event_date, DATE(SUBSTRING(CAST(ts AS STRING), 1, 10)) AS date_of_text FROM {events}""",
)

sql_query(
    "cast_timestamp",
    """SELECT event_id, CAST(CAST(ts AS STRING)::TIMESTAMP AS TIMESTAMP_NTZ) AS event_time FROM {events}""",
    "SELECT event_id, CAST(ts AS STRING)::TIMESTAMP AS event_time FROM events",
)

sql_query(
    "interval_filter",
    """SELECT DATE(ts) AS event_date, COUNT(*) AS n, COUNT(DISTINCT user_id) AS active_users FROM {events}
       WHERE ts >= DATE '2024-01-31' - INTERVAL '7 days' OR ts < DATE '2024-01-10' - INTERVAL 3 DAY
       GROUP BY DATE(ts)""",
)

sql_query(
    "like_filter",
    "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring%' OR p_name LIKE 'hot _e%' ORDER BY p_name, p_partkey",
)
