"""SQL families users reach because model and query text is unrestricted."""

from pyspark.sql import functions as F

from tidemill.functions.semistructured import typed_columns
from tidemill.operators.asof import asof_join
from tidemill.operators.inequality import inequality_join, overlap_join
from tidemill.operators.prefix import Near, Rank, Running, prefix_windows
from tidemill.operators.ranges import range_join
from tidemill.operators.sketches import exact_distinct, merge, sketch, store
from tidemill.session import materialize, scratch_path
from workloads.registry import query, sql_query, table

# Both sides are grouped by month before the join: every key is one row on each side.
sql_query(
    "outer_joins",
    """SELECT COALESCE(o.month_start, l.month_start) AS month_start, o.orders_placed, l.lines_shipped
       FROM (SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, COUNT(*) AS orders_placed
             FROM {orders} GROUP BY 1) o
       FULL OUTER JOIN (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month_start, COUNT(*) AS lines_shipped
             FROM {lineitem} GROUP BY 1) l
         ON o.month_start = l.month_start""",
)

sql_query(
    "right_join",
    """SELECT c.c_custkey, c.c_mktsegment, e.n_events
       FROM (SELECT user_id, COUNT(*) AS n_events FROM {events} GROUP BY user_id) e
       RIGHT JOIN {customer} c ON e.user_id = c.c_custkey""",
)

# Keys on the right are made distinct first, so a customer with many orders is one row there.
sql_query(
    "semi_anti_join",
    """SELECT c.c_custkey, c.c_name FROM {customer} c
       LEFT SEMI JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') u ON c.c_custkey = u.o_custkey
       LEFT ANTI JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '5-LOW') w ON c.c_custkey = w.o_custkey""",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
         AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""",
)


@query(
    "range_join",
    """SELECT q.quarter_start, COUNT(*) AS n_lines, SUM(l_quantity) AS quantity
       FROM lineitem JOIN (
           SELECT CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS quarter_start,
                  MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order
           FROM orders GROUP BY 1) q ON l_shipdate BETWEEN q.first_order AND q.last_order
       GROUP BY q.quarter_start""",
)
def range_join_quarters(spark, sf_dir):
    day = lambda column: F.unix_date(F.to_date(column))
    lines = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("ship_day"), "l_quantity")
    quarters = (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter_start"))
        .agg(F.min(day("o_orderdate")).alias("first_day"), F.max(day("o_orderdate")).alias("last_day"))
    )
    return (
        range_join(lines, quarters, "ship_day", "first_day", "last_day")
        .groupBy("quarter_start")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    )


@query(
    "asof_join",
    """SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts, c.value AS click_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def last_click_before_purchase(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    clicks = events.where("event_type = 'click'").selectExpr(
        "user_id", "event_id AS click_id", "ts AS click_ts", "value AS click_value"
    )
    return asof_join(purchases, clicks, ["user_id"], "ts", "click_ts", "event_id", "click_id")


sql_query(
    "having_filter",
    """SELECT l_partkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
              COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_quantity) AS distinct_quantity
       FROM {lineitem} GROUP BY l_partkey HAVING COUNT(*) >= 35""",
)

sql_query(
    "grouping_sets",
    """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS INT) AS over_flags, COUNT(*) AS n, SUM(l_quantity) AS quantity
       FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
)

sql_query(
    "cube_totals",
    """SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS all_statuses,
              CAST(GROUPING(o_orderpriority) AS INT) AS all_priorities, COUNT(*) AS n
       FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)

sql_query(
    "rollup_totals",
    """SELECT EXTRACT(YEAR FROM o_orderdate) AS order_year, EXTRACT(MONTH FROM o_orderdate) AS order_month, COUNT(*) AS n
       FROM {orders} GROUP BY ROLLUP (EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate))""",
    """SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS order_year, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS order_month,
              COUNT(*) AS n
       FROM orders GROUP BY ROLLUP (EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate))""",
)

# Rank filters are applied before the shuffle too, so at most three rows per customer and task move.
sql_query(
    "window_rank",
    """SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
           SELECT o_custkey, o_orderkey, o_totalprice,
                  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
           FROM {orders}) ranked WHERE place <= 3""",
)

# Windows run over one row per event type and day, so their size is set by the calendar.
sql_query(
    "window_frame",
    """WITH daily AS (SELECT event_type, DATE(ts) AS event_day, COUNT(*) AS n FROM {events} GROUP BY event_type, DATE(ts))
       SELECT event_type, event_day, n,
              LAG(n) OVER (PARTITION BY event_type ORDER BY event_day) AS day_before,
              LEAD(n, 2) OVER (PARTITION BY event_type ORDER BY event_day) AS two_days_later,
              CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far,
              AVG(n) OVER (PARTITION BY event_type ORDER BY event_day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_rows,
              MAX(n) OVER (PARTITION BY event_type ORDER BY event_day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS best_of_days,
              CAST(DENSE_RANK() OVER (PARTITION BY event_type ORDER BY n DESC) AS BIGINT) AS busy_rank
       FROM daily""",
)

sql_query(
    "set_ops",
    """SELECT 'intersect' AS op, o_custkey AS k FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'F'
           INTERSECT SELECT DISTINCT user_id FROM {events} WHERE event_type = 'signup') a
       UNION ALL SELECT 'except', o_custkey FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'F'
           EXCEPT SELECT DISTINCT user_id FROM {events} WHERE event_type = 'signup') b
       UNION ALL SELECT 'union', o_custkey FROM (SELECT o_custkey FROM {orders} UNION SELECT user_id FROM {events}) c""",
)

sql_query(
    "set_ops_all",
    """SELECT 'intersect all' AS op, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linestatus = 'F'
           INTERSECT ALL SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'R') a
       UNION ALL SELECT 'except all', l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linestatus = 'F'
           EXCEPT ALL SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'R') b""",
)

sql_query(
    "scalar_fns",
    """SELECT p_partkey, UPPER(p_name) AS upper_name, CAST(LENGTH(p_name) AS BIGINT) AS name_length, SUBSTRING(p_brand, 7) AS brand_no,
              CONCAT(p_type, '/', p_brand) AS label, REPLACE(p_name, ' ', '_') AS slug, TRIM(CONCAT('  ', p_type, ' ')) AS trimmed,
              LPAD(p_type, 10, '*') AS padded, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
              ABS(p_size - 25) AS from_middle, MOD(p_size, 7) AS remainder, GREATEST(p_size, 20) AS at_least, LEAST(p_size, 20) AS at_most,
              COALESCE(NULLIF(p_type, 'SMALL'), 'none') AS type_or_none, ROUND(p_retailprice * 2, 1) AS doubled,
              FLOOR(p_retailprice / 100) AS hundreds, SQRT(p_size * p_size) AS root, SPLIT_PART(p_name, ' ', 2) AS noun
       FROM {part}""",
    """SELECT p_partkey, UPPER(p_name) AS upper_name, CAST(LENGTH(p_name) AS BIGINT) AS name_length, SUBSTRING(p_brand, 7) AS brand_no,
              CONCAT(p_type, '/', p_brand) AS label, REPLACE(p_name, ' ', '_') AS slug, TRIM(CONCAT('  ', p_type, ' ')) AS trimmed,
              LPAD(p_type, 10, '*') AS padded, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
              ABS(p_size - 25) AS from_middle, MOD(p_size, 7) AS remainder, GREATEST(p_size, 20) AS at_least, LEAST(p_size, 20) AS at_most,
              COALESCE(NULLIF(p_type, 'SMALL'), 'none') AS type_or_none, ROUND(p_retailprice * 2, 1) AS doubled,
              CAST(FLOOR(p_retailprice / 100) AS BIGINT) AS hundreds, SQRT(p_size * p_size) AS root, SPLIT_PART(p_name, ' ', 2) AS noun
       FROM part""",
)

sql_query(
    "date_fns",
    """SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, QUARTER(o_orderdate) AS q,
              DAYOFYEAR(o_orderdate) AS day_no, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start,
              DATEDIFF(DATE(o_orderdate), DATE '1995-01-01') AS days_in, LAST_DAY(DATE(o_orderdate)) AS month_end,
              o_orderdate + INTERVAL 36 HOUR AS later
       FROM {orders}""",
    """SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(DAY(o_orderdate) AS INT) AS d,
              CAST(QUARTER(o_orderdate) AS INT) AS q, CAST(DAYOFYEAR(o_orderdate) AS INT) AS day_no,
              CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start,
              CAST(DATE_DIFF('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days_in, LAST_DAY(CAST(o_orderdate AS DATE)) AS month_end,
              o_orderdate + INTERVAL 36 HOUR AS later
       FROM orders""",
)

sql_query(
    "json_extract",
    """SELECT event_type, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
       FROM {events} GROUP BY 1, 2""",
    """SELECT event_type, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n, ROUND(SUM(value), 2) AS total
       FROM events GROUP BY 1, 2""",
)

sql_query(
    "array_ops",
    """SELECT label, pos AS dimension, COUNT(*) AS n, COUNT(*) FILTER (WHERE x > 0) AS positive, MAX(x) AS largest
       FROM {embeddings} LATERAL VIEW POSEXPLODE(embedding) e AS pos, x GROUP BY label, pos""",
    """SELECT label, pos AS dimension, COUNT(*) AS n, COUNT(*) FILTER (WHERE x > 0) AS positive, MAX(x) AS largest
       FROM (SELECT label, UNNEST(embedding) AS x, CAST(UNNEST(RANGE(LEN(embedding))) AS INT) AS pos FROM embeddings)
       GROUP BY label, pos""",
)

sql_query(
    "array_lambda",
    """SELECT vec_id, SIZE(embedding) AS n, SIZE(FILTER(embedding, x -> x > 0)) AS positive, ARRAY_MAX(embedding) AS largest,
              SIZE(ARRAY_DISTINCT(TRANSFORM(embedding, x -> SIGN(x)))) AS signs, embedding[0] AS first_value
       FROM {embeddings}""",
    """SELECT vec_id, CAST(LEN(embedding) AS INT) AS n, CAST(LEN(LIST_FILTER(embedding, lambda x: x > 0)) AS INT) AS positive, LIST_MAX(embedding) AS largest,
              CAST(LEN(LIST_DISTINCT(LIST_TRANSFORM(embedding, lambda x: SIGN(x)))) AS INT) AS signs, embedding[1] AS first_value
       FROM embeddings""",
)


@query(
    "approx_aggs",
    """SELECT event_type, measure, true AS within_bound FROM (SELECT DISTINCT event_type FROM events),
              (VALUES ('users'), ('0.25'), ('0.5'), ('0.95')) AS m(measure)""",
)
def approximate(spark, sf_dir):
    """Sketches beside exact results: distinct users within 5 %, quantiles within 1 % of the ranks."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    quantiles = (0.25, 0.5, 0.95)
    about = events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.01).alias("users"),
        F.percentile_approx("value", list(quantiles), 10_000).alias("values"),
    )
    # Apart from the sketches: beside a distinct count these would be kept for each type and user.
    exact = events.groupBy(F.col("event_type").alias("exact_type")).agg(F.count_distinct("user_id").alias("exact_users"))
    about = about.join(exact, F.col("event_type").eqNullSafe(F.col("exact_type"))).drop("exact_type")
    # How many rows lie below and up to each quantile, counted by one more pass over the rows.
    few = F.broadcast(about)  # one row for each event type
    ranks = events.join(few, "event_type").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("value") < F.col("values")[i]).alias(f"below{i}") for i in range(len(quantiles))],
        *[F.count_if(F.col("value") <= F.col("values")[i]).alias(f"upto{i}") for i in range(len(quantiles))],
    )
    users = about.select("event_type", F.lit("users").alias("measure"), (F.abs(F.col("users") - F.col("exact_users")) <= 0.05 * F.col("exact_users")).alias("within_bound"))
    for i, q in enumerate(quantiles):
        slack = 0.01 * F.col("n") + 1
        near = (F.col(f"below{i}") - slack <= q * F.col("n")) & (q * F.col("n") <= F.col(f"upto{i}") + slack)
        users = users.union(ranks.select("event_type", F.lit(str(q)), near))
    return users


# The outer table has one row per key; the busy side is only ever aggregated.
sql_query(
    "subqueries",
    """SELECT c_custkey, c_acctbal, (SELECT MAX(o_orderdate) FROM {orders} WHERE o_custkey = c_custkey) AS last_order
       FROM {customer}
       WHERE c_acctbal * 50 > (SELECT AVG(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey)
         AND c_acctbal > (SELECT AVG(s_acctbal) FROM {supplier})
         AND c_nationkey IN (SELECT n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')""",
)


_DAYS = "SELECT event_id, event_type, ts::DATE AS day, floor(value * 1000)::BIGINT AS mills FROM events"
_OVER_ALL = "OVER (ORDER BY day NULLS FIRST, event_id NULLS FIRST"


@query(
    "window_global",
    f"""
    SELECT *, row_number() {_OVER_ALL}) AS place, rank() OVER (ORDER BY day NULLS FIRST) AS day_rank,
           dense_rank() OVER (ORDER BY day NULLS FIRST) AS day_number,
           (sum(mills) {_OVER_ALL} ROWS UNBOUNDED PRECEDING))::BIGINT AS running,
           lag(event_type, 1) {_OVER_ALL}) AS type_before,
           (sum(mills) {_OVER_ALL} ROWS 9 PRECEDING))::BIGINT AS last_ten
    FROM ({_DAYS})
    """,
)
def window_global(spark, sf_dir):
    """Windows over all events in one order; no task sees them all."""
    events = table(spark, sf_dir, "events")
    days = events.select("event_id", "event_type", F.to_date("ts").alias("day"), F.floor(F.col("value") * 1000).alias("mills"))
    columns = {
        "place": Rank("row_number"), "day_rank": Rank("rank"), "day_number": Rank("dense_rank"),
        "running": Running("sum", "mills"), "type_before": Near("lag", "event_type"), "last_ten": Near("sum", "mills", 9),
    }
    return prefix_windows(days, ["day"], columns, unique=["event_id"])


_BY_TYPE = "OVER (PARTITION BY event_type ORDER BY day NULLS FIRST, event_id NULLS FIRST"


@query(
    "window_hot_key",
    f"""
    SELECT *, row_number() {_BY_TYPE}) AS place, rank() OVER (PARTITION BY event_type ORDER BY day NULLS FIRST) AS day_rank,
           (sum(mills) {_BY_TYPE} ROWS UNBOUNDED PRECEDING))::BIGINT AS running,
           max(mills) {_BY_TYPE} ROWS UNBOUNDED PRECEDING) AS highest,
           lead(event_id, 2) {_BY_TYPE}) AS second_next
    FROM ({_DAYS})
    """,
)
def window_hot_key(spark, sf_dir):
    """Windows over very few keys, each with a large share of all rows."""
    events = table(spark, sf_dir, "events")
    days = events.select("event_id", "event_type", F.to_date("ts").alias("day"), F.floor(F.col("value") * 1000).alias("mills"))
    columns = {
        "place": Rank("row_number"), "day_rank": Rank("rank"), "running": Running("sum", "mills"),
        "highest": Running("max", "mills"), "second_next": Near("lead", "event_id", 2),
    }
    return prefix_windows(days, ["day"], columns, ["event_type"], ["event_id"])


@query(
    "overlap_join",
    """
    WITH shipping AS (
        SELECT l_orderkey, min(epoch(l_shipdate) // 86400)::BIGINT AS first_day, max(epoch(l_shipdate) // 86400)::BIGINT AS last_day
        FROM lineitem GROUP BY l_orderkey
    ),
    debuts AS (SELECT l_suppkey, min(epoch(l_shipdate) // 86400)::BIGINT AS opens FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, count(*) AS orders_under_way, sum(last_day - first_day)::BIGINT AS days_shipped
    FROM shipping JOIN debuts ON first_day <= opens + 30 AND last_day >= opens
    GROUP BY l_suppkey
    """,
)
def orders_under_way(spark, sf_dir):
    """Orders whose lines were shipping while a supplier had its first month."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.unix_date(F.to_date("l_shipdate")).cast("bigint"))
    shipping = lines.groupBy("l_orderkey").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    debuts = lines.groupBy("l_suppkey").agg(F.min("day").alias("opens"), (F.min("day") + 30).alias("closes"))
    shipping = shipping.withColumn("days", F.col("last_day") - F.col("first_day"))
    totals = {"orders_under_way": ("count", None), "days_shipped": ("sum", "days")}
    pairs = overlap_join(debuts, shipping, ("opens", "closes"), ("first_day", "last_day"), totals)
    return pairs.groupBy("l_suppkey").agg(F.sum("orders_under_way").alias("orders_under_way"), F.sum("days_shipped").alias("days_shipped"))


@query(
    "inequality_join",
    """
    SELECT a.p_brand, count(*) AS pairs, min(b.p_retailprice - a.p_retailprice) AS least_gain
    FROM part a JOIN part b ON a.p_retailprice < b.p_retailprice AND a.p_size >= b.p_size + 45
    GROUP BY a.p_brand
    """,
)
def larger_for_less(spark, sf_dir):
    """Pairs of parts of which the far larger one is cheaper: two inequalities, no equality."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    others = parts.select((F.col("p_size") + 45).alias("least_size"), F.col("p_retailprice").alias("price"))
    totals = {"pairs": ("count", None), "least_price": ("min", "price")}
    pairs = inequality_join(parts, others, ("p_retailprice", "<", "price"), ("p_size", ">=", "least_size"), totals=totals)
    # A part's least gain is to the cheapest of its pairs, also after rounding.
    return pairs.groupBy("p_brand").agg(F.sum("pairs").alias("pairs"), F.min(F.col("least_price") - F.col("p_retailprice")).alias("least_gain"))


@query(
    "merged_sketches",
    """
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close
    FROM events GROUP BY event_type
    """,
)
def merged_sketches(spark, sf_dir):
    """Rows, users and the median of each type from sketches stored by day; users also exact, from bitmaps."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value", "ts")
    path = scratch_path(spark, "sketches")
    store(sketch(events, F.to_date("ts"), ["event_type"], "user_id", "value"), path)
    # One row for each event type; as a table its size is known, and it is broadcast only if small.
    about = materialize(merge(spark, path, ["event_type"], [0.5]).withColumnsRenamed({"n": "total", "distinct": "about"}))
    ranks = events.join(about.select("event_type", F.col("quantiles")[0].alias("median")), "event_type")
    shares = ranks.groupBy("event_type").agg((F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("share"))
    exact = exact_distinct(events, ["event_type"], "user_id")
    return about.join(exact, "event_type").join(shares, "event_type").select(
        "event_type", F.col("total").alias("n"), F.col("exact").alias("users"),
        (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("users_close"),
        (F.abs(F.col("share") - 0.5) <= 0.02).alias("median_close"),
    )


@query(
    "json_discovered",
    """
    SELECT event_type, count(*) AS n, count(k) AS with_k, min(k) AS least, max(k) AS most, sum(k)::BIGINT AS total
    FROM (SELECT event_type, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type
    """,
)
def json_discovered(spark, sf_dir):
    """Sums over a JSON field whose name and type are found in the data."""
    typed = typed_columns(table(spark, sf_dir, "events").select("event_type", "props"), "props")
    return typed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("props_k").alias("with_k"), F.min("props_k").alias("least"),
        F.max("props_k").alias("most"), F.sum("props_k").alias("total"),
    )


# A customer's map has one entry for each status; counting comes first, so none grows with the orders.
sql_query(
    "map_struct_ops",
    """WITH counted AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS newest FROM {orders} GROUP BY o_custkey, o_orderstatus),
       grouped AS (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS by_status,
                          max(struct(newest, o_orderstatus)) AS latest FROM counted GROUP BY o_custkey)
       SELECT o_custkey, by_status['F'] AS f_orders, size(by_status) AS statuses, array_join(array_sort(map_keys(by_status)), ',') AS status_list,
              aggregate(map_values(map_filter(by_status, (k, v) -> k <> 'P')), 0L, (a, v) -> a + v) AS not_p,
              latest.newest AS newest, latest.o_orderstatus AS newest_status FROM grouped""",
    """WITH counted AS (SELECT o_custkey, o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS newest FROM orders GROUP BY o_custkey, o_orderstatus)
       SELECT o_custkey, (max(n) FILTER (o_orderstatus = 'F'))::BIGINT AS f_orders, count(*)::INTEGER AS statuses,
              string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS status_list, coalesce(sum(n) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS not_p,
              max(newest) AS newest, max({'newest': newest, 'status': o_orderstatus}).status AS newest_status
       FROM counted GROUP BY o_custkey""",
)
