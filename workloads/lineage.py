"""Lineage, change and freshness over a graph of the provided entities.

Regions, nations, customers, orders, parts and suppliers are the nodes (a letter and a key);
``region -> nation -> customer -> order -> part -> supplier`` and ``nation -> supplier`` are
the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import changes, freshness, graph, runs, versions
from tidemill.operators.prefix import Near, prefix_windows
from tidemill.session import scratch_path
from workloads.registry import query, table

_EDGE_SQL = {
    "rn": "SELECT 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nc": "SELECT 'N' || c_nationkey AS src, 'C' || c_custkey AS dst FROM customer",
    "co": "SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders",
    "op": "SELECT DISTINCT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst FROM lineitem",
    "ps": "SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem",
    "ns": "SELECT 'N' || s_nationkey AS src, 'S' || s_suppkey AS dst FROM supplier",
}
_NODES_SQL = """
SELECT 'R' || r_regionkey AS name FROM region UNION ALL SELECT 'N' || n_nationkey FROM nation
UNION ALL SELECT 'C' || c_custkey FROM customer UNION ALL SELECT 'O' || o_orderkey FROM orders
UNION ALL SELECT 'P' || p_partkey FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier
"""


def _edges_sql(*kinds):
    return " UNION ALL ".join(_EDGE_SQL[k] for k in kinds or _EDGE_SQL)


def _closure_sql(edges, start, tail="SELECT name FROM reached", **extra):
    """Closure by recursion; UNION drops what was reached before."""
    parts = "".join(f", {name} AS ({sql})" for name, sql in extra.items())
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}){parts}, reached AS (
        {start} UNION SELECT e.dst FROM reached JOIN e ON e.src = reached.name) {tail}"""


def _tag(letter, column):
    return F.concat(F.lit(letter), F.col(column))


def _link(df, src, dst) -> DataFrame:
    return df.select(_tag(*src).alias("src"), _tag(*dst).alias("dst"))


def edges_of(spark, sf_dir, *kinds) -> DataFrame:
    """The edges of the given kinds, all of them by default."""
    t = lambda name: table(spark, sf_dir, name)
    build = {
        "rn": lambda: _link(t("nation"), ("R", "n_regionkey"), ("N", "n_nationkey")),
        "nc": lambda: _link(t("customer"), ("N", "c_nationkey"), ("C", "c_custkey")),
        "co": lambda: _link(t("orders"), ("C", "o_custkey"), ("O", "o_orderkey")),
        "op": lambda: _link(t("lineitem").select("l_orderkey", "l_partkey").distinct(), ("O", "l_orderkey"), ("P", "l_partkey")),
        "ps": lambda: _link(t("lineitem").select("l_partkey", "l_suppkey").distinct(), ("P", "l_partkey"), ("S", "l_suppkey")),
        "ns": lambda: _link(t("supplier"), ("N", "s_nationkey"), ("S", "s_suppkey")),
    }
    return _stack(*[build[k]() for k in kinds or build])


def nodes_of(spark, sf_dir, letters="RNCOPS") -> DataFrame:
    keys = {
        "R": ("region", "r_regionkey"), "N": ("nation", "n_nationkey"), "C": ("customer", "c_custkey"),
        "O": ("orders", "o_orderkey"), "P": ("part", "p_partkey"), "S": ("supplier", "s_suppkey"),
    }
    return _stack(*[table(spark, sf_dir, keys[x][0]).select(_tag(x, keys[x][1]).alias("name")) for x in letters])


def _stack(*parts):
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def names_where(spark, sf_dir, name, letter, key, condition) -> DataFrame:
    return table(spark, sf_dir, name).where(condition).select(_tag(letter, key).alias("name"))


@query(
    "lineage_downstream",
    _closure_sql(_edges_sql(), "SELECT 'R' || r_regionkey AS name FROM region WHERE r_name IN ('ASIA', 'EUROPE')"),
)
def lineage_downstream(spark, sf_dir):
    start = names_where(spark, sf_dir, "region", "R", "r_regionkey", "r_name IN ('ASIA', 'EUROPE')")
    return graph.downstream(edges_of(spark, sf_dir), start)


@query(
    "lineage_upstream",
    _closure_sql(
        f"SELECT dst AS src, src AS dst FROM ({_edges_sql()})",
        "SELECT 'P' || p_partkey AS name FROM part WHERE p_size = 50 AND p_type = 'ECONOMY'",
    ),
)
def lineage_upstream(spark, sf_dir):
    start = names_where(spark, sf_dir, "part", "P", "p_partkey", "p_size = 50 AND p_type = 'ECONOMY'")
    return graph.upstream(edges_of(spark, sf_dir), start)


@query(
    "lineage_adjacency",
    f"SELECT n.name, e.dst AS successor FROM ({_NODES_SQL}) n LEFT JOIN ({_edges_sql()}) e ON n.name = e.src",
)
def lineage_adjacency(spark, sf_dir):
    return graph.adjacency(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


@query(
    "lineage_levels",
    f"""WITH RECURSIVE e AS MATERIALIZED ({_edges_sql()}), n AS ({_NODES_SQL}), walk AS (
            SELECT name, 0 AS level FROM n WHERE name NOT IN (SELECT dst FROM e)
            UNION SELECT e.dst, walk.level + 1 FROM walk JOIN e ON e.src = walk.name)
        SELECT name, CAST(MAX(level) AS INT) AS level FROM walk GROUP BY name""",
)
def lineage_levels(spark, sf_dir):
    return graph.levels(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


_RETURNS = "SELECT DISTINCT 'P' || l_partkey AS src, 'O' || l_orderkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50"


@query(
    "lineage_cycles",
    _closure_sql(
        f"{_edges_sql()} UNION ALL {_RETURNS}",
        f"SELECT src AS name FROM ({_RETURNS}) UNION SELECT dst FROM ({_RETURNS})",
    ),
)
def lineage_cycles(spark, sf_dir):
    """Large returned lines lead from the part back to its order, which closes cycles."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity = 50")
    back = _link(returned.select("l_partkey", "l_orderkey").distinct(), ("P", "l_partkey"), ("O", "l_orderkey"))
    return graph.cycle_remainder(_stack(edges_of(spark, sf_dir), back))


@query(
    "lineage_dangling",
    f"""SELECT src, dst FROM ({_edges_sql("co")})
        WHERE src NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def lineage_dangling(spark, sf_dir):
    known = names_where(spark, sf_dir, "customer", "C", "c_custkey", "c_acctbal >= 0")
    return graph.dangling(known, edges_of(spark, sf_dir, "co"))


@query(
    "induced_subgraph",
    f"""WITH keep AS (SELECT 'C' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
            UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_size > 25)
        SELECT 'node' AS part, name, CAST(NULL AS VARCHAR) AS dst FROM ({_NODES_SQL}) WHERE name IN (SELECT name FROM keep)
        UNION ALL SELECT 'edge', src, dst FROM ({_edges_sql()})
        WHERE src IN (SELECT name FROM keep) AND dst IN (SELECT name FROM keep)""",
)
def induced_subgraph(spark, sf_dir):
    keep = _stack(
        names_where(spark, sf_dir, "customer", "C", "c_custkey", "c_mktsegment = 'BUILDING'"),
        names_where(spark, sf_dir, "orders", "O", "o_orderkey", "o_orderpriority = '1-URGENT'"),
        names_where(spark, sf_dir, "part", "P", "p_partkey", "p_size > 25"),
    )
    nodes, edges = graph.induced_subgraph(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), keep)
    return nodes.selectExpr("'node' AS part", "name", "CAST(NULL AS STRING) AS dst").unionByName(
        edges.selectExpr("'edge' AS part", "src AS name", "dst")
    )


@query(
    "snapshot_diff",
    """SELECT o_orderkey, CASE WHEN o_orderdate < DATE '2001-01-01' THEN 'removed' ELSE 'added' END AS change
       FROM orders WHERE (o_orderdate < DATE '2001-01-01') <> (o_orderstatus <> 'P')""",
)
def snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return changes.snapshot_diff(
        orders.where("o_orderdate < DATE '2001-01-01'"), orders.where("o_orderstatus <> 'P'"), ["o_orderkey"]
    )


@query(
    "config_changed",
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate < DATE '2001-01-01' AND (o_orderpriority = '5-LOW' OR o_orderstatus = 'P')""",
)
def config_changed(spark, sf_dir):
    """Price is not significant here, so its change alone does not count."""
    last = table(spark, sf_dir, "orders").where("o_orderdate < DATE '2001-01-01'")
    current = table(spark, sf_dir, "orders").withColumns(
        {
            "o_orderpriority": F.regexp_replace("o_orderpriority", "5-LOW", "4-NOT SPECIFIED"),
            "o_orderstatus": F.expr("NULLIF(o_orderstatus, 'P')"),
            "o_totalprice": F.col("o_totalprice") + 1,
        }
    )
    return changes.content_changes(last, current, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])


_LAST_ORDERS = "o_orderdate < DATE '2001-07-01'"
_CURRENT_ORDERS = "o_orderdate >= DATE '1995-02-01'"


def _version_edges_sql(condition):
    return f"""SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders WHERE {condition}
        UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {condition})"""


@query(
    "affected_nodes",
    _closure_sql(
        _version_edges_sql(_CURRENT_ORDERS),
        """SELECT DISTINCT name FROM (
             SELECT 'O' || o_orderkey AS name FROM orders WHERE o_orderdate >= DATE '2001-07-01' OR o_orderdate < DATE '1995-02-01'
             UNION ALL SELECT dst FROM added UNION ALL SELECT dst FROM removed
             UNION ALL SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < -500)""",
        """SELECT name FROM reached WHERE name NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderdate < DATE '1995-02-01')""",
        last_e=_version_edges_sql(_LAST_ORDERS),
        added="SELECT * FROM e EXCEPT SELECT * FROM last_e",
        removed="SELECT * FROM last_e EXCEPT SELECT * FROM e",
    ),
)
def affected_nodes(spark, sf_dir):
    """Two versions of the graph, old orders dropped and new ones added, some customers changed."""

    def version(condition):
        orders = table(spark, sf_dir, "orders").where(condition)
        lines = table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"), "left_semi")
        placed = _link(orders, ("C", "o_custkey"), ("O", "o_orderkey"))
        names = nodes_of(spark, sf_dir, "CP").unionByName(orders.select(_tag("O", "o_orderkey").alias("name")))
        return names, placed.unionByName(_link(lines, ("O", "l_orderkey"), ("P", "l_partkey")))

    (last_nodes, last_edges), (nodes, edges) = version(_LAST_ORDERS), version(_CURRENT_ORDERS)
    changed = names_where(spark, sf_dir, "customer", "C", "c_custkey", "c_acctbal < -500")
    return changes.affected(last_nodes, nodes, last_edges, edges, changed)


@query(
    "freshness_upsert",
    """SELECT 'C' || o_custkey AS name, MAX(o_orderdate) AS updated_at FROM orders
       WHERE o_orderdate >= DATE '2000-01-01' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01')
       GROUP BY o_custkey""",
)
def freshness_upsert(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(_tag("C", "o_custkey").alias("name"), F.col("o_orderdate").alias("updated_at"))
    recent = F.col("updated_at") >= F.lit("2000-01-01").cast("timestamp_ntz")
    existing = seen.where(~recent).groupBy("name").agg(F.max("updated_at").alias("updated_at"))
    return freshness.upsert_freshness(existing, seen.where(recent))


@query(
    "oldest_dependency",
    """SELECT 'P' || l_partkey AS name, MIN(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS oldest_input_at
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""",
)
def oldest_dependency(spark, sf_dir):
    """Parts depend on the orders they are in; open orders have no time yet."""
    return freshness.oldest_input(edges_of(spark, sf_dir, "op"), _order_times(spark, sf_dir))


def _order_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        _tag("O", "o_orderkey").alias("name"), F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS updated_at")
    )


@query(
    "invalidate_downstream",
    _closure_sql(
        _edges_sql("nc", "co"),
        "SELECT 'N' || n_nationkey AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'",
        """SELECT 'O' || o_orderkey AS name, CASE WHEN o_orderstatus <> 'P' AND r.name IS NULL THEN o_orderdate END AS updated_at
           FROM orders LEFT JOIN reached r ON r.name = 'O' || o_orderkey""",
    ),
)
def invalidate_downstream(spark, sf_dir):
    african = table(spark, sf_dir, "region").where("r_name = 'AFRICA'").select(F.col("r_regionkey").alias("n_regionkey"))
    start = table(spark, sf_dir, "nation").join(african, "n_regionkey", "left_semi").select(_tag("N", "n_nationkey").alias("name"))
    return freshness.invalidate_downstream(_order_times(spark, sf_dir), edges_of(spark, sf_dir, "nc", "co"), start)


_PHASE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'waiting' ELSE 'completed' END"


def run_log(spark, sf_dir):
    """Events as the tasks of one run per day."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(DATE(ts) AS STRING) AS run_id",
        "DATE_TRUNC('day', ts) AS run_started_at",
        "event_id AS task",
        f"{_PHASE} AS phase",
        f"CASE WHEN {_PHASE} IN ('completed', 'failed') THEN ts END AS completed_at",
    )


@query(
    "latest_run",
    f"""SELECT event_id AS task, {_PHASE} AS phase, CASE WHEN {_PHASE} IN ('completed', 'failed') THEN ts END AS completed_at
        FROM events WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events)""",
)
def latest_run(spark, sf_dir):
    return runs.latest_run(run_log(spark, sf_dir)).select("task", "phase", "completed_at")


@query(
    "completed_tasks",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id AS task, ts AS completed_at FROM events WHERE {_PHASE} = 'completed'",
)
def completed_tasks(spark, sf_dir):
    return runs.completed_tasks(run_log(spark, sf_dir)).select("run_id", "task", "completed_at")


@query(
    "run_phase_counts",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, COUNT(*) AS total,
               COUNT(*) FILTER ({_PHASE} = 'waiting') AS waiting, COUNT(*) FILTER ({_PHASE} = 'running') AS running,
               COUNT(*) FILTER ({_PHASE} = 'completed') AS completed, COUNT(*) FILTER ({_PHASE} = 'failed') AS failed,
               CAST(0 AS BIGINT) AS skipped
        FROM events GROUP BY 1""",
)
def run_phase_counts(spark, sf_dir):
    return runs.phase_counts(run_log(spark, sf_dir))


@query(
    "lineage_deep_levels",
    """
    WITH placed AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1 AS place FROM events)
    SELECT 'E' || event_id AS name, place::INTEGER AS level FROM placed
    UNION ALL SELECT 'U' || user_id, (max(place) + 1)::INTEGER FROM placed WHERE user_id IS NOT NULL GROUP BY user_id
    """,
)
def lineage_deep_levels(spark, sf_dir):
    """One chain through all events in order of time, each also leading to its user: as deep as there are events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    chain = prefix_windows(events, ["ts"], {"next": Near("lead", "event_id", 1)}, unique=["event_id"])
    edges = _stack(_link(chain, ("E", "event_id"), ("E", "next")), _link(chain.select("event_id", "user_id"), ("E", "event_id"), ("U", "user_id")))
    return graph.levels(events.select(_tag("E", "event_id").alias("name")), edges)


@query(
    "stored_versions_changed",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1500 THEN 'removed' WHEN o_orderdate >= DATE '2001-07-28' THEN 'added' ELSE 'changed' END AS change
       FROM orders WHERE (o_totalprice < 1500) <> (o_orderdate >= DATE '2001-07-28')
          OR (o_totalprice >= 1500 AND o_orderdate < DATE '2001-07-28' AND o_custkey = 7 AND o_orderstatus <> 'X')""",
)
def stored_versions_changed(spark, sf_dir):
    """Two versions of all orders with digests: cheap ones went, the last week came, one customer's status changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    status = F.expr("IF(o_custkey = 7, 'X', o_orderstatus)")
    last = orders.where("o_orderdate < DATE '2001-07-28'")
    current = orders.where("o_totalprice >= 1500").withColumn("o_orderstatus", status)
    keys, cells, paths = ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderdate"], [scratch_path(spark, v) for v in ("last", "current")]
    for version, path in ((last, paths[0]), (current, paths[1])):
        versions.store(version, path, keys, cells, 8, 8)
    schema = orders.select(*keys, *cells).schema
    changed = versions.content_changes(spark, *paths, schema, keys, cells).select("o_orderkey", F.lit("changed").alias("change"))
    return versions.snapshot_diff(spark, *paths, schema, keys).unionByName(changed)
