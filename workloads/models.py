"""SQL models materialised in dependency order."""

from __future__ import annotations

import uuid

from tidemill import Adapter, FileSource, LocalFiles, Model, Project, Query
from tidemill.plans.project import Runner
from tidemill.session import scratch_path
from workloads.loading import MICROSECONDS
from workloads.registry import query, table

# Events are counted per customer and day before anything else, so a busy customer is a row a day.
DAYS = """
SELECT user_id, DATE(ts) AS day, COUNT(*) AS taps FROM {db}.taps WHERE event_type <> 'error' GROUP BY user_id, DATE(ts)
"""
STREAKS = """
SELECT user_id, COUNT(*) AS days, COUNT_IF(earlier IS NULL OR DATEDIFF(day, earlier) > 1) AS streaks, MAX(taps) AS busiest
FROM (SELECT *, LAG(day) OVER (PARTITION BY user_id ORDER BY day) AS earlier FROM {db}.days) GROUP BY user_id
"""
RETENTION = """
SELECT c_custkey, c_name, c_mktsegment, days, streaks, busiest, days IS NOT NULL AND days >= 3 * streaks AS loyal
FROM {db}.clients LEFT JOIN {db}.streaks ON c_custkey = user_id
"""
DELIVERY = """
SELECT l_suppkey, COUNT(*) AS shipped, COUNT_IF(l_shipdate > o_orderdate + INTERVAL 60 DAYS) AS slow
FROM {db}.lines JOIN {db}.placed ON l_orderkey = o_orderkey GROUP BY l_suppkey
"""
RATING = """
SELECT s_suppkey, s_nationkey, COALESCE(shipped, 0) AS shipped,
       CASE WHEN slow * 2 > shipped THEN 'slow' WHEN shipped > 0 THEN 'steady' END AS rating
FROM {db}.suppliers LEFT JOIN {db}.delivery ON s_suppkey = l_suppkey
"""
NATIONS = "SELECT s_nationkey, rating, COUNT(*) AS suppliers, SUM(shipped) AS shipped FROM {db}.rating GROUP BY s_nationkey, rating"
STEADY = """
SELECT c_name, c_mktsegment, days, streaks, busiest FROM {db}.retention
WHERE loyal ORDER BY days DESC, streaks, c_name LIMIT 10
"""

# The oracles leave the models' steps out and put them in other words.
_RETENTION_SQL = """
WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error'),
starts AS (SELECT user_id, COUNT(*) AS days, COUNT(*) FILTER (WHERE NOT EXISTS (
               SELECT 1 FROM seen e WHERE e.user_id = seen.user_id AND e.day = seen.day - 1)) AS streaks FROM seen GROUP BY user_id),
peaks AS (SELECT user_id, MAX(n) AS busiest FROM (
              SELECT user_id, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id, CAST(ts AS DATE)) GROUP BY user_id)
SELECT c_custkey, c_name, c_mktsegment, days, streaks, busiest, COALESCE(days >= 3 * streaks, false) AS loyal
FROM customer LEFT JOIN starts ON c_custkey = starts.user_id LEFT JOIN peaks ON c_custkey = peaks.user_id
"""
_STEADY_SQL = f"""
SELECT c_name, c_mktsegment, days, streaks, busiest FROM ({_RETENTION_SQL}) WHERE loyal ORDER BY days DESC, streaks, c_name LIMIT 10
"""
_RATING_SQL = """
SELECT s_suppkey, s_nationkey, COUNT(l_orderkey) AS shipped,
       CASE WHEN COUNT(l_orderkey) = 0 THEN NULL
            WHEN COUNT(*) FILTER (l_shipdate - INTERVAL 60 DAY > o_orderdate) * 2 > COUNT(*) THEN 'slow' ELSE 'steady' END AS rating
FROM supplier LEFT JOIN (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON s_suppkey = l_suppkey
GROUP BY s_suppkey, s_nationkey
"""


def project_over(sf_dir: str, db: str, clients=None, taps=None) -> Project:
    """Adapters over the provided tables and the models above, all in database ``db``."""
    parquet = lambda name: FileSource(f"{name}.parquet", "parquet")
    sources = {
        "clients": clients or parquet("customer"), "taps": taps or parquet("events"),
        "suppliers": parquet("supplier"), "lines": parquet("lineitem"), "placed": parquet("orders"),
    }
    models = {
        "days": DAYS, "streaks": STREAKS, "retention": RETENTION,
        "delivery": DELIVERY, "rating": RATING, "nations": NATIONS,
    }
    project = Project().connect("data", LocalFiles(sf_dir))
    project.add(*[Adapter(f"{db}.{name}", "data", source) for name, source in sources.items()])
    project.add(*[Model(f"{db}.{name}", sql.format(db=db)) for name, sql in models.items()])
    return project.add(Query("steady", STEADY.format(db=db)))


def runner_for(spark, sf_dir, **sources) -> tuple[Runner, str]:
    db = f"run_{uuid.uuid4().hex[:12]}"
    project = project_over(sf_dir, db, **sources)
    return Runner(spark, project, scratch_path(spark, db), state=f"{db}_state"), db


@query("run_end_to_end", _STEADY_SQL)
def clients_and_taps_end_to_end(spark, sf_dir):
    """CSV customers and JSON events to tables, three models over them, then a saved query."""
    base = scratch_path(spark, "export")
    table(spark, sf_dir, "customer").write.option("header", True).csv(f"{base}/clients")
    table(spark, sf_dir, "events").write.options(**MICROSECONDS).json(f"{base}/taps")
    runner, db = runner_for(
        spark, sf_dir, clients=FileSource(f"{base}/clients", "csv"), taps=FileSource(f"{base}/taps/*.json", "json")
    )
    runner.run_target(f"{db}.retention")
    return runner.query("steady")


@query("model_user_activity", _RETENTION_SQL)
def retention(spark, sf_dir):
    runner, db = runner_for(spark, sf_dir)
    for name in ("clients", "taps"):
        runner.load_adapter(runner.project.adapters[f"{db}.{name}"])
    for name in ("days", "streaks"):
        runner.build_model(runner.project.models[f"{db}.{name}"])
    return runner.build_model(runner.project.models[f"{db}.retention"])


@query("model_chain", f"SELECT s_nationkey, rating, COUNT(*) AS suppliers, SUM(shipped)::BIGINT AS shipped FROM ({_RATING_SQL}) GROUP BY s_nationkey, rating")
def chain_of_models(spark, sf_dir):
    runner, db = runner_for(spark, sf_dir)
    runner.run_target(f"{db}.nations")
    return spark.table(f"{db}.nations")


@query("target_run", _RATING_SQL)
def one_target(spark, sf_dir):
    runner, db = runner_for(spark, sf_dir)
    runner.run_target(f"{db}.rating")
    return spark.table(f"{db}.rating")


@query("incremental_rebuild", _RATING_SQL.replace("lineitem JOIN orders ON l_orderkey = o_orderkey", "lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'"))
def rebuild_after_a_change(spark, sf_dir):
    """A changed model and what is downstream of it are rebuilt; everything else stays."""
    runner, db = runner_for(spark, sf_dir)
    runner.run_target(f"{db}.rating")
    project = runner.project
    for unrelated in ("days", "streaks", "retention", "nations"):
        del project.models[f"{db}.{unrelated}"]
    for unrelated in ("clients", "taps"):
        del project.adapters[f"{db}.{unrelated}"]
    project.add(Model(f"{db}.delivery", DELIVERY.format(db=db).replace("GROUP BY", "WHERE l_returnflag <> 'R' GROUP BY")))
    rebuilt = {record["task"] for record in runner.run_changed()}
    assert rebuilt == {f"{db}.delivery", f"{db}.rating"}, rebuilt
    return spark.table(f"{db}.rating")
