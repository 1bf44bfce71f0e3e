"""A key holding most rows must be split, not land in one task."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import graph
from tidemill.operators.freshness import oldest_input
from tidemill.operators.ranges import range_join

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


@pytest.fixture
def small_thresholds(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    for key, value in CONF.items():
        spark.conf.set(key, value)
    yield
    for key in CONF:
        spark.conf.unset(key)


@pytest.fixture
def hot_edges(spark):
    """60,000 edges in 12 input tasks, two thirds of them from one node."""
    ids = spark.range(0, 60_000, 1, 12)
    src = F.when(F.col("id") % 3 > 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 500))
    return ids.select(src.alias("src"), F.concat(F.lit("d"), F.col("id")).alias("dst"))


def split_joins(df):
    rows = len(df.collect())
    return rows, df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def hub_nodes(spark):
    return spark.range(500).select(F.concat(F.lit("n"), "id").alias("name")).union(spark.sql("SELECT 'hub'"))


def test_successors(spark, small_thresholds, hot_edges):
    frontier = graph.materialize(hub_nodes(spark))
    assert split_joins(graph._successors(hot_edges, graph._measure(frontier)[1])) == (60_000, 1)


def test_dangling(spark, small_thresholds, hot_edges):
    known = graph.materialize(hub_nodes(spark).where("name <> 'hub'"))
    assert split_joins(graph.dangling(known, hot_edges)) == (40_000, 1)


def test_oldest_input(spark, small_thresholds, hot_edges):
    times = hub_nodes(spark).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert split_joins(oldest_input(hot_edges, graph.materialize(times))) == (60_000, 1)


def test_adjacency(spark, small_thresholds, hot_edges):
    rows = graph.adjacency(hub_nodes(spark), hot_edges)
    assert rows.count() == 60_000 + rows.where("successor is null").count()


def test_range_join(spark, small_thresholds):
    points = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 1000).alias("x"))
    intervals = spark.range(100).select(F.col("id").alias("interval"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + 9).alias("high"))
    rows, splits = split_joins(range_join(points, intervals, "x", "low", "high"))
    assert rows == 60_000 and splits >= 1
