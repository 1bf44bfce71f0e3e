"""When tables were last brought up to date: ``nodes(name, updated_at)`` along the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.graph import downstream


def upsert_freshness(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per name: the latest update where there is one, the existing row otherwise.

    An update that sets null invalidates the name. Only times are aggregated, so rows are
    combined in hash maps before the shuffle.
    """
    rows = existing.select("name", "updated_at", F.lit(0).alias("is_update")).unionByName(
        updates.select("name", "updated_at", F.lit(1).alias("is_update"))
    )
    newest = lambda flag: F.max(F.when(F.col("is_update") == flag, F.col("updated_at")))
    return (
        rows.groupBy("name")
        .agg(F.max("is_update").alias("has_update"), newest(1).alias("new"), newest(0).alias("old"))
        .select("name", F.when(F.col("has_update") == 1, F.col("new")).otherwise(F.col("old")).alias("updated_at"))
    )


def oldest_input(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node with inputs, the earliest ``updated_at`` among them; unknown times are ignored.

    ``nodes`` should be a stored table: then both sides of the join are plain shuffles, and
    the adaptive skew join can split a source that very many nodes read.
    """
    times = nodes.select(F.col("name").alias("src"), "updated_at")
    return (
        edges.join(times, "src", "left")
        .groupBy(F.col("dst").alias("name"))
        .agg(F.min("updated_at").alias("oldest_input_at"))
    )


def invalidate_downstream(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Clear ``updated_at`` of the start nodes and of everything downstream of them."""
    stale = downstream(edges, start).withColumn("is_stale", F.lit(True))
    return nodes.join(stale, "name", "left").select(
        "name", F.when(F.col("is_stale").isNull(), F.col("updated_at")).alias("updated_at")
    )
