"""What differs between two versions of a table, and what follows from it.

Both versions are stacked and grouped by key once: partial aggregation halves the data
before the only shuffle, and a key that occurs often does not land in one task.

Keys that are nearly all distinct gain nothing from that, and the task that begins to group holds
all of its own. Where the number of rows is known they are dealt first, so that a task groups no
more than ``ROWS_PER_TASK`` of them on the average, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.graph import reachable
from tidemill.session import discard, materialize, scratch_path

ROWS_PER_TASK = 1 << 20


def snapshot_diff(last: DataFrame, current: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Keys only one version has, with ``change`` = ``added`` or ``removed``.

    ``rows``, if given, is how many both versions have together.
    """
    sides = _stack(last.select(keys), current.select(keys))
    grouped = _grouped(sides, keys) if rows is None else _dealt(sides, keys, max(1, -(-rows // ROWS_PER_TASK)))
    return grouped.where("in_last <> in_current").select(*keys, F.when(F.col("in_current") == 1, "added").otherwise("removed").alias("change"))


def _grouped(sides, keys):
    return sides.groupBy(keys).agg(F.max("in_last").alias("in_last"), F.max("in_current").alias("in_current"))


def _dealt(sides, keys, parts):
    """As ``_grouped``; a much repeated key goes to as many tasks as read it before it goes to one."""
    read = sides.withColumn("read_by", F.spark_partition_id())
    once = _grouped(read.repartition(parts, *keys, "read_by"), [*keys, "read_by"])
    return _grouped(once.repartition(parts, *keys), keys)


def content_changes(last: DataFrame, current: DataFrame, keys: list[str], significant: list[str]) -> DataFrame:
    """Keys both versions have whose significant columns differ; other columns may differ freely.

    Keys must be unique in each version. Rows are compared by a 128-bit fingerprint, held as
    two numbers so that grouping stays in hash maps.
    """
    prints = _fingerprint(significant)
    sides = _stack(last.select(*keys, *prints), current.select(*keys, *prints))
    side = lambda flag, column: F.max(F.when(F.col(flag) == 1, F.col(column))).alias(f"{flag}_{column}")
    grouped = sides.groupBy(keys).agg(*[side(f, c) for f in ("in_last", "in_current") for c in ("print_a", "print_b")])
    return grouped.where("in_last_print_a <> in_current_print_a OR in_last_print_b <> in_current_print_b").select(keys)


def affected(
    last_nodes: DataFrame, current_nodes: DataFrame, last_edges: DataFrame, current_edges: DataFrame, changed: DataFrame
) -> DataFrame:
    """Current nodes to rebuild: changed or new ones, targets of changed edges, and all downstream.

    With an empty last version that is every node.
    """
    spark, paths = current_edges.sparkSession, [scratch_path(current_edges.sparkSession, v) for v in ("last", "current")]
    last, current = (materialize(edges.select("src", "dst"), path=path) for edges, path in zip((last_edges, current_edges), paths))
    nodes = snapshot_diff(last_nodes, current_nodes, ["name"], last_nodes.count() + current_nodes.count()).select("name")
    targets = snapshot_diff(last, current, ["src", "dst"], last.count() + current.count()).select(F.col("dst").alias("name"))
    seeds = nodes.union(targets).union(changed.select("name"))
    found = reachable(current, seeds, stored=True)
    for path in paths:
        discard(spark, path)
    return found.join(current_nodes.select("name"), "name", "left_semi")


def _fingerprint(columns):
    """Two hashes with different seeds; nulls leave a hash as it is, so they are marked apart."""
    values = [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in ((1, "print_a"), (2, "print_b"))]


def _stack(last, current):
    flag = lambda df, in_last: df.withColumns({"in_last": F.lit(in_last), "in_current": F.lit(1 - in_last)})
    return flag(last, 1).unionByName(flag(current, 0))
