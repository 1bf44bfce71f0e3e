"""Graph operators over an edge table ``(src, dst)`` and a node table ``(name)``.

Each loop below reads the edges once per round and stops when a round finds nothing new.
Rounds are written to the shared folder, so plans stay short and lost executors cost one
round at most. A round's frontier is broadcast only after its size was measured; otherwise
it joins by shuffle, where adaptive execution splits a source that holds many edges.

Graphs deeper than ``_PLAIN_ROUNDS`` are contracted from there on (``contraction``), so a long
chain takes rounds by the logarithm of its length.

``stored`` says that the edges are a table already; otherwise they are computed once and kept
for the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.errors import LineageError
from tidemill.operators.contraction import contract
from tidemill.session import discard, materialize, scratch_path

BROADCAST_BYTES = 32 * 1024 * 1024
_ROW_OVERHEAD = 64
_ROUNDS_PER_TABLE = 20
_PLAIN_ROUNDS = 8


@dataclass
class _Part:
    """A table of a round, where it lies, and how many rows and bytes of names it has."""

    table: DataFrame
    path: str
    rows: int = 0
    size: int = 0

    def sized(self) -> DataFrame:
        """Marked for broadcast if the measured size allows."""
        return F.broadcast(self.table) if self.size <= BROADCAST_BYTES else self.table

    def drop(self) -> None:
        discard(self.table.sparkSession, self.path)


def reachable(edges: DataFrame, start: DataFrame, include_start: bool = True, stored: bool = False) -> DataFrame:
    """Every node that can be reached from ``start(name)`` along the edges, cycles allowed."""
    links, drop_links = _kept(edges, stored)
    frontier = _written(start.select("name").distinct(), "start")
    first, seen, rounds = frontier, [frontier], 0
    while frontier.rows:
        if rounds == _PLAIN_ROUNDS:
            seen.append(_beyond(links, _union(seen), frontier.table))
            break
        rounds += 1
        step = _successors(links, frontier.sized())
        frontier = _written(step.join(_union(seen), "name", "left_anti"), "frontier")
        seen = _compact([*seen, frontier], spare=(first, frontier))
    drop_links()
    whole = _union(seen)
    return whole if include_start else whole.join(first.table, "name", "left_anti")


def _beyond(links, seen, frontier):
    """All that the frontier reaches outside of ``seen``, by contraction."""
    arcs = links.distinct().join(seen.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst", F.lit(0).cast("bigint").alias("w"))
    none, start = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    ends = arcs.select(F.col("src").alias("name"), none.alias("base")).union(arcs.select("dst", none)).union(frontier.select("name", start))
    nodes = ends.groupBy("name").agg(F.max("base").alias("base"))
    return _written(contract(nodes, arcs, first_wins=True).values().select("name").join(frontier, "name", "left_anti"), "beyond")


def downstream(edges: DataFrame, start: DataFrame, include_start: bool = True, stored: bool = False) -> DataFrame:
    return reachable(edges, start, include_start, stored)


def upstream(edges: DataFrame, start: DataFrame, include_start: bool = True, stored: bool = False) -> DataFrame:
    return reachable(reverse(edges), start, include_start, stored)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def levels(nodes: DataFrame, edges: DataFrame, stored: bool = False) -> DataFrame:
    """Longest path from any root to each node, as ``(name, level)``; roots have level 0.

    A node gets its level in the round in which the last of its incoming edges is used, so each
    edge is used once. A cycle is told by the round that frees nothing while nodes are left.
    """
    freed, remaining, deep = _peel(edges, nodes, stored)
    left = deep.behind_stuck().count() if deep and deep.stuck else remaining.rows if not deep else 0
    if left:
        for part in freed:
            part.drop()
        raise LineageError(f"{left} nodes lie on cycles or behind them; cycle_remainder tells which")
    return _union(freed) if not deep else _union(freed).unionByName(deep.values().select("name", F.col("level").cast("int")))


def cycle_remainder(edges: DataFrame, stored: bool = False) -> DataFrame:
    """Nodes left after repeatedly removing those without incoming edges.

    These are the members of cycles and everything downstream of them; empty without cycles.
    """
    freed, remaining, deep = _peel(edges, None, stored)
    for part in freed:
        part.drop()
    return deep.behind_stuck() if deep else remaining.table.select("name")


def _peel(edges, nodes, stored):
    """Nodes in the order in which they lose their last incoming edge, with levels; what is left; its contraction.

    A round's nodes are written with the number of incoming edges not used yet. Those with none
    are the next frontier, in a partition of their own; only the others are read on. Repeated
    edges are waited for and used as often as they are there, so no task holds all edges of its
    part to find them.
    """
    links, drop_links = _kept(edges, stored)
    known = links.select(F.col("src").alias("name"), F.lit(0).alias("n")).union(links.select(F.col("dst").alias("name"), F.lit(1).alias("n")))
    if nodes is not None:
        known = known.union(nodes.select("name", F.lit(0).alias("n")))
    waiting = known.groupBy("name").agg(F.sum("n").alias("waiting"))
    spark, level, freed, before = edges.sparkSession, 0, [], None
    while True:
        path, seen = scratch_path(spark, "peel"), Observation()
        free = F.col("waiting") == 0
        observed = waiting.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(free).alias("free"),
            F.sum(F.when(free, F.octet_length("name") + _ROW_OVERHEAD)).alias("size"),
        )
        observed.withColumn("free", free).write.partitionBy("free").parquet(path)
        told = _metrics(seen)
        rows, n = told.get("rows") or 0, told.get("free") or 0
        table = spark.read.schema("name string, waiting bigint, free boolean").parquet(path)
        rest = _Part(table.where("not free").select("name", "waiting"), f"{path}/free=false", rows - n)
        if before:
            before.drop()
        if not n:
            drop_links()
            return freed or [_levelled(rest, level)], rest, None
        part = _Part(table.where("free").select("name"), f"{path}/free=true", n, told.get("size") or 0)
        used = _successors(links, part.sized(), distinct=False).groupBy("name").agg(F.count(F.lit(1)).alias("used"))
        leveled = _levelled(part, level)
        freed = _compact([*freed, leveled], spare=(leveled,))
        if level >= _PLAIN_ROUNDS and rest.rows:
            deep = _contracted(links, rest.table.select("name"), _union(freed))
            drop_links()
            return freed, rest, deep
        left = F.col("waiting") - F.coalesce("used", F.lit(0))
        waiting, before, level = rest.table.join(used, "name", "left").select("name", left.alias("waiting")), rest, level + 1


def _contracted(links, rest, freed):
    """The nodes not freed yet, taken apart with the levels that the freed ones give them."""
    given = links.join(freed.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg((F.max("level") + 1).alias("base"))
    nodes = rest.join(given, "name", "left").select("name", F.coalesce("base", F.lit(0)).cast("bigint").alias("base"))
    inside = links.join(rest.withColumnRenamed("name", "src"), "src", "left_semi")
    return contract(nodes, inside.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("bigint")))


def _levelled(part, level):
    return _Part(part.table.select("name", F.lit(level).alias("level")), part.path, part.rows)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct successors of every node as ``(name, successor)``, one in each row.

    A node without successors has one row with a null, so every node is there and no list
    grows with the number of a node's successors.
    """
    links, _ = _kept_as(_links(edges), "links")
    ends = nodes.select("name").distinct().join(links.select(F.col("src").alias("name")).distinct(), "name", "left_anti")
    return links.select(F.col("src").alias("name"), F.col("dst").alias("successor")).unionByName(
        ends.select("name", F.lit(None).cast("string").alias("successor"))
    )


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source is no known node; ``nodes`` should be a stored table."""
    return _links(edges).join(nodes.select(F.col("name").alias("src")), "src", "left_anti")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges restricted to the names in ``keep``."""
    _, names = _measure(materialize(keep.select("name").distinct(), "keep"))
    inside = (
        edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi")
        .join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )
    return nodes.join(names, "name", "left_semi"), inside


def _links(edges):
    return edges.select("src", "dst").where("src is not null and dst is not null")


def _kept(edges, stored):
    """The edges for many rounds, and how to drop them afterwards."""
    return (_links(edges), lambda: None) if stored else _kept_as(_links(edges), "links")


def _kept_as(df, label):
    path = scratch_path(df.sparkSession, label)
    return materialize(df, path=path), lambda: discard(df.sparkSession, path)


def _successors(links, frontier, distinct=True):
    found = links.join(frontier.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name"))
    return found.distinct() if distinct else found


def _written(df, label):
    """``df`` as a table, measured by the job that writes it."""
    path, seen = scratch_path(df.sparkSession, label), Observation()
    size = F.sum(F.octet_length("name") + _ROW_OVERHEAD).alias("size")
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), size), path=path)
    told = _metrics(seen)
    return _Part(table, path, told.get("rows") or 0, told.get("size") or 0)


def _metrics(seen):
    """What was observed; nothing where the optimizer found that there are no rows."""
    return dict(seen.get or {})


def _measure(table, name="name"):
    """Row count, and the table marked for broadcast if its measured size allows."""
    size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name) + _ROW_OVERHEAD), F.lit(0))).first()
    return size[0], F.broadcast(table) if size[1] <= BROADCAST_BYTES else table


def _compact(parts, spare=()):
    """Many small rounds become one table, so that the plan of a long walk stays short."""
    if len(parts) < _ROUNDS_PER_TABLE:
        return parts
    spark = parts[0].table.sparkSession
    path = scratch_path(spark, "rounds")
    whole = _Part(materialize(_union(parts), path=path), path, sum(p.rows for p in parts))
    for part in parts:
        if all(part is not s for s in spare):
            part.drop()
    return [whole]


def _union(parts):
    whole = parts[0].table
    for part in parts[1:]:
        whole = whole.unionByName(part.table)
    return whole
