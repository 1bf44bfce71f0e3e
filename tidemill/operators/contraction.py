"""Values along the paths of deep graphs, by contraction instead of a round for every step.

A round takes three kinds of nodes out of the graph at once: those without incoming edges, whose
value is final and is handed on; those without outgoing edges, which wait for the way back; and
runs of nodes with one edge in and one out, of which only an edge from the run's head to what
follows it stays. Where in a run a node lies is found by doubling: after ``n`` steps each knows
what lies ``2 ** n`` edges before it. In long runs that goes on up to the next chosen node only,
and between the chosen ones likewise. Paths, trees and graphs of parts in series and in parallel
so end after a number of rounds that grows with the logarithm of their size. What holds no such
parts, like a long mesh, still loses one layer at each end in a round.

A node's value is the largest of its ``base`` and of ``value(src) + w`` over its incoming edges,
null where there is neither.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.session import discard, materialize, scratch_path

_PARTS = 20
#: Rows of runs up to which doubling goes all the way, and of how many nodes one stands for the others beyond.
_DOUBLED_ROWS, _SHARE = 100_000, 8


@dataclass
class Stored:
    """A table in the shared folder and what was counted while it was written."""

    table: DataFrame
    path: str
    told: dict

    @property
    def rows(self) -> int:
        return self.told.get("rows") or 0

    def drop(self) -> None:
        discard(self.table.sparkSession, self.path)


@dataclass
class Contraction:
    """What each round took away. ``stuck`` are nodes that no round could take: the core of cycles."""

    known: list[Stored] = field(default_factory=list)
    layers: list[Stored] = field(default_factory=list)
    stuck: list[Stored] = field(default_factory=list)
    rounds: int = 0
    none: DataFrame | None = None

    def values(self) -> DataFrame:
        """``(name, level)`` of every node that has a value; for a graph with cycles only where ``first_wins``."""
        return self._unwound(self.known, F.greatest("base", F.col("level") + F.col("off")))

    def behind_stuck(self) -> DataFrame:
        """``name`` of the stuck nodes and all that can be reached from them."""
        return self._unwound(self.stuck, F.col("level")).select("name")

    def _unwound(self, known, value):
        if not known:
            return self.none
        parts = list(known)
        for layer in reversed(self.layers):
            heads = _union(parts).select(F.col("name").alias("head"), "level")
            found = layer.table.join(heads, "head", "left").select("name", value.alias("level")).where("level is not null")
            parts.append(_stored(found.groupBy("name").agg(F.max("level").alias("level")), "unwound"))
            if len(parts) >= _PARTS:
                parts = [_stored(_union(parts), "folded")]
        return _union(parts)


def contract(nodes: DataFrame, edges: DataFrame, first_wins: bool = False) -> Contraction:
    """Take ``nodes(name, base)`` and distinct ``edges(src, dst, w)`` apart; every end is a node.

    ``first_wins`` says that a node with a value needs no other, as where only reachability is
    asked; the work then ends as soon as no node with a value is left, also on cycles.
    """
    work = Contraction(none=nodes.select("name", F.lit(0).cast("bigint").alias("level")).where("false"))
    has_value = F.count_if(F.col("base").isNotNull()).alias("valued")
    left, links = _stored(nodes, "left", has_value), _stored(edges, "links")
    while left.told.get("valued") if first_wins else left.rows:
        work.rounds += 1
        arcs = links.table
        if first_wins:
            arcs = arcs.join(left.table.where("base is not null").select(F.col("name").alias("dst")), "dst", "left_anti")
        kinds = _stored(_with_kinds(left.table, arcs), "kinds", *[F.count_if(F.col("kind") == k).alias(k) for k in ("through", "joint")])
        if kinds.told.get("joint") == kinds.rows:
            work.stuck.append(_stored(kinds.table.select("name", F.lit(0).cast("bigint").alias("level")), "stuck"))
            kinds.drop()
            break
        arcs = _stored(_with_ends(arcs, kinds.table), "arcs")
        spent, runs = [left, links, arcs], None
        direct = arcs.table.where("src_kind <> 'through' and dst_kind <> 'through'").withColumn("push", F.lit(None).cast("bigint"))
        moves = direct.select("src", "dst", "w", "src_base", "src_kind", "dst_kind", "push")
        if kinds.told.get("through"):
            placed = _places(arcs.table)
            spent.append(placed)
            runs = placed.table.where("head_kind <> 'through'")
            if placed.told.get("open") and not first_wins:
                ring = placed.table.where("head_kind = 'through'").select("name", F.lit(0).cast("bigint").alias("level"))
                work.stuck.append(_stored(ring, "ring"))
            shorter = _stored(moves.unionByName(_shortened(arcs.table, runs)), "shorter")
            spent.append(shorter)
            moves = shorter.table
        push = F.greatest("push", F.when(F.col("src_kind") == "source", F.col("src_base") + F.col("w")))
        pushed = moves.select(F.col("dst").alias("name"), push.alias("push")).where("push is not null").groupBy("name").agg(F.max("push").alias("push"))
        fed = kinds.table.where("kind in ('joint', 'sink')").join(pushed, "name", "left")
        joint = F.col("kind") == "joint"
        valued = F.count_if(joint & F.col("base").isNotNull()).alias("valued")
        fed = _stored(fed.select("name", "kind", F.greatest("base", "push").alias("base")), "fed", valued, F.count_if(joint).alias("joint"))
        source = kinds.table.where("kind = 'source' and base is not null").select("name", F.col("base").alias("level"))
        work.known = _folded([*work.known, Stored(source, kinds.path, {})])
        work.layers.append(_stored(_layer(moves, fed.table, runs), "layer"))
        left = Stored(fed.table.where(joint).select("name", "base"), fed.path, {**fed.told, "rows": fed.told.get("joint")})
        links = _stored(moves.where("src_kind = 'joint' and dst_kind = 'joint'").groupBy("src", "dst").agg(F.max("w").alias("w")), "links")
        for part in spent:
            part.drop()
    left.drop()
    links.drop()
    return work


def _with_kinds(nodes, arcs):
    """Each node as ``source``, ``sink``, ``through`` (one edge in, one out) or ``joint``."""
    ends = arcs.select(F.col("src").alias("name"), F.lit(0).alias("into"), F.lit(1).alias("out"))
    ends = ends.union(arcs.select("dst", F.lit(1), F.lit(0))).groupBy("name").agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
    into, out = F.coalesce("into", F.lit(0)), F.coalesce("out", F.lit(0))
    kind = F.when(into == 0, "source").when(out == 0, "sink").when((into == 1) & (out == 1), "through").otherwise("joint")
    return nodes.join(ends, "name", "left").select("name", "base", kind.alias("kind"))


def _with_ends(arcs, kinds):
    side = lambda end: kinds.select(F.col("name").alias(end), F.col("base").alias(f"{end}_base"), F.col("kind").alias(f"{end}_kind"))
    return arcs.join(side("src"), "src").join(side("dst"), "dst")


def _places(arcs):
    """Each node of a run with the head of its run, how far it is away, and the best base on the way.

    A step that closes no further node leaves rings only: along a run that ends, there is always
    a next node to close. They keep a head of kind ``through``.
    """
    opened = F.count_if(F.col("head_kind") == "through").alias("open")
    first = arcs.where("dst_kind = 'through'").select(
        F.col("dst").alias("name"), F.col("src").alias("head"), F.col("src_base").alias("head_base"),
        F.col("src_kind").alias("head_kind"), F.col("w").alias("off"), F.col("dst_base").alias("base"),
    )
    return _placed(_stored(first, "places", opened), opened)


def _placed(first, opened, depth=0):
    """``first`` with all heads found: every eighth node stands for those up to the next one, which then ask it.

    Doubling so goes on over short ways only; over all the way it is done for an eighth of an eighth and so on.
    """
    if (first.told.get("open") or 0) <= _DOUBLED_ROWS:
        found, parts = _doubled(first.table, first.told.get("open") or 0, opened)
        whole = _stored(found, "places", opened)
        for part in (first, *parts):
            part.drop()
        return whole
    chosen = lambda column: F.pmod(F.xxhash64(column, F.lit(depth)), F.lit(_SHARE)) == 0
    kind = F.when((F.col("head_kind") == "through") & chosen("head"), "chosen").otherwise(F.col("head_kind"))
    near, parts = _doubled(first.table.withColumn("head_kind", kind), first.told["open"], opened)
    near = _stored(near, "near")
    for part in (first, *parts):
        part.drop()
    again = F.when(F.col("head_kind") == "chosen", "through").otherwise(F.col("head_kind"))
    far = _placed(_stored(near.table.where(chosen("name")).withColumn("head_kind", again), "places", opened), opened, depth + 1)
    asked = _step(near.table.where("head_kind = 'chosen'"), far.table)
    whole = _stored(near.table.where("head_kind <> 'chosen'").unionByName(asked), "places", opened)
    near.drop()
    far.drop()
    return whole


def _doubled(rows, n, opened):
    """``rows`` with heads of other kinds than ``through``, but on rings, and the tables they are read from.

    Rows whose head is found are written once.
    """
    done, left, parts = [rows.where("head_kind <> 'through'")], rows.where("head_kind = 'through'"), []
    while n:
        back = left
        for table in done:
            back = back.unionByName(table)
        step = _stored(_step(left, back), "places", opened)
        parts.append(step)
        done.append(step.table.where("head_kind <> 'through'"))
        left, before, n = step.table.where("head_kind = 'through'"), n, step.told.get("open") or 0
        if n == before:
            break
    for table in done:
        left = left.unionByName(table)
    return left, parts


def _step(rows, back):
    """``rows`` with the heads of their heads."""
    back = back.select(F.col("name").alias("head"), *[F.col(c).alias(f"{c}_2") for c in ("head", "head_base", "head_kind", "off", "base")])
    return rows.select("name", "head", "off", "base").join(back, "head").select(
        "name", F.col("head_2").alias("head"), F.col("head_base_2").alias("head_base"), F.col("head_kind_2").alias("head_kind"),
        (F.col("off") + F.col("off_2")).alias("off"), F.greatest("base", F.col("base_2") + F.col("off")).alias("base"),
    )


def _shortened(arcs, runs):
    """One edge for each run, from its head to what follows it."""
    last = arcs.where("src_kind = 'through' and dst_kind <> 'through'").select(F.col("src").alias("name"), "dst", "dst_kind", "w")
    return last.join(runs, "name").select(
        F.col("head").alias("src"), "dst", (F.col("off") + F.col("w")).alias("w"), F.col("head_base").alias("src_base"),
        F.col("head_kind").alias("src_kind"), "dst_kind", (F.col("base") + F.col("w")).alias("push"),
    )


def _layer(moves, fed, runs):
    """What nodes taken out of the middle or the end get their values from on the way back."""
    none = F.lit(None)
    layer = fed.where("kind = 'sink'").select("name", none.cast("string").alias("head"), none.cast("bigint").alias("off"), "base")
    ends = moves.where("dst_kind = 'sink' and src_kind = 'joint'")
    layer = layer.union(ends.select("dst", "src", "w", none.cast("bigint")))
    return layer if runs is None else layer.union(runs.select("name", "head", "off", "base"))


def _stored(df, label, *totals):
    path, seen = scratch_path(df.sparkSession, label), Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *totals), path=path)
    return Stored(table, path, dict(seen.get or {}))


def _folded(parts):
    """Many small tables become one, so that plans stay short."""
    if len(parts) < _PARTS:
        return parts
    whole = _stored(_union(parts), "folded")
    for part in parts:
        part.drop()
    return [whole]


def _union(parts):
    whole = parts[0].table
    for part in parts[1:]:
        whole = whole.unionByName(part.table)
    return whole
