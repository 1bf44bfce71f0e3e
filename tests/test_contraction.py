"""Deep graphs: contraction against walks and peeling in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.errors import LineageError
from tidemill.operators import graph
from tidemill.operators.contraction import contract


def walk(edges, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        at = todo.pop()
        for new in {d for s, d in edges if s == at} - seen:
            seen.add(new)
            todo.append(new)
    return seen


def peeled(edges):
    """Levels of what loses all its incoming edges, and what is left."""
    names = {n for e in edges for n in e}
    level, left = {}, set(names)
    while free := {n for n in left if all(s not in left for s, d in edges if d == n)}:
        for n in free:
            level[n] = max((level[s] + 1 for s, d in edges if d == n), default=0)
        left -= free
    return level, left


def shapes():
    rng = random.Random(5)
    order = [f"n{i:02}" for i in range(36)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(33)]
    return {
        "chain": {*chain, *((f"c{i:02}", f"leaf{i}") for i in range(0, 33, 3)), ("c03", "c20"), *((f"feed{i}", f"c{i:02}") for i in range(2, 33, 5))},
        "ways": {("a", "b1"), ("b1", "b2"), ("b2", "z"), ("a", "z"), ("a", "d"), ("d", "z"), ("z", "y"), ("y", "x")},
        "tree": {(f"t{i // 2}", f"t{i}") for i in range(2, 40)},
        "mesh": {tuple(sorted(rng.sample(order, 2))) for _ in range(70)},
        "cycles": {tuple(rng.sample(order, 2)) for _ in range(40)} | {("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("loop", "loop"), ("loop", "after")},
    }


def apart(*kinds):
    return {(f"{kind}:{s}", f"{kind}:{d}") for kind in kinds for s, d in shapes()[kind]}


def test_reachable_against_brute_force(names, pairs, column, monkeypatch):
    monkeypatch.setattr(graph, "_PLAIN_ROUNDS", 1)
    edges, start = apart(*shapes()), ["chain:c02", "ways:a", "tree:t4", "mesh:n00", "cycles:n03", "cycles:r2", "nowhere"]
    assert column(graph.reachable(pairs(*edges), names(*start))) == sorted(walk(edges, start))


def test_levels_and_cycles_against_brute_force(names, pairs, column, monkeypatch):
    monkeypatch.setattr(graph, "_PLAIN_ROUNDS", 1)
    edges = apart("chain", "ways", "tree", "mesh")
    level, left = peeled(edges)
    assert not left
    found = graph.levels(names(*level, "alone"), pairs(*edges)).collect()
    assert sorted(map(tuple, found)) == sorted((level | {"alone": 0}).items())
    edges |= apart("cycles")
    left = peeled(edges)[1]
    assert column(graph.cycle_remainder(pairs(*edges))) == sorted(left)
    with pytest.raises(LineageError, match=f"^{len(left)} nodes"):
        graph.levels(names("alone"), pairs(*edges))


def test_rounds_of_a_long_chain_do_not_follow_its_length(spark):
    n = 5000
    name = lambda c: F.format_string("n%05d", c)
    edges = spark.range(n).select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"), F.lit(1).cast("bigint").alias("w"))
    nodes = spark.range(n + 1).select(name(F.col("id")).alias("name"), F.lit(0).cast("bigint").alias("base"))
    work = contract(nodes, edges)
    assert work.rounds <= 3
    wrong = work.values().where(F.col("level") != F.substring("name", 2, 5).cast("bigint"))
    assert work.values().count() == n + 1 and wrong.count() == 0


def test_nothing_to_contract(spark):
    nodes = spark.createDataFrame([("a", 4), ("b", None)], "name string, base bigint")
    edges = spark.createDataFrame([], "src string, dst string, w bigint")
    assert [tuple(r) for r in contract(nodes, edges).values().collect()] == [("a", 4)]
    assert [tuple(r) for r in contract(nodes, edges, first_wins=True).values().collect()] == [("a", 4)]
    none = contract(nodes.where("false"), edges)
    assert none.values().count() == none.behind_stuck().count() == 0
