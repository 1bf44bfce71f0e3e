import random

import pytest

from tidemill.errors import LineageError
from tidemill.operators import changes, graph
from tidemill.operators.changes import affected, content_changes, snapshot_diff
from tidemill.session import child_folders, scratch_root

#: Two ports feed a river that parts and meets again; a pond stands alone.
RIVER = [("spring", "weir"), ("brook", "weir"), ("weir", "mill"), ("weir", "lock"), ("mill", "sea"), ("lock", "sea"), ("sea", "isle")]


def walk(edges, *start):
    seen, todo = set(start), list(start)
    while todo:
        at = todo.pop()
        new = {d for s, d in edges if s == at} - seen
        seen |= new
        todo += new
    return sorted(seen)


@pytest.mark.parametrize("start", ["spring", "weir", "lock", "isle", "pond"])
def test_closures(names, pairs, column, start):
    edges, back = pairs(*RIVER), [(d, s) for s, d in RIVER]
    assert column(graph.downstream(edges, names(start))) == walk(RIVER, start)
    assert column(graph.upstream(edges, names(start))) == walk(back, start)
    assert column(graph.downstream(edges, names(start), stored=True)) == walk(RIVER, start)
    assert column(graph.downstream(edges, names(start), include_start=False)) == [n for n in walk(RIVER, start) if n != start]


def test_closure_over_a_cycle_ends(names, pairs, column):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("apart", "end")]
    assert column(graph.reachable(pairs(*ring), names("r3"))) == [f"r{i}" for i in range(5)]


@pytest.mark.parametrize("limit", [0, graph.BROADCAST_BYTES])
def test_closure_against_brute_force(spark, names, pairs, column, monkeypatch, limit):
    monkeypatch.setattr(graph, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)}
    assert column(graph.reachable(pairs(*edges), names("n1", "n2"))) == walk(edges, "n1", "n2")


def test_levels_against_brute_force(names, pairs, monkeypatch):
    rng = random.Random(11)
    order = [f"n{i:02}" for i in range(40)]
    edges = {tuple(sorted(rng.sample(order, 2))) for _ in range(90)}
    level = {}
    for n in order:
        level[n] = max((level[s] + 1 for s, d in edges if d == n), default=0)
    found = graph.levels(names(*order, "alone"), pairs(*edges, *list(edges)[:5]))
    assert dict(map(tuple, found.collect())) == level | {"alone": 0}
    assert graph.cycle_remainder(pairs(*edges)).count() == 0


def test_long_chain(names, pairs, column, monkeypatch):
    monkeypatch.setattr(graph, "_ROUNDS_PER_TABLE", 4)
    chain = pairs(*[(f"n{i:02}", f"n{i + 1:02}") for i in range(17)])
    everything = [f"n{i:02}" for i in range(18)]
    assert column(graph.reachable(chain, names("n00"))) == everything
    assert column(graph.reachable(chain, names("n00"), include_start=False)) == everything[1:]
    found = dict(map(tuple, graph.levels(names(*everything), chain).collect()))
    assert found == {n: i for i, n in enumerate(everything)}


def test_levels_tell_a_cycle_in_the_round_that_frees_nothing(names, pairs):
    with pytest.raises(LineageError, match="4 nodes"):
        graph.levels(names("a"), pairs(("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")))


def test_cycle_remainder(pairs, column):
    rows = [("in", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "x4"), ("x4", "x1"), ("x2", "out"), ("out", "far"), ("loop", "loop"), ("in", "dry")]
    assert column(graph.cycle_remainder(pairs(*rows))) == ["far", "loop", "out", "x1", "x2", "x3", "x4"]
    assert column(graph.cycle_remainder(pairs(*rows), stored=True)) == ["far", "loop", "out", "x1", "x2", "x3", "x4"]
    assert column(graph.cycle_remainder(pairs(*RIVER))) == []


def test_a_peel_groups_no_edges_and_counts_repeated_ones(names, pairs, monkeypatch):
    """Edges are kept as they are; repeated ones change nothing, neither in rounds nor in the contraction."""
    kept, plain = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda edges, stored: kept.append(edges) or plain(edges, stored))
    monkeypatch.setattr(graph, "_PLAIN_ROUNDS", 1)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(5)]
    rows = [*chain * 3, *[("n1", "n4"), ("n3", "n5"), (None, "n3"), ("n4", None)] * 2]
    found = graph.levels(names(*[f"n{i}" for i in range(6)]), pairs(*rows))
    assert dict(map(tuple, found.collect())) == {f"n{i}": i for i in range(6)}
    assert "Aggregate" not in kept[0]._jdf.queryExecution().optimizedPlan().toString()


def test_adjacency_has_every_node_and_one_shape(names, pairs):
    many = [("hub", f"n{i}") for i in range(12_000)]
    rows = graph.adjacency(names("hub", "n1", "n1", "pond"), pairs(*many, ("n2", "n1"))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([*many, ("n2", "n1"), ("n1", None), ("pond", None)], key=str)


def test_dangling_and_induced(names, pairs):
    edges = pairs(*RIVER)
    known = names("spring", "weir", "mill", "lock", "sea")
    assert sorted(map(tuple, graph.dangling(known, edges).select("src", "dst").collect())) == [("brook", "weir")]
    nodes, inside = graph.induced_subgraph(names("weir", "mill", "sea", "isle"), edges, names("weir", "sea", "isle", "pond"))
    assert sorted(r.name for r in nodes.collect()) == ["isle", "sea", "weir"]
    assert sorted(map(tuple, inside.collect())) == [("sea", "isle")]


def test_snapshot_diff(pairs):
    last, current = pairs(("a", "b"), ("b", "c")), pairs(("a", "b"), ("a", "c"), ("a", "c"))
    rows = snapshot_diff(last, current, ["src", "dst"]).collect()
    assert sorted(map(tuple, rows)) == [("a", "c", "added"), ("b", "c", "removed")]


def test_snapshot_diff_deals_known_rows(pairs, monkeypatch):
    monkeypatch.setattr(changes, "ROWS_PER_TASK", 100)
    last = pairs(*[(f"a{i}", "x") for i in range(300)], *[("much", "repeated")] * 300, (None, "x"))
    current = pairs(*[(f"a{i}", "x") for i in range(1, 300)], *[("much", "repeated")] * 200, (None, "x"), (None, None), ("new", None))
    dealt = snapshot_diff(last, current, ["src", "dst"], last.count() + current.count())
    assert sorted(map(str, dealt.collect())) == sorted(map(str, snapshot_diff(last, current, ["src", "dst"]).collect()))
    assert dealt.count() == 3 and dealt.rdd.getNumPartitions() == 12
    none = last.where("false")
    assert snapshot_diff(none, none, ["src", "dst"], 0).collect() == []


def test_affected_tells_how_many_rows_it_compares(spark, names, pairs, column, monkeypatch):
    told, plain = [], changes.snapshot_diff
    monkeypatch.setattr(changes, "snapshot_diff", lambda last, current, keys, rows=None: told.append((keys, rows)) or plain(last, current, keys, rows))
    edges = pairs(*RIVER)
    with_null = edges.union(pairs((None, "isle"), *[("spring", "isle")] * 3))
    nodes = names("spring", "isle", "isle", "weir")
    assert column(affected(nodes, nodes, edges, with_null, names("pond"))) == ["isle"]
    assert sorted(told) == [(["name"], 8), (["src", "dst"], 2 * len(RIVER) + 4)]
    assert not [f for f in child_folders(spark, scratch_root(spark)) if f.startswith(("last-", "current-"))]


def test_content_changes_ignore_insignificant_columns(spark):
    fields = "name string, sql string, description string"
    last = spark.createDataFrame([("a", "x", "1"), ("b", "x", None), ("c", None, ""), ("gone", "x", "")], fields)
    current = spark.createDataFrame([("a", "x", "2"), ("b", "y", None), ("c", "x", ""), ("new", "x", "")], fields)
    assert sorted(r.name for r in content_changes(last, current, ["name"], ["sql"]).collect()) == ["b", "c"]


def test_affected_nodes(names, pairs, column):
    chain = pairs(("src", "m1"), ("m1", "m2"), ("other", "m3"))
    nodes = names("src", "other", "m1", "m2", "m3")
    none = names("x").where("false")
    assert column(affected(nodes, nodes, chain, chain, names("src"))) == ["m1", "m2", "src"]
    assert column(affected(none, nodes, pairs(("x", "x")).where("false"), chain, none)) == ["m1", "m2", "m3", "other", "src"]
    moved = pairs(("src", "m1"), ("m1", "m2"), ("src", "m3"))
    assert column(affected(nodes, nodes, chain, moved, none)) == ["m3"]
    smaller = names("src", "m1", "m2", "m3")
    without = pairs(("src", "m1"), ("m1", "m2"))
    assert column(affected(nodes, smaller, chain, without, none)) == ["m3"]
