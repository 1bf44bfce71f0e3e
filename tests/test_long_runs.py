"""Long runs: places of all nodes, and how many rows are written to find them."""

import pytest

from tidemill.errors import LineageError
from tidemill.operators import contraction, graph


def long_chain(spark, n):
    return spark.range(n).selectExpr("concat('c', id) AS src", "concat('c', id + 1) AS dst")


def test_levels_of_runs_and_rings_by_shares(spark, pairs, column, monkeypatch):
    monkeypatch.setattr(graph, "_PLAIN_ROUNDS", 1)
    monkeypatch.setattr(contraction, "_DOUBLED_ROWS", 4, raising=False)
    monkeypatch.setattr(contraction, "_SHARE", 3, raising=False)
    side = pairs(("c20", "leaf"), ("feed", "c30"), ("c5", "c60"), ("c60", "x"))
    edges = long_chain(spark, 90).union(side)
    got = {r.name: r.level for r in graph.levels(edges.selectExpr("src AS name").distinct(), edges).collect()}
    assert got == {**{f"c{i}": i for i in range(91)}, "leaf": 21, "feed": 0, "x": 61}
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    more = edges.union(pairs(*ring, ("r7", "out"), ("out", "far")))
    assert column(graph.cycle_remainder(more)) == sorted([f"r{i}" for i in range(40)] + ["out", "far"])
    with pytest.raises(LineageError):
        graph.levels(more.selectExpr("src AS name").distinct(), more)
    assert column(graph.reachable(more, pairs(("r3", "")).selectExpr("src AS name"))) == sorted([f"r{i}" for i in range(40)] + ["out", "far"])


def test_places_of_a_long_run_are_not_written_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(contraction, "_DOUBLED_ROWS", 20, raising=False)
    written, stored = [], contraction._stored

    def counted(df, label, *totals):
        part = stored(df, label, *totals)
        written.append((label, part.rows))
        return part

    monkeypatch.setattr(contraction, "_stored", counted)
    n = 4000
    arcs = long_chain(spark, n).selectExpr(
        "src", "dst", "1L AS w", "IF(src = 'c0', 0L, NULL) AS src_base", "IF(src = 'c0', 'source', 'through') AS src_kind",
        "CAST(NULL AS BIGINT) AS dst_base", f"IF(dst = 'c{n}', 'sink', 'through') AS dst_kind",
    )
    found = contraction._places(arcs).table.collect()
    assert {(r.name, r.head, r.off) for r in found} == {(f"c{i}", "c0", i) for i in range(1, n)}
    assert sum(rows for _, rows in written) < 10 * n  # 13 steps of doubling would write each node 14 times
