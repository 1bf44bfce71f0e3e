"""Totals over the pairs of two inequalities against all pairs."""

import math
import random

import pytest

from tidemill.errors import SpecError
from tidemill.operators.inequality import inequality_join, overlap_join
from tidemill.operators.pair_totals import _borders
from workloads import QUERIES

SIGNS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
TOTALS = {"n": ("count", None), "ks": ("sum", "k"), "low": ("min", "k"), "high": ("max", "k"), "kn": ("count", "k"), "v_low": ("min", "v"), "v_high": ("max", "v")}


def totals(rows):
    ks, vs = [r[3] for r in rows if r[3] is not None], [r[4] for r in rows if r[4] is not None]
    last = lambda v: math.inf if v != v else v
    some = lambda f, xs, **by: f(xs, **by) if xs else None
    return (len(rows), some(sum, ks), some(min, ks), some(max, ks), len(ks), some(min, vs, key=last), some(max, vs, key=last))


@pytest.mark.parametrize("first, second", [("<", ">="), ("<=", ">"), (">", "<"), (">=", "<="), ("<", "<="), (">=", ">=")])
def test_totals_equal_those_of_all_pairs(spark, first, second):
    rng, nan = random.Random(5), float("nan")
    x = lambda: rng.choice([None, *range(30), 5, 5, 5, 5])
    y = lambda: rng.choice([None, nan, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 20), 3.0])
    make = lambda n: [(i // 2, x(), y(), rng.choice([None, 1, 2, -7]), rng.choice([None, 1.5, nan, -2.0])) for i in range(n)]
    a, b = make(300), make(250)
    left, right = (spark.createDataFrame(rows, "id bigint, x int, y double, k bigint, v double") for rows in (a, b))
    got = inequality_join(left, right, ("x", first, "x"), ("y", second, "y"), block_rows=20, totals=TOTALS).collect()
    there = lambda r: None not in r[1:3] and r[2] == r[2]
    want = [(p, [q for q in b if there(p) and there(q) and SIGNS[first](p[1], q[1]) and SIGNS[second](p[2], q[2])]) for p in a]
    assert sorted(str(tuple(r)) for r in got) == sorted(str((*p, *totals(found))) for p, found in want if found)
    assert inequality_join(left, right.limit(0), ("x", first, "x"), ("y", second, "y"), totals=TOTALS).count() == 0


def test_totals_of_overlaps(spark):
    rng = random.Random(6)
    make = lambda n: [(i, rng.choice([None, *range(90)]), rng.choice([None, *range(100)])) for i in range(n)]
    a, b = make(200), make(400)
    left, right = (spark.createDataFrame(rows, "id bigint, low int, high int") for rows in (a, b))
    got = overlap_join(left, right, ("low", "high"), ("low", "high"), {"n": ("count", None), "lows": ("sum", "low")}).collect()
    real = lambda rows: [r for r in rows if None not in r and r[1] <= r[2]]
    want = [(p, [q[1] for q in real(b) if p[1] <= q[2] and q[1] <= p[2]]) for p in real(a)]
    assert sorted(tuple(r) for r in got) == sorted((*p, len(lows), sum(lows)) for p, lows in want if lows)


def test_texts_and_wrong_totals(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3)], "w string, n int")
    got = inequality_join(words, words, ("w", "<", "w"), ("n", "<", "n"), totals={"pairs": ("count", None)}, block_rows=1)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 3), ("b", 2, 2)]
    days = words.selectExpr("date_add(DATE '2024-01-01', n) AS d", "timestamp '2024-01-01 00:00:00' + n * interval 1 hour AS t")
    got = inequality_join(days, days, ("d", "<=", "d"), ("t", ">=", "t"), totals={"pairs": ("count", None)}, block_rows=1)
    assert sorted(r.pairs for r in got.collect()) == [1, 1, 2, 2]
    for wrong in (("mean", "n"), ("sum", "w")):
        with pytest.raises(SpecError):
            inequality_join(words, words, ("w", "<", "w"), ("n", "<", "n"), totals={"t": wrong})


def test_pairs_are_counted_that_could_not_be_made(spark):
    """40,000 x 40,000 rows of one value: 1.6e9 pairs."""
    same = spark.range(40_000).selectExpr("id", "1 AS x", "2 AS y")
    got = overlap_join(same, same, ("x", "y"), ("x", "y"), {"n": ("count", None)}).groupBy("n").count().collect()
    assert [tuple(r) for r in got] == [(40_000, 40_000)]


def test_gaps_between_borders_hold_few_rows(spark):
    values = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 77 ELSE id END AS v")
    borders = _borders(values.repartition(3), 500).tolist()
    rows = sorted(r.v for r in values.collect())
    assert 77 in borders and len(borders) <= 40
    edges = [-1, *borders, 10**9]
    assert all(sum(low < v < high for v in rows) < 500 for low, high in zip(edges, edges[1:]))


def test_the_queries_make_no_pairs(spark, tmp_path):
    parts = spark.range(2000).selectExpr("concat('b', id % 2) AS p_brand", "IF(id < 1000, 50, 1) AS p_size", "CAST(id AS DOUBLE) AS p_retailprice")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["inequality_join"](spark, str(tmp_path))
    assert "left_data" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("b0", 500_000, 2.0), ("b1", 500_000, 1.0)]
