"""Overlaps and inequalities against all pairs, and the plans that find them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.errors import SpecError
from tidemill.operators.inequality import inequality_join, overlap_join


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def intervals(rng, n, point):
    rows = []
    for i in range(n):
        low = point(rng)
        rows.append((i, rng.choice([low, low, low, None]), low + rng.choice([0, 0, 1, 3, 40, 1000, -2]) * rng.choice([1, 1, 0.5] if isinstance(low, float) else [1])))
    return rows


@pytest.mark.parametrize("kind, point", [("bigint", lambda r: r.randint(-300, 300)), ("double", lambda r: r.choice([r.uniform(-50, 50), float(r.randint(-9, 9))])),
                                         ("bigint", lambda r: 2**60 + r.randint(0, 400))])
def test_overlaps_equal_all_pairs(spark, kind, point):
    rng = random.Random(4)
    a, b = intervals(rng, 300, point), intervals(rng, 250, point)
    left, right = (spark.createDataFrame(rows, f"id bigint, low {kind}, high {kind}") for rows in (a, b))
    got = overlap_join(left, right, ("low", "high"), ("low", "high"))
    want = [(x, y) for x in a for y in b if None not in (x[1], y[1]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(x + y for x, y in want) and len(want) > 500
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert overlap_join(left.limit(0), right, ("low", "high"), ("low", "high")).count() == 0


SIGNS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize("first", SIGNS)
@pytest.mark.parametrize("second", SIGNS)
def test_inequalities_equal_all_pairs(spark, first, second):
    rng = random.Random(5)
    make = lambda n: [(i, rng.choice([None, *range(30)]), rng.choice([None, float("nan"), *map(float, range(20))])) for i in range(n)]
    a, b = make(120), make(90)
    left, right = (spark.createDataFrame(rows, "id bigint, x int, y double") for rows in (a, b))
    got = inequality_join(left, right, ("x", first, "x"), ("y", second, "y"), block_rows=16)
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (*p, *q) and SIGNS[first](p[1], q[1]) and SIGNS[second](p[2], q[2]))
    assert sorted((r[0], r[3]) for r in got.collect()) == want and len(want) > 500


def test_blocks_that_cannot_match_are_not_compared(spark):
    days = spark.range(4000).select("id", F.to_date(F.lit("2024-01-01")).alias("from_day"), F.col("id").alias("low"), (F.col("id") + 2).alias("high"))
    got = inequality_join(days, days, ("low", "<=", "high"), ("high", ">=", "low"), block_rows=100)
    assert got.count() == 4000 * 5 - 6
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    pairs = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in pairs or "LogicalRDD" in pairs
    assert inequality_join(days.limit(0), days, ("low", "<", "high"), ("high", ">", "low")).count() == 0


def test_texts_can_be_compared_and_signs_are_checked(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "w string, n int")
    got = inequality_join(words, words, ("w", "<", "w"), ("n", "<", "n"))
    assert sorted((r[0], r[2]) for r in got.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    with pytest.raises(SpecError):
        inequality_join(words, words, ("w", "=", "w"), ("n", "<", "n"))
