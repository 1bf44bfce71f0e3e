import random

import pytest

from tidemill.operators import asof
from tidemill.operators.asof import asof_join
from tidemill.operators.ranges import range_join


@pytest.mark.parametrize("hot", [False, True])
def test_asof_join_against_brute_force(spark, monkeypatch, hot):
    segments = []
    keep = asof.materialize
    monkeypatch.setattr(asof, "materialize", lambda df, label: segments.append(keep(df, label)) or segments[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    key = lambda: 0 if hot and rng.random() < 0.6 else rng.randrange(5)
    left = [(key(), rng.randrange(200), i) for i in range(400)]
    right = [(key(), rng.randrange(200), i, rng.choice([None, "a", "b"])) for i in range(150)]
    if hot:
        left += [(0, 250 + i, 1000 + i) for i in range(300)]
    left += [(None, 50, 5000), (1, None, 5001)]
    right += [(None, 1, 500, "a"), (1, None, 501, "b")]
    want = []
    for k, t, i in left:
        found = max(((rt, ri, v) for rk, rt, ri, v in right if rk == k is not None and None not in (rt, t) and rt <= t), key=lambda r: r[:2], default=(None,) * 3)
        want.append((k, t, i, *found))
    got = asof_join(
        spark.createDataFrame(left, "k int, t int, id int"),
        spark.createDataFrame(right, "k int, rt int, rid int, v string").repartition(3),
        ["k"], "t", "rt", "id", "rid",
    )
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot_segments = segments[0].where("k = 0").select("asof_segment").distinct().count()
    assert hot_segments > 1 or not hot
    assert got.columns == ["k", "t", "id", "rt", "rid", "v"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])


@pytest.mark.parametrize("span", [0, 40])
def test_range_join_against_brute_force(spark, span):
    rng = random.Random(5)
    points = [(i, rng.uniform(-50, 50)) for i in range(300)]
    intervals = [(i, low, low + rng.uniform(0, span)) for i, low in enumerate(rng.uniform(-60, 60) for _ in range(40))]
    intervals += [(98, 5.0, 4.0), (99, -1000.0, 1000.0), (100, points[0][1], points[0][1])]
    got = range_join(
        spark.createDataFrame(points, "p int, x double"),
        spark.createDataFrame(intervals, "i int, low double, high double"),
        "x", "low", "high",
    ).select("p", "i").collect()
    assert sorted(map(tuple, got)) == sorted((p, i) for p, x in points for i, low, high in intervals if low <= x <= high)


def test_one_interval_over_everything_among_narrow_ones(spark):
    points = spark.range(0, 2000, 1, 4).selectExpr("id AS p", "CAST(id AS DOUBLE) * 50 AS x")
    narrow = spark.range(100_000).selectExpr("id AS i", "CAST(id AS DOUBLE) AS low", "id + 0.5D AS high")
    odd = spark.createDataFrame([(-1, -1e9, 1e9), (-2, 2e6, 1e6), (-3, 50.0, 50.0)], "i bigint, low double, high double")
    got = range_join(points, narrow.union(odd), "x", "low", "high")
    assert got.where("i >= 0").count() == got.where("i = -1").count() == 2000
    assert [r.p for r in got.where("i = -3").collect()] == [1] and got.where("i = -2").count() == 0
