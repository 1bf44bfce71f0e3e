"""Windows over all rows or one huge key against Spark's own, which use one task."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.errors import SpecError
from tidemill.operators.prefix import Near, Rank, Running, prefix_windows

COLUMNS = {
    "rn": Rank("row_number"), "rk": Rank("rank"), "dr": Rank("dense_rank"), "total": Running("sum", "v"), "exact": Running("sum", "d"),
    "seen": Running("count", "v"), "low": Running("min", "v"), "high": Running("max", "v"),
    "one_back": Near("lag", "v"), "far_back": Near("lag", "v", 7), "ahead": Near("lead", "s", 3),
    "moving": Near("sum", "v", 5), "most": Near("max", "s", 2), "held": Near("count", "v", 3),
}


def plainly(df, keys):
    rows = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_first(), F.col("id").asc_nulls_first())
    ties, so_far = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_first()), rows.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda n: rows.rowsBetween(-n, 0)
    return df.select(
        "*", F.row_number().over(rows).cast("bigint").alias("rn"), F.rank().over(ties).cast("bigint").alias("rk"), F.dense_rank().over(ties).cast("bigint").alias("dr"),
        F.sum("v").over(so_far).alias("total"), F.sum("d").over(so_far).alias("exact"), F.count("v").over(so_far).alias("seen"),
        F.min("v").over(so_far).alias("low"), F.max("v").over(so_far).alias("high"), F.lag("v").over(rows).alias("one_back"),
        F.lag("v", 7).over(rows).alias("far_back"), F.lead("s", 3).over(rows).alias("ahead"), F.sum("v").over(near(5)).alias("moving"),
        F.max("s").over(near(2)).alias("most"), F.count("v").over(near(3)).alias("held"),
    )


def made_rows(spark, n, times, keys):
    rng = random.Random(n)
    rows = [
        (i, rng.choice([None, *keys]), rng.choice([None, *range(times)]), rng.choice([None, rng.randint(-9, 9)]), Decimal(rng.randint(-99, 99)) / 10, str(i % 7))
        for i in range(n)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k string, t int, v int, d decimal(9,1), s string").repartition(5)


@pytest.mark.parametrize("n, times, keys", [(400, 6, ["a"]), (400, 1, ["a", "b"]), (300, 1000, ["a"] * 30 + ["b", "c"]), (6, 3, ["a"])])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_windows_equal_spark_in_one_task(spark, n, times, keys, by):
    df = made_rows(spark, n, times, keys)
    got = prefix_windows(df, ["t"], COLUMNS, by, ["id"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plainly(df, by).collect()))


def test_no_part_holds_all_rows_even_if_all_tie(spark):
    df = spark.range(4000).select("id", F.lit(1).alias("t"), F.lit("x").alias("part"), F.lit(2).alias("place"))
    got = prefix_windows(df, ["t"], {"n": Running("count", "t"), "rank": Rank("rank"), "dense": Rank("dense_rank")})
    assert got.columns == ["id", "t", "part", "place", "n", "rank", "dense"]
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001))
    assert [tuple(r) for r in got.select("rank", "dense").distinct().collect()] == [(1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_empty_tables_and_unknown_functions(spark):
    df = spark.createDataFrame([], "id int, k string, t int, v int, d decimal(9,1), s string")
    assert prefix_windows(df, ["t"], COLUMNS).count() == 0
    with pytest.raises(SpecError):
        prefix_windows(df, ["t"], {"x": Running("avg", "v")})
