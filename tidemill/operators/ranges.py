"""Joins of points to the intervals that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Pairs with ``low <= point <= high`` (numbers), as an equi-join on range buckets.

    Intervals are classed by the power of two next above their width and cut the axis of their
    class into buckets of that width, so each lies in two buckets at most, however wide it is.
    A point goes to one bucket of each class there is, of which there are no more than numbers
    have exponents. Each pair is found once, no row is compared outside its bucket, and a
    crowded bucket is split by the adaptive skew join.
    """
    width = (F.col(high) - F.col(low)).cast("double")
    size = F.when(width > 0, F.ceil(F.log2(width))).otherwise(F.lit(-1074)).cast("int")
    intervals = materialize(intervals.where(F.col(low) <= F.col(high)).withColumn("range_class", size), "intervals")
    classes = sorted(r[0] for r in intervals.select("range_class").distinct().collect())
    step = F.pow(F.lit(2.0), F.col("range_class"))
    at = lambda column: F.when(F.col("range_class") > -1074, F.floor(F.col(column) / step).cast("double")).otherwise(F.col(column).cast("double"))
    left = points.withColumn("range_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).withColumn("range_bucket", at(point))
    right = intervals.withColumn("range_bucket", F.explode(F.array_distinct(F.array(at(low), at(high)))))
    joined = left.join(right, ["range_class", "range_bucket"])
    return joined.where(F.col(point).between(F.col(low), F.col(high))).drop("range_class", "range_bucket")
