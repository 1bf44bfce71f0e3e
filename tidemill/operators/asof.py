"""As-of join: each row with the latest earlier row of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemill.session import materialize


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
) -> DataFrame:
    """Left join to the right row with the same key and the latest ``right_time <= left_time``.

    Ids break ties in time: the larger right id wins. Null keys and times match nothing. Right
    columns must not share names with left ones, the key apart.

    No pairs are built. Both tables are stacked and range-partitioned by key, time and id, so
    a key holding much of the data spreads over many partitions ("segments"). A window looks
    back within a segment; the last right row of earlier segments is carried in for the one
    key per segment that continues from before, hence at most one carried row per segment.
    """
    order = ["asof_time", "asof_side", "asof_id"]
    payload = [c for c in right.columns if c not in on]
    right = right.dropna(subset=[*on, right_time])
    stacked = _side(right, on, right_time, right_id, 0, payload=payload).unionByName(
        _side(left, on, left_time, left_id, 1, rest=[c for c in left.columns if c not in on]), allowMissingColumns=True
    )
    ranged = stacked.repartitionByRange(*on, *order).withColumn("asof_segment", F.spark_partition_id())
    ranged = materialize(ranged, "asof")

    by_time = Window.partitionBy(*on, "asof_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    looked = ranged.withColumn("asof_match", F.last("asof_right", ignorenulls=True).over(by_time))

    last_right = F.max_by("asof_right", F.when(F.col("asof_side") == 0, F.struct(*order))).alias("segment_last")
    segments = ranged.groupBy(*on, "asof_segment").agg(last_right)
    before = Window.partitionBy(*on).orderBy("asof_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(
        *on, "asof_segment", F.last("segment_last", ignorenulls=True).over(before).alias("asof_carried")
    ).where("asof_carried is not null")

    joined = looked.where("asof_side = 1").join(F.broadcast(carried), [*on, "asof_segment"], "left")
    match = F.coalesce("asof_match", "asof_carried")
    return joined.select(
        *on,
        *[F.col(f"asof_left.{c}").alias(c) for c in left.columns if c not in on],
        *[match[c].alias(c) for c in payload],
    )


def _side(df, on, time, row_id, side, payload=(), rest=()):
    name, columns = ("asof_right", payload) if side == 0 else ("asof_left", rest)
    return df.select(
        *on,
        F.col(time).alias("asof_time"),
        F.lit(side).alias("asof_side"),
        F.col(row_id).alias("asof_id"),
        F.struct(*columns).alias(name),
    )
