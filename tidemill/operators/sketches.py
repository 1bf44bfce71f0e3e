"""Counts of distinct values and quantiles kept as state: one row of sketches per period and group.

Sketches of different periods merge, so a question over any span reads the state, whose size
follows periods and groups, and never the rows again. Aggregation is partial before its only
shuffle, so a group that holds most rows is a few sketches by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct counts within about 1 % (one standard error), quantiles within about 1 % of the ranks.
DISTINCT_BITS, QUANTILE_SIZE = 14, 400


def sketch(rows: DataFrame, period: Column, by: list[str], distinct: str, value: str) -> DataFrame:
    """``period``, ``by``, ``n`` rows, sketches ``distinct_sketch`` and ``value_sketch``.

    Null values are in ``n`` only; a null period or group is one like others.
    """
    return rows.groupBy(period.alias("period"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, DISTINCT_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("value_sketch"),
    )


def store(sketches: DataFrame, path: str) -> None:
    """Write sketches into the state at ``path``; periods that are there already are replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def merge(spark: SparkSession, path: str, by: list[str], quantiles: list[float], where: str = "true") -> DataFrame:
    """``by``, ``n``, ``distinct`` and ``quantiles``, merged over the periods that meet ``where``.

    Only those periods' files are read. A group without values has null quantiles.
    """
    state = spark.read.parquet(path).where(where)
    merged = state.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        F.kll_merge_agg_double("value_sketch").alias("_values"),
    )
    some = F.kll_sketch_get_n_double("_values") > 0
    found = F.array(*[F.kll_sketch_get_quantile_double("_values", F.lit(q)) for q in quantiles])
    return merged.select(*by, "n", "distinct", F.when(some, found).alias("quantiles"))


def exact_distinct(rows: DataFrame, by: list[str], distinct: str) -> DataFrame:
    """``by`` and the exact number of distinct whole numbers, by bitmaps of 32,768 values each.

    Like sketches, bitmaps merge; they suit identifiers that are dense. Nulls do not count.
    """
    bitmaps = rows.where(F.col(distinct).isNotNull()).groupBy(*by, F.bitmap_bucket_number(distinct).alias("_bucket"))
    counts = bitmaps.agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(distinct))).alias("_n"))
    return counts.groupBy(*by).agg(F.sum("_n").alias("exact"))
