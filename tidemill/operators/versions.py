"""Versions of a table stored with digests, so that comparing two reads only what differs.

A version's rows lie in buckets by the hash of their key, and the buckets in folders. A bucket's
digest is the number of its rows and sums of two hashes of each row, a folder's digest the same
over its buckets. Comparing goes from the top down: digests of folders, digests of the buckets in
folders that differ, rows of the buckets that differ. Equal buckets are never opened; what is
compared of the rest is what ``changes`` compares of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import SpecError
from tidemill.operators import changes

FOLDERS = 64
BUCKETS_PER_FOLDER = 64

_SUMS = ("rows", "keys_a", "keys_b", "cells_a", "cells_b")


def store(df: DataFrame, path: str, keys: list[str], significant: list[str] = (), folders: int = FOLDERS, per_folder: int = BUCKETS_PER_FOLDER) -> None:
    """Write ``df`` as a version at ``path``: its keys and significant columns, null keys and repeated rows included.

    ``folders`` and ``per_folder`` should make a bucket some hundred MB at most; versions to be
    compared must agree in them, and in keys, columns and their types.
    """
    columns = list(dict.fromkeys([*keys, *significant]))
    taken = {"folder", "bucket"} & {c.lower() for c in columns}
    if taken:
        raise SpecError(f"columns named {sorted(taken)} clash with those of stored versions")
    place = F.pmod(F.xxhash64(F.lit(3), *_values(keys)), F.lit(folders * per_folder)).cast("int")
    placed = df.select(*columns).withColumn("bucket", place).withColumn("folder", F.floor(F.col("bucket") / per_folder).cast("int"))
    # AQE splits what a much repeated key makes too large.
    placed.hint("rebalance", "folder", "bucket").write.mode("overwrite").partitionBy("folder", "bucket").parquet(f"{path}/rows")
    spark = df.sparkSession
    shape = F.lit(f"{folders} {per_folder} {list(keys)} {[(f.name, f.dataType.simpleString()) for f in df.select(*columns).schema]}").alias("shape")
    kept = _rows(spark, path, df.select(*columns).schema)
    sums = [F.sum(F.xxhash64(F.lit(seed), *_values(of)).cast("decimal(38,0)")).alias(name) for of, name, seed in _hashes(keys, columns)]
    leaves = kept.groupBy("folder", "bucket").agg(F.count(F.lit(1)).alias("rows"), *sums)
    leaves.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/buckets")
    leaves = spark.read.schema(_leaf_schema()).parquet(f"{path}/buckets")
    top = leaves.groupBy("folder").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _SUMS])
    header = spark.range(1).select(shape)
    header.write.mode("overwrite").parquet(f"{path}/shape")
    top.coalesce(1).write.mode("overwrite").parquet(f"{path}/folders")


def differing(spark: SparkSession, last: str, current: str, schema, keys_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions in buckets whose digests differ; ``schema`` is that of the stored columns.

    The numbers of such buckets come to the driver, ``folders * per_folder`` at most.
    """
    shapes = [spark.read.parquet(f"{p}/shape").first()[0] for p in (last, current)]
    if shapes[0] != shapes[1]:
        raise SpecError(f"versions of different shape: {shapes[0]} and {shapes[1]}")
    sums = _SUMS[:3] if keys_only else _SUMS
    top_schema = "folder int, " + ", ".join(f"{c} decimal(38,0)" for c in _SUMS)
    tops = [spark.read.schema(top_schema).parquet(f"{p}/folders") for p in (last, current)]
    folders = [r.folder for r in _unequal(*tops, ["folder"], sums).collect()]
    leaves = [spark.read.schema(_leaf_schema()).parquet(f"{p}/buckets").where(F.col("folder").isin(folders)) for p in (last, current)]
    places = _unequal(*leaves, ["folder", "bucket"], sums).collect() if folders else []
    wanted = F.col("folder").isin(sorted({r.folder for r in places})) & F.col("bucket").isin([r.bucket for r in places])
    return tuple(_rows(spark, p, schema).where(wanted).drop("folder", "bucket") for p in (last, current))


def snapshot_diff(spark: SparkSession, last: str, current: str, schema, keys: list[str]) -> DataFrame:
    """As ``changes.snapshot_diff``, reading only buckets whose keys differ."""
    return changes.snapshot_diff(*differing(spark, last, current, schema, keys_only=True), keys)


def content_changes(spark: SparkSession, last: str, current: str, schema, keys: list[str], significant: list[str]) -> DataFrame:
    """As ``changes.content_changes``, reading only buckets that differ."""
    return changes.content_changes(*differing(spark, last, current, schema), keys, significant)


def _hashes(keys, columns):
    return (keys, "keys_a", 11), (keys, "keys_b", 12), (columns, "cells_a", 13), (columns, "cells_b", 14)


def _values(columns):
    """Nulls leave a hash as it is, so they are marked apart."""
    return [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]


def _leaf_schema():
    return "bucket int, rows bigint, " + ", ".join(f"{c} decimal(38,0)" for c in _SUMS[1:]) + ", folder int"


def _rows(spark, path, schema):
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{columns}, folder int, bucket int").parquet(f"{path}/rows")


def _unequal(last, current, by, sums):
    """Places whose digests differ or that only one version has."""
    both = last.withColumn("side", F.lit(0)).unionByName(current.withColumn("side", F.lit(1)))
    per = [F.sum(F.when(F.col("side") == 0, F.col(c)).otherwise(-F.col(c))).alias(c) for c in sums]
    differs = F.lit(False)
    for c in sums:
        differs = differs | (F.col(c) != 0)
    return both.groupBy(by).agg(*per).where(differs).select(by)
