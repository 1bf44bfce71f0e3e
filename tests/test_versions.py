"""Stored versions with digests against the comparison of whole tables."""

import pytest

from tidemill.errors import SpecError
from tidemill.operators import changes, versions

FIELDS = "id bigint, place string, glaze string"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def stored(spark, tmp_path):
    """Two versions that differ in a few rows: gone, new, changed, changed to null; some keys are null or repeated."""
    old = [(i, f"p{i % 5}", None if i % 9 == 0 else f"g{i % 4}") for i in range(400)] + [(None, "x", "g"), (7, "twice", "g"), (7, "twice", "g")]
    new = [r for r in old if r[0] not in (33, 34)] + [(1000, "p0", "g1"), (None, "y", "g")]
    new = [(i, p, "other" if i == 50 else None if i == 51 else g) for i, p, g in new]
    tables, paths = [spark.createDataFrame(t, FIELDS) for t in (old, new)], [str(tmp_path / "old"), str(tmp_path / "new")]
    for df, path in zip(tables, paths):
        versions.store(df, path, ["id", "place"], ["glaze"], 4, 4)
    return tables, paths


def test_rows_equal_those_of_whole_tables(spark, stored):
    tables, paths = stored
    schema, keys = tables[0].schema, ["id", "place"]
    assert rows(versions.snapshot_diff(spark, *paths, schema, keys)) == rows(changes.snapshot_diff(*tables, keys))
    found = rows(versions.content_changes(spark, *paths, schema, keys, ["glaze"]))
    assert found == rows(changes.content_changes(*tables, keys, ["glaze"])) and len(found) >= 1
    assert versions.differing(spark, paths[0], paths[0], schema)[0].count() == 0


def test_equal_buckets_are_not_read(spark, stored):
    tables, paths = stored
    files = lambda df: set(df.select("_metadata.file_path").distinct().toPandas().file_path)
    read = versions.differing(spark, *paths, tables[0].schema)[0]
    every = spark.read.parquet(f"{paths[0]}/rows")
    assert 0 < len(files(read)) < len(files(every))
    assert "PartitionFilters: [folder" in read._jdf.queryExecution().executedPlan().toString()


def test_shapes_must_agree(spark, stored, tmp_path):
    tables, paths = stored
    versions.store(tables[1], str(tmp_path / "other"), ["id"], ["glaze"], 4, 4)
    with pytest.raises(SpecError, match="different shape"):
        versions.differing(spark, paths[0], str(tmp_path / "other"), tables[0].schema)
    with pytest.raises(SpecError, match="clash"):
        versions.store(spark.range(1).selectExpr("id", "id as bucket"), str(tmp_path / "bad"), ["id"], ["bucket"])


def test_empty_version(spark, stored, tmp_path):
    tables, paths = stored
    none = str(tmp_path / "none")
    versions.store(tables[0].where("false"), none, ["id", "place"], ["glaze"], 4, 4)
    found = versions.snapshot_diff(spark, none, paths[0], tables[0].schema, ["id", "place"])
    assert rows(found) == rows(changes.snapshot_diff(tables[0].where("false"), tables[0], ["id", "place"]))
