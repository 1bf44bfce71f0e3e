import os

import pytest

from tidemill.errors import SpecError
from tidemill.session import discard, materialize, scratch_path, shared_root


def test_intermediate_tables_lie_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_root(spark) == named.rstrip("/")
    path = scratch_path(spark, "kept")
    assert path.startswith(shared_root(spark)) and path != scratch_path(spark, "kept")


def test_materialize_and_discard(spark):
    path = scratch_path(spark, "numbers")
    table = materialize(spark.range(5).selectExpr("id", "CAST(NULL AS TIMESTAMP_NTZ) AS at"), path=path)
    assert table.count() == 5 and table.schema["at"].dataType.simpleString() == "timestamp_ntz"
    discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_only_own_tables_are_discarded(spark, tmp_path):
    with pytest.raises(SpecError):
        discard(spark, str(tmp_path))
