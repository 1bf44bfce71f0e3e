import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemill.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidemill-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tidemill-warehouse-"),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def names(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "name string")


@pytest.fixture
def pairs(spark):
    return lambda *values: spark.createDataFrame(list(values), "src string, dst string")


@pytest.fixture
def column():
    return lambda df, name="name": sorted(row[name] for row in df.collect())
